"""Model calls over deduplicated prompts, and the enrichment of nodes and documents."""

from __future__ import annotations

import hashlib
import json
import time
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts of a call, the pause between them, and calls a minute.
ATTEMPTS, PAUSE_S, PER_MINUTE = 10, 1.0, 30
#: Tasks that share a quota of calls.
TASKS = 4
ERROR = "Error"

PROMPTS = {
    "toc_page": "Does this page hold a table of contents? Answer as JSON {{\"answer\": \"yes\"}} or {{\"answer\": \"no\"}}.\n\n{text}",
    "toc_numbers": "Does this table of contents give page numbers? Answer as JSON {{\"answer\": \"yes\"}} or {{\"answer\": \"no\"}}.\n\n{text}",
    "toc_items": "Turn this table of contents into JSON {{\"result\": [{{\"structure\": \"1.2\", \"title\": \"...\", \"page\": 3}}]}}.\n\n{text}",
    "toc_complete": "Does the list hold every entry of this table of contents? Answer as JSON {{\"answer\": \"yes\"}} or {{\"answer\": \"no\"}}.\nList: {so_far}\n\n{text}",
    "toc_next": "Go on with this JSON list where it breaks off, without repeating it: {so_far}\nTable of contents:\n{text}",
    "item_page": "Which printed page does this contents entry name? Answer as JSON {{\"structure\": \"1\", \"title\": \"...\", \"page\": 3}}.\nEntry: {item}\n\n{text}",
    "item_place": "On which tagged page does this entry start? Answer as JSON {{\"structure\": \"1\", \"title\": \"...\", \"physical_index\": \"<physical_index_1>\"}}, null if it is on none.\nEntry: {item}\n\n{text}",
    "image_alt": "Give a short alternative text for the image {title}.",
    "image_description": "Describe the image {title} in at most two sentences.",
    "outline_first": "List the sections of this tagged text as JSON {{\"result\": [{{\"structure\": \"1\", \"title\": \"...\", \"physical_index\": \"<physical_index_1>\"}}]}}.\n\n{text}",
    "outline_next": "Go on with these sections: {so_far}\nList further sections of this tagged text in the same form.\n\n{text}",
    "title_on_page": "Does a section titled {title} appear on this page? Answer as JSON {{\"answer\": \"yes\"}} or {{\"answer\": \"no\"}}.\n\n{text}",
    "title_starts_page": "Does this page start with a section titled {title}? Answer as JSON {{\"answer\": \"yes\"}} or {{\"answer\": \"no\"}}.\n\n{text}",
    "find_title": "On which tagged page does the section titled {title} start? Answer as JSON {{\"physical_index\": \"<physical_index_1>\"}}.\n\n{text}",
    "header_table": "Is this table a page header, repeated on every page? Answer as JSON {{\"is_header\": true}} or {{\"is_header\": false}}.\n\n{text}",
    "expand_table": "Should each row of this table become a section? Answer as JSON {{\"expand\": true, \"name_column_index\": 0}}.\n\n{text}",
    "table_title": "Give this table a short title.\n\n{text}",
    "table_summary": "Summarise this table in one sentence.\n\n{text}",
    "summary": "Describe the main points of the section titled {title}.\n\n{text}",
    "description": "Describe in one sentence the document with this structure.\n\n{text}",
    "tree_search": "Question: {query}\nWhich nodes of this tree can answer it? Answer as JSON {{\"thinking\": \"...\", \"node_list\": [\"0001\"]}}.{preferences}\n\n{text}",
    "documents": "Question: {query}\nWhich of these documents can answer it? Answer as JSON {{\"thinking\": \"...\", \"answer\": [1]}}.\n\n{text}",
    "answer": "Answer from the context alone.\nQuestion: {query}\nContext:\n{text}",
}


class Client(ABC):
    """A text model. Clients are sent to executors, so they hold settings, not connections."""

    @abstractmethod
    def generate(self, prompt: str, json_reply: bool = False) -> str: ...


class Stub(Client):
    """Deterministic replies for tests: replies by the first key that the prompt contains, else a digest of it."""

    def __init__(self, replies: dict[str, str] | None = None):
        self.replies = replies or {}

    def generate(self, prompt: str, json_reply: bool = False) -> str:
        for key, reply in self.replies.items():
            if key in prompt:
                return reply
        return ("{}" if json_reply else "") + hashlib.sha256(prompt.encode()).hexdigest()[:16] * (not json_reply)


class HttpClient(Client):
    """A chat-completions endpoint; model options go to the body as they are."""

    def __init__(self, url: str, key: str, model: str, options: dict | None = None, timeout_s: float = 60):
        self.url, self.key, self.model, self.options, self.timeout_s = url, key, model, options or {}, timeout_s

    def body(self, prompt: str, json_reply: bool) -> dict:
        form = {"response_format": {"type": "json_object"}} if json_reply else {}
        return {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}], **self.options, **form}

    def generate(self, prompt: str, json_reply: bool = False) -> str:
        import urllib.request

        ask = urllib.request.Request(self.url, json.dumps(self.body(prompt, json_reply)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout_s) as got:
            return json.load(got)["choices"][0]["message"]["content"]


class MessagesClient(Client):
    """A messages endpoint with a version header; JSON replies are asked for in the prompt."""

    ONLY_JSON = "Answer with one valid JSON value and nothing around it."

    def __init__(self, url: str, key: str, model: str, version: str = "2023-06-01", most_tokens: int = 8192, timeout_s: float = 60):
        if not key:
            raise ValueError("a key is required")
        self.url, self.key, self.model, self.version, self.most_tokens, self.timeout_s = url, key, model, version, most_tokens, timeout_s

    def body(self, prompt: str, json_reply: bool) -> dict:
        asked = f"{prompt}\n\n{self.ONLY_JSON}" if json_reply else prompt
        return {"model": self.model, "max_tokens": self.most_tokens, "temperature": 0, "messages": [{"role": "user", "content": asked}]}

    @staticmethod
    def text(reply: dict) -> tuple[str, bool]:
        """The text of a reply, and whether it was cut at the most tokens."""
        return "".join(p["text"] for p in reply.get("content", []) if p.get("type") == "text"), reply.get("stop_reason") == "max_tokens"

    def generate(self, prompt: str, json_reply: bool = False) -> str:
        import urllib.request

        headers = {"Content-Type": "application/json", "x-api-key": self.key, "anthropic-version": self.version}
        ask = urllib.request.Request(self.url, json.dumps(self.body(prompt, json_reply)).encode(), headers)
        with urllib.request.urlopen(ask, timeout=self.timeout_s) as got:
            return self.text(json.load(got))[0]


class Rules(Client):
    """Deterministic replies for tests: that of the first rule whose strings all stand in the prompt, else no."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str]]):
        self.rules = rules

    def generate(self, prompt: str, json_reply: bool = False) -> str:
        return next((reply for parts, reply in self.rules if all(p in prompt for p in parts)), '{"answer": "no"}')


CLIENTS: dict[str, Callable[..., Client]] = {"stub": Stub, "http": HttpClient, "messages": MessagesClient}
_active: ContextVar[Client | None] = ContextVar("folioscope_client", default=None)


@contextmanager
def using(client: Client):
    """Plans that are built inside and get no client take this one."""
    token = _active.set(client)
    try:
        yield client
    finally:
        _active.reset(token)


def active(client: Client | None = None) -> Client:
    """The client given, else the one in use; raises without either."""
    if (found := client or _active.get()) is None:
        raise ValueError("no client: give one or build the plan inside using()")
    return found


def client_of(provider: str, **settings) -> Client:
    if provider not in CLIENTS:
        raise ValueError(f"unknown provider: {provider}")
    return CLIENTS[provider](**settings)


class Limiter:
    """At most `most` calls in any window of `seconds`, in one task."""

    def __init__(self, most: int = PER_MINUTE, seconds: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.most, self.seconds, self.clock, self.sleep, self.times = most, seconds, clock, sleep, deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.times and now - self.times[0] >= self.seconds:
                self.times.popleft()
            if len(self.times) < self.most:
                self.times.append(now)
                return
            self.sleep(self.seconds - (now - self.times[0]))


def kept(df: DataFrame) -> DataFrame:
    """df computed once, so that replies are not asked for again: a checkpoint in spark.checkpoint.dir, or cached without one."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def prompt_of(name: str, **columns: Column) -> Column:
    """The template with columns in its {places}, doubled braces as single ones."""
    out = F.lit(PROMPTS[name].replace("{{", "\x01").replace("}}", "\x02"))
    for key, column in columns.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(column, F.lit("")))
    return F.translate(out, "\x01\x02", "{}")


def called(rows: DataFrame, prompt: Column, client: Client | None, json_reply: bool = False, per_minute: int | None = None, attempts: int = ATTEMPTS, pause_s: float = PAUSE_S) -> DataFrame:
    """rows with reply and status: each different prompt is asked once, and replies join back by the prompt's hash.

    A prompt that fails all attempts has the reply "Error" and status error; a null prompt is not asked. Replies are
    kept, so that no later action or lost task asks again; per_minute is the quota of all tasks together.
    """
    client = active(client)
    keyed = rows.withColumn("_prompt", prompt).withColumn("_h", F.sha2("_prompt", 256))
    # The quota is for all tasks together, so it is dealt to a known number of them.
    parts = max(1, min(TASKS, per_minute)) if per_minute else None

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = Limiter(per_minute // parts) if parts else None
        for f in frames:
            out = []
            for text in f["_prompt"]:
                reply, status = ERROR, "error"
                for n in range(attempts):
                    if limit:
                        limit.wait()
                    try:
                        reply, status = client.generate(text, json_reply), "ok"
                        break
                    except Exception:  # noqa: BLE001  a provider may raise anything
                        if n + 1 < attempts:
                            time.sleep(pause_s)
                out.append((reply, status))
            yield pd.DataFrame({"_h": f["_h"], "reply": [x[0] for x in out], "status": [x[1] for x in out]})

    each = keyed.filter("_h IS NOT NULL").groupBy("_h").agg(F.first("_prompt").alias("_prompt"))
    each = each.repartition(parts, "_h") if parts else each
    asked = kept(each.mapInPandas(ask, "_h string, reply string, status string"))
    return keyed.join(asked, "_h", "left").drop("_h", "_prompt")


def yes(reply: Column, key: str = "answer") -> Column:
    """Whether a JSON reply says yes or true under the key; false for any other text."""
    return F.coalesce(F.lower(F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), f"$.{key}")).isin("yes", "true"), F.lit(False))


ITEMS = "struct<result:array<struct<structure:string,title:string,page:string,physical_index:string>>>"


def outline_items(reply: Column) -> Column:
    """The items of a {"result": [...]} reply; raises where there is no such list."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), ITEMS)["result"]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no result list in: "), F.left(reply, F.lit(300)))).cast("array<struct<structure:string,title:string,page:string,physical_index:string>>"))


def summarised(tree: DataFrame, client: Client, threshold: int | None = 200, text: str = "text", per_minute: int | None = None) -> DataFrame:
    """tree with summary (leaves) or prefix_summary (inner nodes); texts below the threshold stand for themselves.

    threshold None: every node is asked, as for paged documents.
    """
    inner = tree.filter("parent_pos IS NOT NULL").select("doc_id", F.col("parent_pos").alias("pos")).distinct().withColumn("_inner", F.lit(True))
    marked = tree.join(inner, ["doc_id", "pos"], "left")
    long = F.lit(True) if threshold is None else F.col("token_count") >= threshold
    replied = called(marked, F.when(long, prompt_of("summary", title=F.col("title"), text=F.col(text))), client, per_minute=per_minute)
    said = F.when(long, F.col("reply")).otherwise(F.col(text))
    return replied.withColumns({"summary": F.when(F.col("_inner").isNull(), said), "prefix_summary": F.when(F.col("_inner"), said)}).drop("_inner", "reply", "status")


def described(structures: DataFrame, client: Client) -> DataFrame:
    """structures (doc_id, structure) with doc_description."""
    return called(structures, prompt_of("description", text=F.col("structure")), client).withColumnRenamed("reply", "doc_description").drop("status")


def outlined(parts: DataFrame, client: Client) -> DataFrame:
    """doc_id, pos, structure, title, physical_index of tagged text parts (doc_id, group_no, text).

    A part's prompt holds the items of the parts before, so the parts of a document follow one another in one group;
    documents run beside each other.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        items: list[dict] = []
        for text in f.sort_values("group_no")["text"]:
            if items:
                ask = PROMPTS["outline_next"].format(so_far=json.dumps(items, ensure_ascii=False), text=text)
            else:
                ask = PROMPTS["outline_first"].format(text=text)
            reply = client.generate(ask, True)
            items += (json.loads(reply[reply.index("{") : reply.rindex("}") + 1]) or {}).get("result") or []
        rows = []
        for i, x in enumerate(items):
            tag = "".join(c for c in str(x.get("physical_index") or "") if c.isdigit())
            rows.append((f["doc_id"].iloc[0], i, x.get("structure"), x.get("title"), int(tag) if tag else None))
        return pd.DataFrame(rows, columns=["doc_id", "pos", "structure", "title", "physical_index"]).astype({"physical_index": "Int64"})

    return parts.select("doc_id", "group_no", "text").groupBy("doc_id").applyInPandas(one, "doc_id long, pos int, structure string, title string, physical_index int")


def repaired(items: DataFrame, pages: DataFrame, client: Client, rounds: int = 3) -> DataFrame:
    """items (doc_id, pos, title, physical_index, correct boolean, page_count) after up to `rounds` of repair.

    Each wrong item is asked for again between its right neighbours, and the page found is checked; rounds end when none
    is wrong. Each round is kept, so that lineage stays short and replies are asked for once.
    """
    from folioscope.functions.text import tagged_number
    from folioscope.operators.outline import repair_bounds

    for _ in range(rounds):
        items = kept(items)
        wrong = repair_bounds(items, ~F.col("correct"))
        if wrong.limit(1).count() == 0:
            break
        spread = wrong.filter("low <= high").select("doc_id", "pos", "title", F.explode(F.sequence("low", "high")).alias("page_no")).join(pages, ["doc_id", "page_no"])
        tag = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
        near = spread.groupBy("doc_id", "pos", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.concat(tag, "text", tag).alias("t")))), lambda x: x["t"]), "\n").alias("_near"))
        told = called(near, prompt_of("find_title", title=F.col("title"), text=F.col("_near")), client, True)
        found = told.select("doc_id", "pos", "title", tagged_number(F.get_json_object("reply", "$.physical_index")).alias("_new"))
        seen = found.join(pages.select("doc_id", F.col("page_no").alias("_new"), "text"), ["doc_id", "_new"])
        checked = called(seen, prompt_of("title_on_page", title=F.col("title"), text=F.col("text")), client, True).select("doc_id", "pos", "_new", yes(F.col("reply")).alias("_ok"))
        items = items.join(checked, ["doc_id", "pos"], "left").withColumns({"physical_index": F.coalesce("_new", "physical_index"), "correct": F.col("correct") | F.coalesce("_ok", F.lit(False))}).drop("_new", "_ok")
    return items


def image_texts(images: DataFrame, client: Client | None = None, most: int = 200) -> DataFrame:
    """images (title) with alt and description as one line each; a failed call leaves none."""
    from folioscope.functions.tables import one_line

    for name, prompt in (("alt", "image_alt"), ("description", "image_description")):
        told = called(images, prompt_of(prompt, title=F.col("title")), client)
        images = told.withColumn(name, F.when(F.col("status") == "ok", one_line(F.col("reply"), most))).drop("reply", "status")
    return images
