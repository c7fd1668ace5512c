"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task cuts its documents into shards of a bounded number of words and sorts the suffixes of a shard that can match
anything: words that no benchmark item holds cannot, so suffixes with a run of fewer known words than the shortest
window are left out of the array. Every suffix of the benchmark items that starts a window is then found by binary
search. Places that lie alike in a document and in an item join to longest verbatim matches, given with their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, numbered, words_of

WINDOW = 10
#: Words of a shard, bytes of benchmark text that one pass over the documents searches, and words of a piece of an item.
SHARD_WORDS, PASS_BYTES, PIECE_WORDS = 1_000_000, 8_000_000, 200_000
#: Pairs of a place and a window of an item that are joined at once.
_PAIRS = 1 << 20
#: Words after A-Z are lower-cased, as Java's regular expressions write them.
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A part of an item: its name, a key of its row, its first word in the item, and its text.
Part = tuple[str, int, int, str]


class Items:
    """The windows of parts of benchmark items, as numbered words; an item with fewer words than a window is one window."""

    def __init__(self, parts: list[Part], window: int = WINDOW):
        self.window, self.known = window, {}
        self.names: list[str] = sorted({p[0] for p in parts})
        place = {n: i for i, n in enumerate(self.names)}
        words = [np.array([self.known.setdefault(x, len(self.known) + 1) for x in words_of(p[3])], np.int64) for p in parts]
        #: Of each part: the place of its item's name, its row, and the first word that it has of the item.
        self.name = np.array([place[p[0]] for p in parts], np.int64)
        self.row = np.array([p[1] for p in parts], np.int64)
        self.first = np.array([p[2] for p in parts], np.int64)
        self.bits = max(1, len(self.known).bit_length())
        self.per = 62 // self.bits
        size = np.array([len(w) for w in words], np.int64)
        self.least = int(min(size[size > 0].min(initial=window), window))
        #: For each length: packed windows (windows x keys), then parts and places in them of each window, flat, with starts.
        self.groups = []
        for m in range(self.least, window + 1):
            own = [i for i, n in enumerate(size.tolist()) if (n == m if m < window else n >= m)]
            if not own:
                continue
            flat = np.concatenate([words[i] for i in own])
            ends = np.cumsum(size[own])
            part, at = np.repeat(own, size[own] - m + 1), np.concatenate([np.arange(n - m + 1) for n in size[own].tolist()])
            begin = np.repeat(ends - size[own], size[own] - m + 1) + at
            rows = np.zeros((len(begin), window), np.int64)
            for j in range(m):
                rows[:, j] = flat[begin + j]
            keys = self.pack(rows)
            order = np.lexsort(keys.T[::-1])
            keys = keys[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
            self.groups.append((m, keys[new], part[order], at[order], np.append(np.flatnonzero(new), len(keys))))

    def pack(self, words: np.ndarray) -> np.ndarray:
        """Rows of `window` word numbers as rows of integers that order as the words do."""
        keys = []
        for a in range(0, self.window, self.per):
            k = np.zeros(len(words), np.int64)
            for j in range(a, a + self.per):
                k = (k << self.bits) | (words[:, j] if j < self.window else 0)
            keys.append(k)
        return np.stack(keys, 1)

    def get(self, word: bytes) -> int:
        return self.known.get(word, 0)


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places starts[w] .. starts[w + 1] of each w in which."""
    n = starts[which + 1] - starts[which]
    row = np.repeat(np.arange(len(which)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n)


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows (document, part, shift, start, end) with those of one shift that meet as one: the words between are the same."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    group = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
    reach = _reach(rows[:, 4], group)
    new = group | np.concatenate([[True], rows[1:, 3] > reach[:-1]])
    first = np.flatnonzero(new)
    out = rows[first]
    out[:, 4] = np.maximum.reduceat(rows[:, 4], first)
    return out


def _reach(end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The largest end so far in each group, whose first rows are marked."""
    far = int(end.max()) + 1
    lift = (np.cumsum(group) - 1) * far
    return np.maximum.accumulate(end + lift) - lift


def _longest(rows: np.ndarray) -> np.ndarray:
    """The rows that lie within no other of the same document and part."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 3], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    group = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    return rows[group | np.concatenate([[True], rows[1:, 4] > _reach(rows[:, 4], group)[:-1]])]


class Shard:
    """The suffix array of the numbered words of documents; documents are parted by -1."""

    def __init__(self, items: Items, docs: list[np.ndarray]):
        self.items = items
        sizes = np.array([len(d) + 1 for d in docs])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.words = np.full(self.starts[-1] + items.window, -1, np.int64)
        for s, d in zip(self.starts, docs, strict=False):
            self.words[s : s + len(d)] = d
        stop = np.flatnonzero(self.words <= 0)
        known = np.flatnonzero(self.words > 0)
        run = stop[np.searchsorted(stop, known)] - known  # known words from here on
        at, run = known[run >= items.least], run[run >= items.least]
        rows = np.zeros((len(at), items.window), np.int64)
        for j in range(items.window):
            rows[:, j] = np.where(run > j, self.words[at + j], 0)
        keys = items.pack(rows)
        order = np.lexsort(keys.T[::-1])
        self.suffixes, self.keys = at[order], keys[order]

    def _bound(self, query: np.ndarray, m: int, right: bool) -> np.ndarray:
        """For each query the number of suffixes whose first m words are less than it (right: or equal to it)."""
        it, n = self.items, len(self.suffixes)
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            held = self.keys[np.minimum(mid, n - 1)]
            less, same = np.zeros(len(query), bool), np.ones(len(query), bool)
            for j in range(0, -(-m // it.per)):
                shift = max(0, it.per - (m - j * it.per)) * it.bits
                a, b = held[:, j] >> shift, query[:, j] >> shift
                less |= same & (a < b)
                same &= a == b
            go = open_ & (less | same if right else less)
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def search(self):
        """For each window length: (length, places of matches, their window, parts and places of windows flat, starts)."""
        out = []
        for m, query, part, place, starts in self.items.groups if len(self.suffixes) else []:
            lo, hi = self._bound(query, m, False), self._bound(query, m, True)
            n = hi - lo
            which = np.repeat(np.arange(len(query)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append((m, self.suffixes[at], which, part, place, starts))
        return out

    def report(self) -> tuple[np.ndarray, list[list[int]]]:
        """Hit words of each document, and the items of which a window occurs in it."""
        docs = len(self.starts) - 1
        edge = np.zeros(len(self.words) + 1, np.int64)
        pairs = []
        for m, at, which, part, _, starts in self.search():
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
            doc = np.searchsorted(self.starts, at, "right") - 1
            both = np.unique(doc * len(starts) + which)
            doc, which = both // len(starts), both % len(starts)
            row, place = _spread(starts, which)
            pairs.append(np.unique(doc[row] * len(self.items.names) + self.items.name[part[place]]))
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        found: list[list[int]] = [[] for _ in range(docs)]
        for p in np.unique(np.concatenate(pairs)) if pairs else []:
            found[p // len(self.items.names)].append(int(p % len(self.items.names)))
        return hit[self.starts[1:]] - hit[self.starts[:-1]], found

    def matches(self) -> list[tuple[int, int, int, int, int]]:
        """(document, part, first word in the item, first word in the document, words) of each longest verbatim match.

        Those that lie within a longer match with the same part are left out.
        """
        held = [np.zeros((0, 5), np.int64)]
        for m, at, which, part, place, starts in self.search():
            order = np.argsort(at, kind="stable")
            at, which = at[order], which[order]
            n = np.cumsum(starts[which + 1] - starts[which])
            lo = 0
            while lo < len(at):
                done = n[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(n, done + _PAIRS, "right")))
                row, flat = _spread(starts, which[lo:hi])
                p = at[lo:hi][row]
                doc = np.searchsorted(self.starts, p, "right") - 1
                p = p - self.starts[doc]
                # Cut at places, so longest ones of one cut may go on in the next: none is left out before they are joined.
                held.append(_joined(np.stack([doc, part[flat], p - place[flat], p, p + m], 1)))
                lo = hi
        rows = _longest(_joined(np.concatenate(held)))
        return [(d, i, a - shift + int(self.items.first[i]), a, b - a) for d, i, shift, a, b in rows.tolist()]


def _shards(items: Items, batches, text: int, size: int):
    """(batches, their shard) until at least `size` words are gathered; a batch is cut where it would pass that by far."""
    held, docs, n = [], [], 0
    for batch in batches:
        first = 0
        for i, t in enumerate(batch.column(text).to_pylist()):
            docs.append(numbered(t or "", items.get))
            n += len(docs[-1])
            if n >= size:
                held.append(batch.slice(first, i + 1 - first))
                yield held, docs
                held, docs, n, first = [], [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if docs:
        yield held, docs


def _passes(items: DataFrame, item_id: str, item_text: str, window: int, pass_bytes: int) -> list[list[Part]]:
    """Parts of the benchmark in blocks of about pass_bytes, each small enough to send to every task.

    Long items are cut to parts that overlap by a window less one word, so that no window is lost.
    """
    text = F.translate(F.coalesce(F.col(item_text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.xxhash64(text).alias("row"), F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    rows = rows.select("name", "row", "w", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))).alias("first"))
    rows = rows.select("name", "row", F.col("first").cast("long").alias("first"), F.array_join(F.slice("w", F.col("first") + 1, F.lit(PIECE_WORDS + window - 1)), " ").alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes) or 1
    if n > 1:
        rows = cut(rows, "decontaminate-items")
    return [[tuple(r) for r in rows.filter(F.pmod(F.xxhash64("name", "row", "first"), F.lit(n)) == i).orderBy("name", "row", "first").collect()] for i in range(n)]


_MATCH = pa.struct([("item", pa.string()), ("row", pa.int64()), ("item_start", pa.int64()), ("start", pa.int64()), ("words", pa.int64())])
_MATCHES = "array<struct<item:string,row:bigint,item_start:bigint,start:bigint,words:bigint>>"


def _met(matches: list[dict]) -> list[dict]:
    """Matches of the parts of one item, found in several passes, as those of the whole item."""
    names = sorted({(m["item"], m["row"]) for m in matches})
    place = {x: i for i, x in enumerate(names)}
    rows = np.array([(0, place[m["item"], m["row"]], m["start"] - m["item_start"], m["start"], m["start"] + m["words"]) for m in matches], np.int64).reshape(-1, 5)
    rows = _longest(_joined(rows))
    out = [{"item": names[i][0], "row": names[i][1], "item_start": a - shift, "start": a, "words": b - a} for _, i, shift, a, b in rows.tolist()]
    return sorted(out, key=lambda m: (m["start"], m["item"], m["item_start"], m["row"]))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """id_col, n_words, n_hit, n_items long, items array<string> (sorted), matches of each row of docs.

    A document word inside any occurrence of a window of an item is hit. matches array<struct<item, item_start, start,
    words>> gives the longest verbatim matches of a window or more, by start: the item, its first matched word, the
    document's, and how many words follow alike; a match within a longer one with the same row of items is left out.
    Null texts have no words; items without words have no windows; items that share an id are one item, a null item id
    reads as "". Repeated rows and null ids stay. No documents: no rows; no items: no hits. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _passes(items, item_id, item_text, window, pass_bytes)
    if len(blocks) > 1:
        rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), "decontaminate")
    else:
        rows = rows.withColumn("at", F.lit(0).cast("long"))

    def scan(block):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, window))  # of pass_bytes of text

        def run(batches):
            it = sent.value
            for held, found in _shards(it, batches, 1, SHARD_WORDS):
                shard = Shard(it, found)
                hits, of = shard.report()
                matches: list[list] = [[] for _ in found]
                for d, i, q, a, n in shard.matches():
                    matches[d].append({"item": it.names[it.name[i]], "row": int(it.row[i]), "item_start": q, "start": a, "words": n})
                at = 0
                for b in held:
                    s = slice(at, at := at + b.num_rows)
                    met = [_met(x) for x in matches[s]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(2), pa.array([len(d) for d in found[s]], pa.int64()), pa.array(hits[s], pa.int64()), pa.array([[it.names[i] for i in x] for x in of[s]], pa.list_(pa.string())), pa.array(met, pa.list_(_MATCH))],
                        names=["id", "at", "n_words", "n_hit", "items", "matches"],
                    )

        return in_arrow(rows, run, f"id {kind}, at long, n_words long, n_hit long, items array<string>, matches {_MATCHES}")

    found = scan(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(scan(block))
    if len(blocks) > 1:  # matches of a document meet: words under any of them count once

        def meet(batches):
            for b in batches:
                met = [_met(x) for x in b.column(4).to_pylist()]
                hits = []
                for x in met:
                    n = to = 0
                    for m in x:
                        n, to = n + max(0, m["start"] + m["words"] - max(to, m["start"])), max(to, m["start"] + m["words"])
                    hits.append(n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.int64()), b.column(3), pa.array(met, pa.list_(_MATCH))], names=["id", "n_words", "n_hit", "items", "matches"])

        merged = found.groupBy("at").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
        found = in_arrow(merged.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), "items", "matches"), meet, f"id {kind}, n_words long, n_hit long, items array<string>, matches {_MATCHES}")
    shown = F.transform("matches", lambda m: F.struct(m["item"].alias("item"), m["item_start"].alias("item_start"), m["start"].alias("start"), m["words"].alias("words")))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", shown.alias("matches"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of an item occurs. Cases: see contamination()."""
    place = docs.columns.index(text_col)
    for block in _passes(items, item_id, item_text, window, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, window))

        def run(batches, sent=sent):
            it = sent.value
            for held, found in _shards(it, batches, place, SHARD_WORDS):
                hits, _ = Shard(it, found).report()
                at = 0
                for b in held:
                    yield b.filter(pa.array(hits[at : (at := at + b.num_rows)] == 0))

        docs = in_arrow(docs, run, docs.schema)
    return docs
