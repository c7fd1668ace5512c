"""Contents entries and pages: lists that one reply cannot hold, and entries whose contents give no pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import page_number, tagged_number, tokens
from folioscope.operators import packing
from folioscope.operators.enrich import Client, called, kept, outline_items, prompt_of, yes


def entries(contents: DataFrame, client: Client | None, rounds: int = 3) -> DataFrame:
    """doc_id, pos, structure, title, page of contents texts (doc_id, text), asked for until the list is complete.

    A reply that breaks off is cut after its last whole entry and gone on with; after `rounds` what is there is closed.
    """
    state = called(contents.select("doc_id", "text"), prompt_of("toc_items", text=F.col("text")), client, True).select("doc_id", "text", F.trim("reply").alias("list"))
    for n in range(rounds + 1):
        told = called(state, prompt_of("toc_complete", so_far=F.col("list"), text=F.col("text")), client, True)
        state = kept(told.select("doc_id", "text", "list", (yes(F.col("reply")) & F.try_parse_json("list").isNotNull()).alias("done")))
        if n == rounds or state.filter("NOT done").limit(1).count() == 0:
            break
        whole = F.regexp_extract("list", r"(?s)^(.*\})", 1)
        more = called(state.filter("NOT done").withColumn("list", whole), prompt_of("toc_next", so_far=F.col("list"), text=F.col("text")), client, True)
        longer = more.select("doc_id", "text", F.concat("list", F.when(~F.ltrim("reply").rlike(r"^[,\]}]"), ",").otherwise(""), F.trim("reply")).alias("list"))
        state = longer.unionByName(state.filter("done").select("doc_id", "text", "list"))
    closed = F.when(F.try_parse_json("list").isNull(), F.concat(F.regexp_extract("list", r"(?s)^(.*\})", 1), F.lit("]}"))).otherwise(F.col("list"))
    rows = state.select("doc_id", F.posexplode(outline_items(closed)).alias("pos", "i"))
    return rows.select("doc_id", "pos", "i.structure", "i.title", page_number(F.col("i.page")).alias("page"))


def tagged_groups(pages: DataFrame, max_tokens: int = 20_000) -> DataFrame:
    """doc_id, group_no, text: pages between their tags, in groups that fit a prompt and overlap by a page."""
    groups = packing.groups(pages.withColumn("token_count", tokens(F.col("text"))), max_tokens, 1).filter("last >= first")
    tag = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
    spread = groups.select("doc_id", "group_no", F.explode(F.sequence(F.col("first") + 1, F.col("last") + 1)).alias("page_no"))
    parts = F.sort_array(F.collect_list(F.struct("page_no", F.concat(tag, F.lit("\n"), "text", F.lit("\n"), tag).alias("t"))))
    return spread.join(pages, ["doc_id", "page_no"]).groupBy("doc_id", "group_no").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def _asked(items: DataFrame, texts: DataFrame, prompt: str, client: Client | None) -> DataFrame:
    item = F.to_json(F.struct("structure", "title"))
    rows = items.select("doc_id", "pos", "structure", "title").join(texts, "doc_id")
    told = called(rows, prompt_of(prompt, item=item, text=F.col("text")), client, True)
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    of = lambda key: F.get_json_object(body, f"$.{key}")
    return told.withColumns({"structure": F.coalesce(of("structure"), "structure"), "title": F.coalesce(of("title"), "title"), "_page": of("page"), "_tag": of("physical_index")})


def printed_pages(items: DataFrame, texts: DataFrame, client: Client | None) -> DataFrame:
    """doc_id, pos, group_no, structure, title, page: what each text (doc_id, group_no, text) says of each entry's page."""
    told = _asked(items, texts, "item_page", client)
    return told.select("doc_id", "pos", "group_no", "structure", "title", page_number(F.col("_page")).alias("page"))


def places(items: DataFrame, texts: DataFrame, client: Client | None) -> DataFrame:
    """doc_id, pos, group_no, structure, title, physical_index: the tagged page on which each entry starts, null for none."""
    told = _asked(items, texts, "item_place", client)
    return told.select("doc_id", "pos", "group_no", "structure", "title", tagged_number(F.col("_tag")).alias("physical_index"))


def located(items: DataFrame, pages: DataFrame, client: Client | None, max_tokens: int = 20_000) -> DataFrame:
    """items with physical_index: the first page on which any group of the document's pages has the entry."""
    found = places(items, tagged_groups(pages, max_tokens), client).groupBy("doc_id", "pos").agg(F.min("physical_index").alias("physical_index"))
    return items.drop("physical_index").join(found, ["doc_id", "pos"], "left")
