"""From pages to an outline: contents pages, printed and physical numbers, checks, repair, and the ladder between modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import dots_to_colon, tokens
from folioscope.operators import outline, packing, tree
from folioscope.operators.blocks import page_text
from folioscope.operators.enrich import Client, called, kept, outlined, prompt_of, repaired, yes
from folioscope.plans.align import entries, located

Pages = DataFrame  #: doc_id, page_no, text: one row per page


def contents_run(pages: Pages, client: Client, within: int) -> DataFrame:
    """doc_id, start, end, pages: the first run of contents pages that starts within the first pages."""
    told = called(pages, prompt_of("toc_page", text=F.col("text")), client, True)
    answers = told.select("doc_id", "page_no", F.when(yes(F.col("reply")), "yes").otherwise("no").alias("answer"))
    return outline.first_run(answers, "answer", "page_no", within + 1)


def contents_text(pages: Pages, runs: DataFrame) -> DataFrame:
    """doc_id, text: the contents pages joined, dot leaders as colons."""
    held = pages.join(runs.select("doc_id", "start", "end"), "doc_id").filter("page_no BETWEEN start AND end")
    return page_text(held.select("doc_id", "page_no", "text")).withColumn("text", dots_to_colon(F.col("text")))


def contents_items(contents: DataFrame, client: Client) -> DataFrame:
    """doc_id, pos, structure, title, page of contents texts whose pages are numbered; others have no rows."""
    told = called(contents, prompt_of("toc_numbers", text=F.col("text")), client, True)
    numbered = told.filter(yes(F.col("reply"))).drop("reply", "status")
    return entries(numbered, client)


def unnumbered_items(contents: DataFrame, client: Client) -> DataFrame:
    """doc_id, pos, structure, title of contents texts that give no page numbers, asked for until they are complete."""
    told = called(contents, prompt_of("toc_numbers", text=F.col("text")), client, True)
    return entries(told.filter(~yes(F.col("reply"))).select("doc_id", "text"), client).drop("page")


def by_offset(items: DataFrame, pages: Pages, client: Client) -> DataFrame:
    """items with physical_index: the printed page plus the most frequent distance to the page where a title was found.

    Every item is looked for on all pages of its document.
    """
    first = items.join(pages, "doc_id")
    told = called(first, prompt_of("title_on_page", title=F.col("title"), text=F.col("text")), client, True)
    met = told.filter(yes(F.col("reply"))).groupBy("doc_id", "pos", "title", "page").agg(F.min("page_no").alias("physical_index"))
    offsets = outline.page_offset(met, "pos")
    return outline.shifted(items, offsets)


def without_contents(pages: Pages, client: Client, max_tokens: int = 20_000) -> DataFrame:
    """doc_id, pos, structure, title, physical_index from tagged page groups, one after another in each document."""
    sized = pages.withColumn("token_count", tokens(F.col("text")))
    groups = packing.groups(sized, max_tokens, 1).filter("last >= first")
    tag = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
    spread = groups.select("doc_id", "group_no", F.explode(F.sequence(F.col("first") + 1, F.col("last") + 1)).alias("page_no"))
    parts = spread.join(pages, ["doc_id", "page_no"]).groupBy("doc_id", "group_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.concat(tag, F.lit("\n"), "text", F.lit("\n"), tag).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return outlined(parts, client)


def checked(items: DataFrame, pages: Pages, client: Client) -> DataFrame:
    """items with correct (the title is on its page), appear_start (it starts the page) and page_count."""
    counts = pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    on = items.join(pages.withColumnRenamed("page_no", "physical_index"), ["doc_id", "physical_index"], "left")
    here = called(on, F.when(F.col("text").isNotNull(), prompt_of("title_on_page", title=F.col("title"), text=F.col("text"))), client, True)
    here = here.withColumn("correct", yes(F.col("reply"))).drop("reply", "status")
    start = called(here, F.when(F.col("text").isNotNull(), prompt_of("title_starts_page", title=F.col("title"), text=F.col("text"))), client, True)
    return start.withColumn("appear_start", F.when(yes(F.col("reply")), "yes").otherwise("no")).drop("reply", "status", "text").join(counts, "doc_id")


def verdicts(items: DataFrame) -> DataFrame:
    """doc_id, accuracy, verdict of checked items."""
    return outline.accuracy(items.withColumn("answer", F.when(F.col("correct"), "yes").otherwise("no")))


def resolved(pages: Pages, client: Client, within: int = 3, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(items, status): outline items of each document, and doc_id, mode, accuracy, status.

    Contents with page numbers come first, then contents without them, whose entries are looked for on the pages.
    Documents whose check is accepted keep them, those above 0.6 are repaired, and the rest go on to the next mode, at
    last to that without contents; a document that fails there too has the status error and no items, and the others
    go on.
    """
    contents = kept(contents_text(pages, contents_run(pages, client, within)))
    listed = kept(contents_items(contents, client))
    counts = pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    numbered = outline.within_pages(by_offset(listed, pages, client), counts).select("doc_id", "pos", "structure", "title", "physical_index")
    first = kept(checked(kept(numbered), pages, client))
    good = verdicts(first).filter("verdict <> 'next'").select("doc_id", "accuracy", F.lit("contents").alias("mode"))
    good = kept(good)
    bare = kept(checked(located(unnumbered_items(contents, client), pages, client).select("doc_id", "pos", "structure", "title", "physical_index"), pages, client))
    well = kept(verdicts(bare).filter("verdict <> 'next'").select("doc_id", "accuracy", F.lit("contents without pages").alias("mode")))
    good = good.unionByName(well)
    first = first.unionByName(bare)
    rest = pages.join(good.select("doc_id"), "doc_id", "left_anti")
    second = kept(checked(kept(without_contents(rest, client)), pages, client))
    fair = verdicts(second).filter("verdict <> 'next'").select("doc_id", "accuracy", F.lit("no contents").alias("mode"))
    fair = kept(fair)
    modes = good.unionByName(fair)
    both = first.join(good.select("doc_id"), "doc_id", "left_semi").unionByName(second.join(fair.select("doc_id"), "doc_id", "left_semi"))
    items = repaired(both, pages, client, rounds).select("doc_id", "pos", "structure", "title", "physical_index", "appear_start")
    status = pages.select("doc_id").distinct().join(modes, "doc_id", "left").withColumn("status", F.when(F.col("mode").isNull(), "error").otherwise("ok"))
    return items.filter("physical_index IS NOT NULL"), status


def expanded(nodes: DataFrame, pages: Pages, client: Client, max_pages: int, max_tokens: int) -> DataFrame:
    """doc_id, parent_id, pos, structure, title, physical_index: outlines of the nodes that are too large.

    A first title that repeats the node's own is left out. Run again on the new nodes until there are none.
    """
    large = tree.oversized(nodes, max_pages, max_tokens).select("doc_id", "node_id", F.col("title").alias("_title"), "start_index", "end_index")
    key = F.concat_ws("/", F.col("doc_id").cast("string"), "node_id")
    held = large.select("doc_id", "node_id", "_title", F.explode(F.sequence("start_index", "end_index")).alias("page_no")).join(pages, ["doc_id", "page_no"])
    numbered = large.select("doc_id", "node_id", "_title", F.xxhash64(key).alias("part_id"))
    inner = held.join(numbered.select("doc_id", "node_id", "part_id"), ["doc_id", "node_id"]).select(F.col("part_id").alias("doc_id"), "page_no", "text")
    tag = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
    parts = inner.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.concat(tag, "text", tag).alias("t")))), lambda x: x["t"]), "\n\n").alias("text")).withColumn("group_no", F.lit(0))
    found = outlined(parts, client).withColumnRenamed("doc_id", "part_id").join(numbered, "part_id")
    own = (F.col("pos") == 0) & F.col("title").eqNullSafe(F.col("_title"))
    return found.filter(~own).select("doc_id", F.col("node_id").alias("parent_id"), "pos", "structure", "title", "physical_index")


def block_outline(blocks: DataFrame, client: Client, max_tokens: int = 20_000) -> DataFrame:
    """doc_id, pos, structure, title, start_block_no: outline items over tagged blocks, rising and within the blocks."""
    groups = packing.groups(blocks.select("doc_id", "block_no", "token_count"), max_tokens, 2, True, "block_no")
    tag = F.concat(F.lit("<block_"), F.col("block_no").cast("string"), F.lit(">"))
    spread = groups.select("doc_id", "group_no", F.explode(F.sequence(F.col("first") + 1, F.col("last") + 1)).alias("block_no"))
    parts = spread.join(blocks.select("doc_id", "block_no", "normalized_text"), ["doc_id", "block_no"]).groupBy("doc_id", "group_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", F.concat(tag, "normalized_text", tag).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    items = outlined(parts, client).withColumnRenamed("physical_index", "start_block_no")
    bounds = blocks.groupBy("doc_id").agg(F.min("block_no").alias("_lo"), F.max("block_no").alias("_hi"))
    held = items.join(bounds, "doc_id").filter("start_block_no BETWEEN _lo AND _hi").drop("_lo", "_hi")
    return outline.rising(held, "start_block_no", ["pos"])


