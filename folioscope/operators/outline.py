"""Outlines: runs of contents pages, page offsets, ranges, repair bounds and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_run(pages: DataFrame, answer: str, order: str, within: int, doc: str = "doc_id") -> DataFrame:
    """The first run of "yes" pages that starts among the first `within`; it may go on past them.

    Answers other than yes and no neither extend nor end a run. doc, start, end, pages.
    """
    by = Window.partitionBy(doc).orderBy(order)
    counted = pages.filter(F.col(answer).isin("yes", "no")).withColumn("_n", F.sum(F.when(F.col(answer) == "no", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = counted.filter(F.col(answer) == "yes").groupBy(doc, "_n").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("pages"))
    ok = runs.filter(F.col("start") < within)
    return ok.groupBy(doc).agg(F.min(F.struct("start", "end", "pages")).alias("r")).select(doc, "r.*")


def runs(pages: DataFrame, answer: str, order: str, doc: str = "doc_id") -> DataFrame:
    """All runs of yes: doc, start, end, pages."""
    by = Window.partitionBy(doc).orderBy(order)
    counted = pages.filter(F.col(answer).isin("yes", "no")).withColumn("_n", F.sum(F.when(F.col(answer) == "no", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.filter(F.col(answer) == "yes").groupBy(doc, "_n").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("pages")).drop("_n")


def matching_pairs(printed: DataFrame, physical: DataFrame, start_page: int, doc: str = "doc_id") -> DataFrame:
    """doc, title, page, physical_index of items of the same title (null equals null) from start_page on; repeats multiply."""
    p = printed.select(F.col(doc).alias("_d"), F.col("title").alias("_t"), "page")
    held = physical.filter(F.col("physical_index") >= start_page)
    return held.join(p, (F.col(doc) == F.col("_d")) & F.col("title").eqNullSafe(F.col("_t"))).select(doc, "title", "page", "physical_index")


def page_offset(pairs: DataFrame, order: str, doc: str = "doc_id") -> DataFrame:
    """doc, page_offset: the most frequent difference of physical and printed page, the first seen of equal ones, the smaller of those seen together."""
    diffs = pairs.filter("physical_index IS NOT NULL AND page IS NOT NULL").groupBy(doc, (F.col("physical_index") - F.col("page")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return diffs.groupBy(doc).agg(F.min_by("d", F.struct(-F.col("n"), F.col("o"), F.col("d"))).alias("page_offset"))


def shifted(items: DataFrame, offsets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """items with physical_index = printed page + offset."""
    return items.join(offsets, doc, "left").withColumn("physical_index", F.col("page") + F.col("page_offset")).drop("page_offset")


def within_pages(items: DataFrame, counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """items whose physical_index is null where it is after the last page (counts: doc, page_count)."""
    return items.join(counts, doc).withColumn("physical_index", F.when(F.col("physical_index") <= F.col("page_count"), F.col("physical_index"))).drop("page_count")


def with_preface(items: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """items (doc, pos, structure, title, physical_index) and a Preface at page 1 where the first starts later."""
    first = items.groupBy(doc).agg(F.min_by("physical_index", pos).alias("f"), F.min(pos).alias("p")).filter("f > 1")
    row = first.select(doc, (F.col("p") - 1).alias(pos), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).cast(items.schema["physical_index"].dataType).alias("physical_index"))
    return items.unionByName(row, allowMissingColumns=True)


def page_ranges(items: DataFrame, counts: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """items with start_index and end_index: to the page before the next item if that starts its page, else to its page."""
    by = Window.partitionBy(doc).orderBy(pos)
    follow, starts = F.lead("physical_index").over(by), F.lead("appear_start").over(by) == "yes"
    end = F.when(F.lead(pos).over(by).isNull(), F.col("page_count")).when(F.coalesce(starts, F.lit(False)), F.greatest(follow - 1, F.col("physical_index"))).otherwise(follow)
    return items.join(counts, doc).withColumns({"start_index": F.col("physical_index"), "end_index": end}).drop("page_count")


def block_ranges(items: DataFrame, counts: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """items (start_block_no) with start_block and end_block: up to the next item's block, or the last (counts: max_block)."""
    by = Window.partitionBy(doc).orderBy(pos)
    return items.join(counts, doc).withColumns({"start_block": F.col("start_block_no"), "end_block": F.coalesce(F.lead("start_block_no").over(by) - 1, F.col("max_block"))}).drop("max_block")


def rising(items: DataFrame, value: str, order: list[str], low: Column | None = None, high: Column | None = None, doc: str = "doc_id") -> DataFrame:
    """items whose value lies in the bounds and is above all kept before it, which is above the running maximum."""
    kept = items.filter(F.col(value).isNotNull())
    if low is not None:
        kept = kept.filter(F.col(value) >= low)
    if high is not None:
        kept = kept.filter(F.col(value) <= high)
    before = F.max(value).over(Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("_m", before).filter(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def repair_bounds(items: DataFrame, wrong: Column, first_page: int = 1, doc: str = "doc_id", pos: str = "pos", index: str = "physical_index") -> DataFrame:
    """Wrong items with low and high: the indexes of the nearest items before and after that are not wrong.

    The nearest counts even where its index is null. Without one: first_page and the last page (column page_count).
    """
    by = Window.partitionBy(doc).orderBy(pos)
    right = F.when(~wrong, F.struct(F.col(index).alias("i")))
    low = F.last(right, True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    high = F.last(right, True).over(Window.partitionBy(doc).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1))
    marked = items.withColumns({"_lo": low, "_hi": high, "_wrong": wrong})
    return marked.filter("_wrong").withColumns({"low": F.when(F.col("_lo").isNull(), F.lit(first_page)).otherwise(F.col("_lo.i")), "high": F.when(F.col("_hi").isNull(), F.col("page_count")).otherwise(F.col("_hi.i"))}).drop("_lo", "_hi", "_wrong")


def accuracy(checks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, accuracy (share of yes; 0 where the last index is below half of page_count), verdict by 1 and 0.6.

    verdict: accept, repair or next.
    """
    share = F.avg(F.when(F.col("answer") == "yes", 1.0).otherwise(0.0))
    last = F.max_by("physical_index", F.when(F.col("physical_index").isNotNull(), F.col(pos)))
    found = checks.groupBy(doc).agg(F.when(F.coalesce(last, F.lit(0)) < F.max("page_count") / 2, F.lit(0.0)).otherwise(share).alias("accuracy"))
    return found.withColumn("verdict", F.when(F.col("accuracy") == 1.0, "accept").when(F.col("accuracy") > 0.6, "repair").otherwise("next"))


def header_tables(tables: DataFrame, doc: str = "doc_id", pages: int = 2) -> DataFrame:
    """tables (cells, bbox, page_height, page_no) with is_page_header: its structure key stands at the top of two pages.

    Documents with tables on fewer than two pages have none.
    """
    from folioscope.functions.tables import at_top, structure_key

    keyed = tables.withColumn("_key", structure_key(F.col("cells")))
    several = keyed.groupBy(doc).agg(F.count_distinct("page_no").alias("n")).filter(F.col("n") >= pages).select(doc)
    heads = keyed.filter(at_top(F.col("bbox"), F.col("page_height"))).groupBy(doc, "_key").agg(F.count_distinct("page_no").alias("n")).filter(F.col("n") >= pages)
    heads = heads.join(several, doc, "left_semi").select(doc, "_key", F.lit(True).alias("is_page_header"))
    return keyed.join(heads, [doc, "_key"], "left").withColumn("is_page_header", F.coalesce("is_page_header", F.lit(False))).drop("_key")
