"""Lines, pages and blocks with numbers and exact character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import drop_artifacts, strip, tokens


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_num (from 1), text of each line; a null text has one empty line."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("p", "text")).select(doc, (F.col("p") + 1).alias("line_num"), "text")


def pages_of_lines(docs: DataFrame, per_page: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with the page they stand on, per_page lines each: doc, page_no, line_num, text."""
    return lines(docs, doc, text).select(doc, F.expr(f"CAST((line_num - 1) DIV {per_page} + 1 AS INT)").alias("page_no"), "line_num", "text")


def word_blocks(items: DataFrame, doc: str = "doc_id", section: str = "section_ordinal", order: str = "line_num", text: str = "text") -> DataFrame:
    """Numbered blocks of stripped non-empty items; offsets count one separator between all blocks of a document.

    doc, block_no, page_no (the section), block_order_in_page, normalized_text, char_start_in_doc, char_end_in_doc,
    char_start_in_page, char_end_in_page (ends inclusive), token_count. One shuffle by document serves both windows.
    """
    kept = items.select(doc, F.col(section).alias("page_no"), F.col(order).alias("o"), strip(F.coalesce(F.col(text), F.lit(""))).alias("normalized_text")).filter("length(normalized_text) > 0")
    by_doc, by_page = Window.partitionBy(doc).orderBy("o"), Window.partitionBy(doc, "page_no").orderBy("o")
    size = F.length("normalized_text")
    before = lambda w: F.coalesce(F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumns({"block_no": F.row_number().over(by_doc), "char_start_in_doc": before(by_doc), "block_order_in_page": F.row_number().over(by_page), "char_start_in_page": before(by_page)})
    return _ends(placed, doc)


def pdf_blocks(items: DataFrame, doc: str = "doc_id", page: str = "page_no", order: str = "line_num", text: str = "text") -> DataFrame:
    """As word_blocks, but with a separator between blocks of one page only; blocks that normalise to nothing stay."""
    kept = items.select(doc, F.col(page).alias("page_no"), F.col(order).alias("o"), strip(drop_artifacts(F.col(text))).alias("normalized_text"))
    by_doc, by_page = Window.partitionBy(doc).orderBy("page_no", "o"), Window.partitionBy(doc, "page_no").orderBy("o")
    size = F.length("normalized_text")
    cumulated = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumns({"block_order_in_page": F.row_number().over(by_page), "last": F.lead("o").over(by_page).isNull(), "char_start_in_page": cumulated(by_page, size + 1)})
    placed = placed.withColumns({"block_no": F.row_number().over(by_doc), "char_start_in_doc": cumulated(by_doc, size + F.when(F.col("last"), 0).otherwise(1))})
    return _ends(placed, doc)


def _ends(placed: DataFrame, doc: str) -> DataFrame:
    size = F.length("normalized_text")
    end = lambda c: F.greatest(F.col(c), F.col(c) + size - 1).alias(c.replace("start", "end"))
    return placed.select(
        doc, "block_no", "page_no", "block_order_in_page", "normalized_text",
        "char_start_in_doc", end("char_start_in_doc"), "char_start_in_page", end("char_start_in_page"),
        tokens(F.col("normalized_text")).alias("token_count"),
    )


def block_stats(blocks: DataFrame, mode: str = "word", doc: str = "doc_id") -> DataFrame:
    """doc, block_count, char_count, token_count; pdf counts separators (last end + 1), word does not."""
    chars = F.sum(F.length("normalized_text")) if mode == "word" else F.max_by("char_end_in_doc", "block_no") + 1
    return blocks.groupBy(doc).agg(F.count(F.lit(1)).alias("block_count"), chars.alias("char_count"), F.sum("token_count").alias("token_count"))


def section_ordinals(items: DataFrame, heading, order: str, doc: str = "doc_id") -> DataFrame:
    """items with section_ordinal: headings so far, plus one where a document starts without a heading."""
    by = Window.partitionBy(doc).orderBy(order)
    n = F.sum(F.when(heading, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    bare = F.first(F.when(heading, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return items.withColumn("section_ordinal", (n + bare).cast("int"))


def page_text(pages: DataFrame, labelled: bool = False, doc: str = "doc_id") -> DataFrame:
    """doc, text: pages in order without separators, or each between its <physical_index_N> tags."""
    tag = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
    text = F.concat(tag, F.lit("\n"), "text", F.lit("\n"), tag, F.lit("\n\n")) if labelled else F.col("text")
    parts = F.sort_array(F.collect_list(F.struct("page_no", text.alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def page_order(items: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """items with item_no by rounded top, then left edge; those without a box last, text before tables on ties."""
    at = lambda i: F.bround(F.try_element_at("bbox", F.lit(i)), 2).asc_nulls_last()
    by = Window.partitionBy(doc, page).orderBy(at(2), at(1), F.when(F.col("kind") == "table", 1).otherwise(0), "pos")
    return items.withColumn("item_no", F.row_number().over(by))
