"""Blocks and nodes: which node a block belongs to, and which text a node covers.

A node's range is unfolded to the places it covers, so all joins are equi-joins on document and place, and the choice
between nodes is one aggregation over nodes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AFTER_ALL = 2_000_000_000


def deepest(nodes: DataFrame, start: str = "start_index", end: str = "end_index", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, place, node_id: the deepest node that covers the place, the first in pre-order of equal depth."""
    spread = nodes.filter(F.col(start) <= F.col(end)).select(doc, pos, "depth", "node_id", F.explode(F.sequence(start, end)).alias("place"))
    return spread.groupBy(doc, "place").agg(F.min_by("node_id", F.struct(-F.col("depth"), F.col(pos))).alias("node_id"))


def first_match(nodes: DataFrame, start: str = "start_index", end: str = "end_index", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, place, node_id as a descent finds it: of the siblings that cover the place the first that has a covering child
    is entered, else the last is taken; nodes under an ancestor that does not cover the place are not reached.

    Compared as arrays, the places of the ancestors followed by a large number less the own place put the node that the
    descent ends at first. A node is reached within the intersection of its own and its ancestors' ranges.
    """
    own = nodes.select(doc, F.col(pos).alias("_p"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    reach = nodes.select(doc, pos, F.explode(F.concat("path", F.array(pos))).alias("_p")).join(own, [doc, "_p"]).groupBy(doc, pos).agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    key = F.concat("path", F.array((F.lit(_AFTER_ALL) - F.col(pos)).cast(nodes.schema[pos].dataType)))
    spread = nodes.join(reach, [doc, pos]).filter("_a <= _b").select(doc, "node_id", key.alias("key"), F.explode(F.sequence("_a", "_b")).alias("place"))
    return spread.groupBy(doc, "place").agg(F.min_by("node_id", "key").alias("node_id"))


def linked(blocks: DataFrame, places: DataFrame, place: str = "page_no", doc: str = "doc_id") -> DataFrame:
    """blocks with node_id, null where no node covers them."""
    return blocks.join(places.withColumnRenamed("place", place), [doc, place], "left")


def node_text(nodes: DataFrame, units: DataFrame, start: str, end: str, unit: str, order: list[str], text: str = "text", separator: str = "", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """nodes with node_text: the units (pages, blocks or lines) of its range in order, joined; null where there are none."""
    spread = nodes.filter(F.col(start) <= F.col(end)).select(doc, pos, F.explode(F.sequence(start, end)).alias(unit))
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    found = spread.join(units.select(doc, *dict.fromkeys([unit, *order]), text), [doc, unit]).groupBy(doc, pos).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), separator).alias("node_text"))
    return nodes.join(found, [doc, pos], "left")


def block_pages(nodes: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """nodes (start_block, end_block) with start_index and end_index: the pages of those blocks."""
    page = lambda at, name: blocks.select(doc, F.col("block_no").alias(at), F.col("page_no").alias(name))
    return nodes.join(page("start_block", "start_index"), [doc, "start_block"], "left").join(page("end_block", "end_index"), [doc, "end_block"], "left")


def suppressed(blocks: DataFrame, tables: DataFrame, share: float = 0.3, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Blocks that no table of their page covers by more than the share; header tables also stand for images.

    blocks: doc, page_no, kind, bbox; tables: doc, page_no, bbox, is_page_header.
    """
    from folioscope.functions.tables import overlap

    t = tables.select(F.col(doc).alias("_d"), F.col(page).alias("_g"), F.col("bbox").alias("_box"), "is_page_header")
    covers = (F.col(doc) == F.col("_d")) & (F.col(page) == F.col("_g")) & (overlap(F.col("bbox"), F.col("_box")) > share)
    return blocks.join(t, covers & ((F.col("kind") == "text") | F.col("is_page_header")), "left_anti")
