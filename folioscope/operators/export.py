"""Results as JSON: options, visible fields, counts and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(tree: DataFrame, node_ids: bool = True, summaries: bool = True, text: bool = False, ranges: bool = True) -> list[str]:
    """The fields of a node that the options show, of those that the tree has, in order."""
    wanted = ["title", *["node_id"] * node_ids, *["start_index", "end_index"] * ranges, *["line_num"], *["summary", "prefix_summary"] * summaries, *["text"] * text]
    return [c for c in wanted if c in tree.columns]


def results(structures: DataFrame, names: DataFrame, stats: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """doc, result: JSON with doc_name, counts, description and structure; null keys are left out.

    names: doc, doc_name and maybe doc_description, location_unit; stats: doc, page_count, char_count, token_count or some.
    """
    joined = structures.join(names, doc)
    if stats is not None:
        joined = joined.join(stats, doc, "left")
    keys = [c for c in ("doc_name", "doc_description", "page_count", "char_count", "token_count", "location_unit") if c in joined.columns]
    head = F.regexp_replace(F.to_json(F.struct(*keys)), r"\}$", "")
    return joined.select(doc, F.concat(head, F.lit(',"structure":'), "structure", F.lit("}")).alias("result"))


def content_images(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks that name an attachment and its file, page and block."""
    need = ["attachment_id", "file_name", "page_no", "block_no"]
    return blocks.dropna(subset=need).filter("attachment_id <> '' AND file_name <> ''").select(doc, *need)


def write_results(results_: DataFrame, path: str) -> None:
    """One JSON document per line."""
    results_.select(F.col("result").alias("value")).write.mode("error").text(path)
