"""Indexing plans: options, and the trees and blocks of Markdown, Word and paged documents."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import tokens
from folioscope.operators import blocks as B
from folioscope.operators import enrich, export, link, outline, tree
from folioscope.sources.files import markdown_nodes


@dataclass(frozen=True)
class Options:
    """Fixed values are defaults; unknown names and wrong types raise."""

    toc_check_pages: int = 3
    max_pages_per_node: int = 20
    max_tokens_per_node: int = 512
    node_ids: bool = True
    summaries: bool = False
    description: bool = False
    node_text: bool = False
    thinning: bool = False
    thinning_tokens: int = 5000
    summary_tokens: int = 200
    block_pages: int = 35
    group_tokens: int = 20_000

    @classmethod
    def of(cls, raw: dict | None = None) -> Options:
        raw = raw or {}
        known = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(raw) - set(known)):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        for k, v in raw.items():
            if v in ("yes", "no") and known[k] is bool:
                raw = {**raw, k: v == "yes"}
            elif type(v) is not known[k]:
                raise TypeError(f"{k} takes {known[k].__name__}")
        return cls(**raw)


def markdown_tree(docs: DataFrame, options: Options | None = None, client: enrich.Client | None = None) -> DataFrame:
    """Nodes of Markdown documents (doc_id, text): title, level, line_num, text, token_count, path, parent_pos, depth, node_id."""
    options = options or Options()
    heads = markdown_nodes(docs)
    texts = link.node_text(heads.withColumnRenamed("line_num", "start"), B.lines(docs).withColumnRenamed("line_num", "line"), "start", "end_line", "line", ["line"], separator="\n")
    nodes = texts.select("doc_id", "pos", "level", "title", F.col("start").alias("line_num"), F.regexp_replace("node_text", r"(?U)^\s+|\s+$", "").alias("text"))
    found = tree.level_tree(nodes, [1, 2, 3, 4, 5, 6])
    if options.thinning:
        kept = tree.thinned(found, options.thinning_tokens).select("doc_id", "pos", "level", "title", "line_num", "text")
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
        found = tree.level_tree(kept.withColumn("pos", number), [1, 2, 3, 4, 5, 6])
    found = found.withColumn("token_count", tokens(F.col("text")))
    if options.summaries:
        found = enrich.summarised(found, client, options.summary_tokens)
    return found


def word_index(items: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, blocks) of body items (doc_id, item_no, kind, level, text).

    Text before the first heading is section 1 under a node with the document's name (names: doc_id, doc_name).
    """
    cut = B.section_ordinals(items, F.col("kind") == "heading", "item_no")
    body = cut.filter("kind <> 'heading'").groupBy("doc_id", "section_ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    heads = cut.filter("kind = 'heading'").select("doc_id", "section_ordinal", "level", F.col("text").alias("title"), F.col("item_no").alias("line_num"))
    bare = cut.filter("section_ordinal = 1").join(heads.filter("section_ordinal = 1").select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("item_no").alias("line_num"))
    bare = bare.join(names, "doc_id").select("doc_id", F.lit(1).alias("section_ordinal"), F.lit(1).alias("level"), F.col("doc_name").alias("title"), "line_num")
    nodes = heads.unionByName(bare).join(body, ["doc_id", "section_ordinal"], "left")
    levels = [r[0] for r in nodes.select("level").distinct().orderBy("level").collect()]  # levels of headings, not rows
    nodes = nodes.select("doc_id", F.col("section_ordinal").alias("pos"), "level", "title", "line_num", F.coalesce("text", F.lit("")).alias("text"), F.col("section_ordinal").alias("start_index"), F.col("section_ordinal").alias("end_index"))
    found = tree.widened(tree.level_tree(nodes, levels))
    numbered = B.word_blocks(cut.withColumnRenamed("item_no", "line_num"))
    return found, link.linked(numbered, link.deepest(found))


def outline_tree(items: DataFrame, pages: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Nodes of paged documents from outline items (doc_id, pos, structure, title, physical_index, appear_start).

    A preface is put before a late first item; ranges follow from the next items; codes give the tree. Unless
    strict_parity, parents are widened to cover their children.
    """
    counts = pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    ranged = outline.page_ranges(outline.with_preface(items), counts)
    found = tree.code_tree(ranged)
    return found if strict_parity else tree.widened(found)


def paged_index(pages: DataFrame, items: DataFrame, options: Options | None = None, client: enrich.Client | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, blocks) of pages (doc_id, page_no, line_num, text) under an outline; blocks link by descent."""
    options = options or Options()
    nodes = outline_tree(items, pages)
    numbered = B.pdf_blocks(pages)
    whole = pages.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_num", "text"))), lambda x: x["text"]), "\n").alias("text"))
    if options.node_text or options.summaries:
        nodes = link.node_text(nodes, whole, "start_index", "end_index", "page_no", ["page_no"]).withColumnRenamed("node_text", "text")
    if options.summaries:
        nodes = enrich.summarised(nodes.withColumn("token_count", tokens(F.col("text"))), client, None)
    return nodes, link.linked(numbered, link.first_match(nodes))


def results(nodes: DataFrame, names: DataFrame, stats: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """doc_id, result: the JSON of each document."""
    options = options or Options()
    shown = export.visible(nodes, options.node_ids, options.summaries, options.node_text)
    return export.results(tree.nested_json(nodes, shown), names, stats)
