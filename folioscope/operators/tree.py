"""Trees as flat tables: parents, paths, subtree ranges, ids, widening, thinning and nesting.

Levels of a level tree are few, so one running window with the last place of each level gives every ancestor at once: the
last place at level L is an ancestor if and only if it comes after the last places of all smaller levels. No recursion
and no join is needed, and descendants are the places from a node's own to its subtree_end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import code_level, parent_code, tokens


def level_tree(nodes: DataFrame, levels: list[int], doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """nodes (doc, pos, level) with path array (places of the ancestors, root first), parent_pos, depth, subtree_end, node_id.

    levels: all levels that occur. Parent: the nearest node before with a smaller level; equal levels are siblings.
    """
    ordered = sorted(levels)
    by, back = Window.partitionBy(doc).orderBy(pos), Window.partitionBy(doc).orderBy(F.desc(pos))
    # Running frames from either end: a frame that reaches to the end is computed anew for every row.
    past, rest = by.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    marks = {f"_last{i}": F.last(F.when(F.col("level") == v, F.col(pos)), True).over(past) for i, v in enumerate(ordered)}
    marks |= {f"_next{i}": F.last(F.when(F.col("level") <= v, F.col(pos)), True).over(rest) for i, v in enumerate(ordered)}
    marks |= {"_end": F.max(pos).over(Window.partitionBy(doc)), "_n": F.row_number().over(by)}
    placed = nodes.withColumns(marks)
    path = []
    for i, v in enumerate(ordered):
        mine, smaller = F.col(f"_last{i}"), [F.col(f"_last{j}") for j in range(i)]
        after = reduce(lambda a, b: a & b, [F.coalesce(mine > s, F.lit(True)) for s in smaller], F.lit(True))
        path.append(F.when((F.lit(v) < F.col("level")) & mine.isNotNull() & after, mine))
    ends = reduce(lambda e, i: F.when(F.col("level") == ordered[i], F.col(f"_next{i}")).otherwise(e), range(len(ordered)), F.lit(None))
    out = placed.withColumn("path", F.array_sort(F.array_compact(F.array(*path)))).withColumn("_follow", ends)
    return out.select(
        *nodes.columns,
        "path",
        F.try_element_at("path", F.lit(-1)).alias("parent_pos"),
        (F.size("path") + 1).alias("depth"),
        F.coalesce(F.col("_follow") - 1, F.col("_end")).alias("subtree_end"),
        F.format_string("%04d", F.col("_n") - 1).alias("node_id"),
    )


def code_tree(items: DataFrame, doc: str = "doc_id", pos: str = "pos", code: str = "structure") -> DataFrame:
    """items with parent_pos, path, depth and node_id from dotted codes.

    Parent: the last item before with the code less its last part; without one a root. Ids follow the tree, children
    in order, so they can differ from the order of the items.
    """
    seen = items.select(doc, F.col(pos).alias("_p"), F.col(code).alias("_c"))
    kids = items.select(doc, pos, parent_code(F.col(code)).alias("_c")).filter("_c IS NOT NULL")
    parents = kids.join(seen, [doc, "_c"]).filter(F.col("_p") < F.col(pos)).groupBy(doc, pos).agg(F.max("_p").alias("parent_pos"))
    tree = items.join(parents, [doc, pos], "left")
    most = items.agg(F.max(code_level(F.col(code)))).first()[0] or 1
    up = tree.select(doc, pos, F.col("parent_pos").alias("_up"), F.array(F.col(pos)).alias("_path"))
    links = tree.select(doc, F.col(pos).alias("_up"), F.col("parent_pos").alias("_next"))
    for _ in range(most - 1):  # as many steps as a code has parts
        up = up.join(links, [doc, "_up"], "left").select(doc, pos, F.col("_next").alias("_up"), F.when(F.col("_up").isNotNull(), F.concat(F.array("_up"), "_path")).otherwise(F.col("_path")).alias("_path"))
    full = tree.join(up.select(doc, pos, "_path"), [doc, pos])
    number = F.row_number().over(Window.partitionBy(doc).orderBy("_path")) - 1
    return full.select(*items.columns, "parent_pos", F.slice("_path", F.lit(1), F.size("_path") - 1).alias("path"), F.size("_path").alias("depth"), F.format_string("%04d", number).alias("node_id"))


def leaves(tree: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    inner = tree.filter("parent_pos IS NOT NULL").select(doc, F.col("parent_pos").alias(pos)).distinct()
    return tree.join(inner, [doc, pos], "left_anti")


def subtree_sums(tree: DataFrame, values: dict[str, Column], doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """tree with the sum of each value over a node and its descendants, from running sums at both ends of its range."""
    by = Window.partitionBy(doc).orderBy(pos)
    run = tree.withColumns({f"_v_{k}": v for k, v in values.items()}).withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(by.rowsBetween(Window.unboundedPreceding, 0)) for k in values})
    ends = run.select(doc, F.col(pos).alias("subtree_end"), *(F.col(f"_s_{k}").alias(f"_e_{k}") for k in values))
    return run.join(ends, [doc, "subtree_end"]).select(*tree.columns, *((F.col(f"_e_{k}") - F.col(f"_s_{k}") + F.col(f"_v_{k}")).alias(k) for k in values))


def widened(tree: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """tree with start_index and end_index widened to cover the descendants."""
    own = tree.select(doc, F.explode(F.concat("path", F.array(pos))).alias("_p"), "start_index", "end_index")
    ranges = own.groupBy(doc, F.col("_p").alias(pos)).agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"))
    return tree.drop("start_index", "end_index").join(ranges, [doc, pos]).select(tree.columns)


def subtree_tokens(tree: DataFrame, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """tree with text_token_count: tokens of a node's text and all its descendants' texts joined by line ends."""
    summed = subtree_sums(tree, {"_chars": F.length(F.coalesce(F.col(text), F.lit(""))) + 1}, doc, pos)
    n = F.col("_chars") - 1
    return summed.select(*tree.columns, F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.lit(0)).alias("text_token_count"))


def thinned(tree: DataFrame, least: int, text: str = "text", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """The nodes without a thin ancestor; a thin one that stays takes the texts below it, parted by blank lines.

    Thin: fewer than `least` tokens with all descendants.
    """
    counted = subtree_tokens(tree, text, doc, pos)
    thin = counted.filter(F.col("text_token_count") < least).select(doc, F.col(pos).alias("_up"))
    under = counted.select(doc, pos, F.explode("path").alias("_up")).join(thin, [doc, "_up"]).groupBy(doc, pos).agg(F.min("_up").alias("_top"))
    whole = counted.join(under, [doc, pos], "left")
    texts = whole.filter(F.col("_top").isNotNull() & (F.col(text) != "")).groupBy(doc, F.col("_top").alias(pos)).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("_below"))
    kept = whole.filter("_top IS NULL").join(texts, [doc, pos], "left")
    joined = F.concat_ws("\n\n", F.nullif(F.col(text), F.lit("")), F.array_join(F.transform("_below", lambda x: x["t"]), "\n\n"))
    return kept.withColumn(text, F.when(F.col("_below").isNotNull(), joined).otherwise(F.col(text))).select(counted.columns)


def oversized(tree: DataFrame, max_pages: int, max_tokens: int) -> DataFrame:
    """Nodes to expand: more than max_pages between start and end, and max_tokens or more."""
    return tree.filter((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("token_count") >= max_tokens))


def nested_json(tree: DataFrame, fields: list[str], doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, structure: a JSON array of nested nodes, the fields in order, without nulls; nodes only where there are any.

    Built from the deepest level up, one aggregation per level, since Spark has no recursive types.
    """
    depth = tree.agg(F.max("depth")).first()[0] or 0
    own = lambda: F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", "")
    below = None
    for d in range(depth, 0, -1):
        level = tree.filter(F.col("depth") == d)
        if below is not None:
            level = level.join(below.withColumnRenamed("parent_pos", pos), [doc, pos], "left")
            inner = F.when(F.col("nodes").isNotNull(), F.concat(F.lit(',"nodes":'), "nodes", F.lit("}"))).otherwise(F.lit("}"))
        else:
            inner = F.lit("}")
        items = level.select(doc, "parent_pos", F.col(pos), F.concat(own(), inner).alias("j"))
        below = items.groupBy(doc, "parent_pos").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("nodes"))
    if below is None:
        return tree.select(doc).distinct().withColumn("structure", F.lit("[]"))
    return below.select(doc, F.col("nodes").alias("structure"))


def breadcrumb(tree: DataFrame, title: str = "title", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """tree with crumbs: the titles of the ancestors and the node, root first."""
    steps = tree.select(doc, pos, F.posexplode(F.concat("path", F.array(pos))).alias("i", "_p"))
    names = tree.select(doc, F.col(pos).alias("_p"), F.col(title).alias("t"))
    found = steps.join(names, [doc, "_p"]).groupBy(doc, pos).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("crumbs"))
    return tree.join(found, [doc, pos])


def token_limit(tree: DataFrame, limit: int = 110_000, text: str = "text") -> DataFrame:
    """Nodes whose text has more tokens than a prompt may hold."""
    return tree.withColumn("token_count", tokens(F.col(text))).filter(F.col("token_count") > limit)


def last_node(tree: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, node_id, title: the last node of each tree."""
    return tree.groupBy(doc).agg(F.max_by(F.struct("node_id", "title"), pos).alias("n")).select(doc, "n.*")
