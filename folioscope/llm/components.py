"""Connected components of a link table by alternating large-star and small-star rounds; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _open(edges: DataFrame) -> int:
    """How many nodes have a smaller neighbour and yet another one: none once all edges are stars around their smallest nodes.

    For then a node with a smaller neighbour has no other, and that neighbour, having a greater one, has no smaller one.
    """
    return _both(edges).groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).filter("m < a AND n > 1").count()


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """node, component (the smallest node that it is linked to, over any path) of every node that has a link.

    Self links and repeated links count once. A node with very many links is never gathered: stars take the smallest
    neighbour by partial aggregation, and joins on hubs can be split. Links that are stars already, as those that an
    earlier call returned, take no round. Joins are by merging, so the driver holds no table of a round, however small.
    tables: what holds the tables of the rounds.
    """
    cut_ = tables.cut if tables else cut
    e = cut_(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "links")
    while _open(e):
        both = _both(e)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = cut_(small.filter("a != b").distinct(), "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
