"""A bounded sample of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id reads as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def sampled(labels: DataFrame, label: str, mod: int, held_out: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` ids with their label (the largest of repeated ones), by hash of the id; none of the held-out part."""
    return (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, mod) != held_out))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )


def joined(table: DataFrame, sample: DataFrame, *columns: str) -> DataFrame:
    """id, label and the columns of one row of table for each id that the sample labels: the smallest, where ids repeat."""
    # The sample has at most `rows` ids, so it is small enough to send to every task at any size of the corpus.
    held = table.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct(*columns)).alias("r"))
    return held.select("id", "label", *(f"r.{c}" for c in columns))
