"""Greedy packing of pages or blocks into prompt-sized groups, as one pass over units in order."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def groups(units: DataFrame, max_tokens: int = 20_000, overlap: int = 1, guard: bool = False, order: str = "page_no", doc: str = "doc_id") -> DataFrame:
    """doc, group_no, first, last (positions from 0): runs of units of at most the average size, overlapping by `overlap`.

    All units are one group if they fit max_tokens. Otherwise the average is ceil((total / ceil(total / max) + max) / 2),
    and a group is closed before the unit that would pass it; the next starts `overlap` units earlier. Without guard a
    first unit above the average closes an empty group (last = -1), which pages keep; blocks are packed with guard.
    A null count is no tokens. Units stream by in order: no more than `overlap` of them are held, however long a document is.
    """
    size = F.coalesce(F.col("token_count").cast("long"), F.lit(0))
    by = Window.partitionBy(doc).orderBy(order, "token_count")
    sized = units.select(doc, size.alias("_size"), F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"), F.row_number().over(by).alias("_place"))

    names = [doc, "group_no", "first", "last"]

    def made(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, *[pa.int32()] * 3), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, at, number, start, held, average, before = None, -1, 0, 0, 0, None, deque(maxlen=overlap)
        for batch in batches:
            out = []
            for key, size, total, place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 1:
                    if at >= 0:
                        out.append((d, number, start, at))
                    d, number, start, held = key, 0, 0, 0
                    before.clear()
                    average = math.ceil((total / math.ceil(total / max_tokens) + max_tokens) / 2) if total > max_tokens else None
                at = place - 1
                if average is not None:
                    if held + size > average and (start < at or not guard):
                        out.append((d, number, start, at - 1))
                        number, start, held = number + 1, max(at - overlap, 0), sum(before)
                    held += size
                    before.append(size)
            yield made(out, batch.column(0).type)
        if at >= 0:
            yield made([(d, number, start, at)], batch.column(0).type)

    schema = StructType([StructField(doc, units.schema[doc].dataType), *(StructField(n, IntegerType()) for n in names[1:])])
    return sized.mapInArrow(run, schema)  # in the order in which the window leaves them
