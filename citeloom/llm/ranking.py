"""A running number over a whole table, without one task or the driver seeing all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import Scratch


def numbered(scratch: Scratch, rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``number``, from 1 in the given order: dealt by ranges, numbered inside each, and shifted by the sizes of the ranges before.

    The dealt table is written, so that the sizes and the numbers are of the same ranges. Only one row per range reaches the driver.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            numbers = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at + 1, at + n + 1))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], [*batch.schema.names, "_part", "_k"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.keep(dealt.mapInArrow(run, fields + ", _part bigint, _k bigint"), "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.max("_k").alias("n")).collect())  # one row per range
    before, shift = 0, []
    for part, n in sizes:
        shift.append((part, before))
        before += n
    shifts = rows.sparkSession.createDataFrame(shift, "_p long, _before long")
    joined = held.join(F.broadcast(shifts), F.col("_part") == F.col("_p"))
    return joined.withColumn("number", F.col("_before") + F.col("_k")).drop("_part", "_k", "_p", "_before")
