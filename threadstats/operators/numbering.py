"""Positions of rows and running sums in a global order, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.storage import written

# A row number made by Spark holds the partition above this many bits.
_PARTITION_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add a ``name`` column that counts 0, 1, 2 ... in the given order.

    Rows are cut into ranges, sorted within them and written; the offset of a
    range is the number of rows before it.  Only one number per range is
    collected.  Rows that tie in the order are numbered in any order, and all
    of them lie in one range: name enough columns to tell rows apart.
    """
    number = F.monotonically_increasing_id()
    ranged = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", number), "numbered"
    )
    part = F.shiftright("__row", _PARTITION_BITS)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["part"], before - (row["part"] << _PARTITION_BITS)))
        before += row["n"]
    table = rows.sparkSession.createDataFrame(offsets, "part bigint, shift bigint")
    # One row per range.
    placed = ranged.join(F.broadcast(table), part == F.col("part"))
    return placed.select(*rows.columns, (F.col("__row") + F.col("shift")).alias(name))


def running_sum(rows: DataFrame, order: Sequence[str | Column], value: str, name: str = "running") -> DataFrame:
    """Add the sum of an integer column over the row itself and all rows before it in the given order.

    As ``numbered``: ranges are summed by themselves and written, and moved by the sums of
    the ranges before them.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, count = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sums = before + np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(sums):
                before = int(sums[-1])
            places = count + np.arange(len(sums))
            count += len(sums)
            yield pa.record_batch(
                [*batch.columns, pa.array(sums), pa.array(places), pa.array(np.full(len(sums), part))],
                [*batch.schema.names, name, "__place", "__part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.mapInArrow(summed, f"{kinds}, `{name}` bigint, __place bigint, __part bigint"), "running")
    sizes = ranged.groupBy("__part").agg(F.max_by(name, "__place").alias("total")).orderBy("__part").collect()
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["__part"], before))
        before += row["total"]
    table = rows.sparkSession.createDataFrame(offsets, "__part bigint, __shift bigint")
    # One row per range.
    placed = ranged.join(F.broadcast(table), "__part")
    return placed.select(*rows.columns, (F.col(name) + F.col("__shift")).alias(name))


def first_rows(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in the given order, as they are; null keys come first.

    Counts per value of the first key find the value at which the n-th row lies.  Rows before
    it are taken by a filter; only the rows of that value are put in order.
    """
    key, rest = order[0], list(order[1:])
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    reached = running_sum(counts, [key], "__n", "__reached")
    cut = reached.filter(F.col("__reached") >= n).agg(
        F.min(F.struct("__reached", F.col(key).alias("value"), "__n")).alias("cut")).first()["cut"]
    if n <= 0:
        return rows.limit(0)
    if cut is None:  # there are no more than n rows
        return rows
    value = F.lit(cut["value"])
    inside = rows.filter(F.col(key).eqNullSafe(value))
    wanted = n - (cut["__reached"] - cut["__n"])
    if wanted < cut["__n"]:
        inside = numbered(inside, rest or [key], "__position").filter(F.col("__position") < wanted).drop("__position")
    before = F.lit(False) if cut["value"] is None else F.col(key).isNull() | (F.col(key) < value)
    return rows.filter(before).unionByName(inside)
