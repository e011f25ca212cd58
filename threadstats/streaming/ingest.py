"""Incremental ingest of dumped records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadstats.operators.entries import latest_by_id
from threadstats.storage import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", **options) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).format(kind).options(**options).load(path)


def first_of_each(records: DataFrame, ids: Sequence[str], created: str, delay: str) -> DataFrame:
    """Drop repeated ids; state is kept only as long as the watermark allows."""
    return records.withWatermark(created, delay).dropDuplicatesWithinWatermark(list(ids))


def append_to(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it as Parquet, and stop."""
    return (
        records.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def keep_latest(
    records: DataFrame, ids: Sequence[str], order: Sequence[str], target: str, checkpoint: str
) -> StreamingQuery:
    """Append each batch's last record per id below ``target``.

    Earlier batches are not rewritten; ``latest_records`` merges on reading.
    A batch that is repeated after a failure overwrites its own folder.
    """
    def append(batch: DataFrame, number: int) -> None:
        latest_by_id(batch, ids, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_changes(records: DataFrame, ids: Sequence[str], created: str, tie: str, delay: str) -> DataFrame:
    """The records that become the latest of their id, as they arrive; earlier winners may follow each other.

    An id's state is the key (created, tie) of its latest record, kept until the watermark has
    passed ``created`` by ``delay``; then a timer drops it.  A record that is not later than
    the latest one known gives nothing; one that comes after the state is dropped is a change again, and
    ``latest_records`` puts it where it belongs.  The state lives in the session's state store:
    run it under ``rocksdb_state``, so that it need not fit in memory.
    """
    schema, keep = records.schema, int(pd.Timedelta(delay).total_seconds() * 1000) + 1
    state = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", schema[tie].dataType)])

    def changes(key: tuple, frames: Iterator[pd.DataFrame], known: GroupState) -> Iterator[pd.DataFrame]:
        if known.hasTimedOut:
            known.remove()
            return
        best = None
        for frame in frames:
            last = frame.sort_values([created, tie]).tail(1)
            if best is None or (last[created].iloc[0], last[tie].iloc[0]) > (best[created].iloc[0], best[tie].iloc[0]):
                best = last
        if best is None:
            return
        now = (int(best[created].iloc[0].value // 1000), best[tie].iloc[0].item() if hasattr(best[tie].iloc[0], "item") else best[tie].iloc[0])
        if known.exists and tuple(known.get) >= now:
            return
        known.update(now)
        known.setTimeoutTimestamp(max(now[0] // 1000, known.getCurrentWatermarkMs()) + keep)
        yield best[schema.fieldNames()]

    watched = records.withWatermark(created, delay)
    return watched.groupBy(*ids).applyInPandasWithState(changes, schema, state, "update", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def append_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changes below ``target``, for ``latest_records``; a repeated batch overwrites its own folder."""
    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_records(spark: SparkSession, target: str, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per id over all batches that ``keep_latest`` appended."""
    return latest_by_id(spark.read.parquet(target), ids, [*order, "batch"]).drop("batch")


def run_now(spark: SparkSession, stream: DataFrame, start: Callable[[DataFrame, str, str], StreamingQuery], name: str) -> DataFrame:
    """Run a stream over what is there into the shared folder; return the table."""
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    query = start(stream, out, checkpoint)
    query.awaitTermination()
    return spark.read.parquet(out)
