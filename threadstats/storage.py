"""Tables kept between the steps of a job.

Iterative operators cut their lineage by writing each round as Parquet below
the shared folder the cluster names in ``spark.checkpoint.dir``.  A written
table survives the loss of executors and gives the planner true sizes.

Tables belong to a scope and go with it, also on failure; what a scope returns
is handed to the scope around it, and the last ones go when the driver ends.
Access to the session's context and file system is kept in this module.
"""

from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Paths:
    """Tables to delete when a scope ends."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_DRIVER = _Paths()  # lasts as long as the driver
_OPEN: ContextVar[_Paths] = ContextVar("open scope", default=_DRIVER)  # each thread has its own


def use_folder_if_unset(spark: SparkSession, folder: str) -> None:
    """For tests, benchmarks and entry points on one machine: a shared folder if the session has none."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, one per application, that all executors reach."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/threadstats/{context.applicationId}"


def _own(spark: SparkSession, path: str, owner: _Paths) -> str:
    if owner is _DRIVER and not owner.paths:
        atexit.register(_leave, spark, owner)
    owner.paths.append(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted with the scope that is open."""
    return _own(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", _OPEN.get())


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _leave(spark: SparkSession, owner: _Paths) -> None:
    if spark.sparkContext._jsc is None:  # a session that has ended can delete nothing
        if owner.paths:
            print(f"{len(owner.paths)} intermediate tables stay, such as {owner.paths[0]}", file=sys.stderr)
        return
    while owner.paths:
        with suppress(Py4JError, Py4JNetworkError):  # one that can't be deleted keeps none of the others
            delete(spark, owner.paths.pop())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables written inside, at the end or on failure.

    Yields ``keep(df, name)``, which writes a table that the scope around owns.
    """
    outer, own = _OPEN.get(), _Paths()

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = _own(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", outer)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    token = _OPEN.set(own)
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        _leave(spark, own)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back: a lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iteration: a finished round replaces the one before it.

    The new table is complete before the old one is deleted, so the shared
    folder holds two rounds at most and no lineage reaches back.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self._spark, self._base = spark, scratch_path(spark, name)
        self._number = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self._base}/{self._number}"
        df.write.parquet(path)
        if self._number:
            delete(self._spark, f"{self._base}/{self._number - 1}")
        self._number += 1
        return self._spark.read.schema(df.schema).parquet(path)


MARKER = "_COMPLETE"


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if ``mark_complete`` was called for the table at ``path``."""
    try:
        return not spark.read.text(f"{path.rstrip('/')}/{MARKER}").isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def mark_complete(spark: SparkSession, path: str) -> None:
    marker = spark.range(1).select(F.lit("complete").alias("value")).coalesce(1)
    marker.write.mode("overwrite").text(f"{path.rstrip('/')}/{MARKER}")


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Read the table at ``path``; if it is not there yet, build and write it.

    Leftovers of an unfinished write are overwritten.  The marker is a small
    table written after the data, so it does not depend on success markers.
    """
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path, partitionBy=partition_by)
        mark_complete(spark, path)
    return spark.read.parquet(path)


def small_side(table: DataFrame, name: str, max_rows: int = 500_000) -> DataFrame:
    """The side of an n:1 join with one row per key: written, and broadcast if it is small.

    If it is not, both sides are plain exchanges of written tables, so that adaptive
    execution can split the rows of a key that very many rows of the other side share.
    """
    return broadcast_up_to(written(table, name), max_rows)


def broadcast_up_to(table: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after a count has shown that the table fits.

    Beyond ``max_rows`` the table is returned without a hint, so that the
    planner shuffles both sides.  Meant for narrow tables that are already
    written: counting them reads no column.
    """
    return F.broadcast(table) if table.count() <= max_rows else table
