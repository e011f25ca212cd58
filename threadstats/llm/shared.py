"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once (a single longer text is still taken whole).
CHUNK_BYTES = 4 << 20
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id bigint, text binary): only what the tasks need; null is empty."""
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
    )


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: what lies between the bytes 0x20 and 0x09 to 0x0D."""
    return text.translate(LOWER).split()


def sampled_labels(labels: DataFrame, target: str, per_class: int, modulus: int, held: int) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of labelled ids to learn from, and the weight of a row of each class.

    Rows whose ``remainder`` is ``held`` are never among them.  Each class keeps
    the ids whose hash lies below ``per_class`` / size of the class, so about
    ``per_class`` rows at any size of the input; a row weighs what it stands for.
    Labels other than 0 and 1 and null ids are left out; of labels that disagree
    the larger counts.
    """
    label = F.col(target).cast("int")
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label")).filter(
        label.isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {row["label"]: row["count"] for row in ids.groupBy("label").count().collect()}
    share = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.lit(False)
    for c, part in share.items():
        wanted = wanted | ((F.col("label") == c) & (chance < part))
    return ids.filter(wanted), {c: 1.0 / part for c, part in share.items()}


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a light ridge; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return w
