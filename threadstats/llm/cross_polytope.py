"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a unit vector; its bucket is the signed axis nearest to it.  Every row lies
in one bucket of each of ``tables`` tables.  A query looks into the ``probes``
nearest axes of each table, and the candidates it meets are ranked by their exact
cosine.  A query that meets fewer than k candidates looks into all buckets of
one table, which hold every row.

Buckets are cut into blocks by a hash of the id, and so are a bucket's queries:
no task holds more than one block of either, however many rows share a bucket.
A block gives its k best per query, so the rows made follow the queries.

Vectors that are null, zero, hold null or non-finite components or differ in
length from the most frequent one take no part; rows without an id neither.  Of
rows that repeat an id, the smallest vector counts.  Ties go to the smaller id.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadstats.llm.embed_dedup import _matrix, unit, usable
from threadstats.storage import scope, written

#: Rows of a bucket, and queries of a bucket, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 1000, 4000
FOUND = "query_id bigint, vec_id bigint, score double"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    size, half = rows.shape[1], 1
    while half < size:
        pairs = rows.reshape(len(rows), size // (2 * half), 2, half)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2)
        rows = rows.reshape(len(rows), size)
        half *= 2
    return rows / np.sqrt(size)


def rotated(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The table's pseudo-rotation; rows are filled up with zeros to a power of two."""
    size = 1 << max(1, (rows.shape[1] - 1).bit_length())
    rows = np.pad(rows, ((0, 0), (0, size - rows.shape[1])))
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, size))
    for sign in signs:
        rows = hadamard(rows * sign)
    return rows


def nearest_axes(turned: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of each row, nearest first: axis i is 2i, its opposite 2i + 1."""
    near = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    if n == 1:
        return near.argmax(axis=1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _buckets(rows: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """(id, vector, part, bucket): one row per table and probe."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                units = unit(_matrix(part.column("vector")))
                for table in range(tables):
                    axis = nearest_axes(rotated(units, table, seed), probes)
                    taken = part.take(pa.array(np.repeat(np.arange(len(axis)), axis.shape[1])))
                    yield pa.record_batch([*taken.columns, pa.array(np.full(axis.size, table, np.int32)),
                                           pa.array(axis.ravel().astype(np.int32))], ["id", "vector", "part", "bucket"])

    return rows.select("id", "vector").mapInArrow(each, "id bigint, vector array<double>, part int, bucket int")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """How many blocks each bucket is cut into: at most tables x 2 x length rows, whatever the input."""
    return rows.groupBy("part", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def probe(rows: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): the k best per query, part and block; a candidate may come more than once."""
    index = written(_buckets(rows, tables, 1, seed), "index")
    looked = written(_buckets(queries, tables, probes, seed), "probes")
    row_blocks = _blocks(index, BLOCK_ROWS).withColumnRenamed("blocks", "row_blocks")
    query_blocks = _blocks(looked, BLOCK_QUERIES).withColumnRenamed("blocks", "query_blocks")
    # Bounded by the number of buckets, so safe to send to all.
    cut = F.broadcast(written(row_blocks.join(query_blocks, ["part", "bucket"]), "cut"))
    key = ["part", "bucket", "row_block", "query_block"]
    index = index.join(cut, ["part", "bucket"]).select(
        "id", "vector", "part", "bucket", _block(F.col("row_blocks")).alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    looked = looked.join(cut, ["part", "bucket"]).select(
        "id", "vector", "part", "bucket",
        F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        _block(F.col("query_blocks")).alias("query_block"))

    def best(found: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if found.num_rows and asked.num_rows:
            ids, names = found.column("id").to_numpy(), asked.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            units = unit(_matrix(found.column("vector").combine_chunks()))[order]
            wanted = unit(_matrix(asked.column("vector").combine_chunks()))
            for at in range(0, len(names), 256):
                near = wanted[at:at + 256] @ units.T
                near[names[at:at + 256][:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(top)), top.shape[1])
                score = near[rows, top.ravel()]
                real = np.isfinite(score)
                # The score itself is summed pair by pair, so it is the same in every block.
                exact = np.einsum("ij,ij->i", wanted[at:at + 256][rows[real]], units[top.ravel()[real]])
                out["query_id"].append(names[at:at + 256][rows[real]])
                out["vec_id"].append(ids[top.ravel()[real]])
                out["score"].append(exact)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64)
                         for c, v in out.items()})

    return index.groupBy(key).cogroup(looked.groupBy(key)).applyInArrow(best, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 6, probes: int = 16, seed: int = 7,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first.

    ``is_query`` is a condition on the column ``id``.
    """
    with scope(vectors.sparkSession) as keep:
        v = F.col(vector)
        rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.cast("array<double>").alias("vector")).filter(
            usable(v) & F.col("id").isNotNull())
        rows = written(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
        sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        rows = rows.filter(F.size("vector") == (sizes[0] if sizes else 0))
        queries = rows.filter(is_query)
        found = written(_ranked(probe(rows, queries, k, tables, probes, seed), k), "found")
        wanted = min(k, rows.count() - 1)
        enough = found.groupBy("query_id").count().filter(F.col("count") >= wanted)
        short = written(queries.join(enough.hint("merge"), queries["id"] == enough["query_id"], "left_anti"), "short")
        if wanted > 0 and not short.isEmpty():
            everything = probe(rows, short, k, 1, 2 << (sizes[0] - 1).bit_length(), seed)
            found = _ranked(found.select("query_id", "vec_id", "score").union(everything), k)
        return keep(found.select("query_id", "rank", "vec_id", "score"), "nearest")
