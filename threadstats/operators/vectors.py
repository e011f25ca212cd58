"""Distances, medoids, density clusters and transitions of vectors.

Vectors are ``ARRAY<DOUBLE>`` of one fixed length.  A full distance matrix
grows with the square of the vectors and is never built: distances are taken
to a bounded set of reference vectors, and sums of distances within a cluster
follow exactly from the cluster's vector sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadstats.operators.numbering import numbered
from threadstats.operators.terms import term_vectors
from threadstats.storage import Rounds, broadcast_up_to, written

# Reference vectors travel with every task, so their number is bounded.
MAX_REFERENCES = 1_000
MAX_CLUSTER_ROUNDS = 40
# Digests with their positions: about 100 MB.
MAX_BROADCAST_VECTORS = 1_000_000


def _scaled(rows: np.ndarray) -> pd.Series:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return pd.Series(list(np.divide(rows, norm, out=rows.copy(), where=norm > 0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit(vectors: pd.Series) -> pd.Series:
    """Scale to length one; the zero vector stays as it is."""
    return _scaled(np.stack(vectors.to_numpy()).astype(float))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def centred_unit(vectors: pd.Series) -> pd.Series:
    """Subtract the vector's mean, then scale: cosine becomes Pearson correlation."""
    rows = np.stack(vectors.to_numpy()).astype(float)
    return _scaled(rows - rows.mean(axis=1, keepdims=True))


def distinct_rows(vectors: DataFrame, id_column: str, vector: str = "vector") -> DataFrame:
    """Distinct non-zero vectors, each under its smallest id."""
    nonzero = vectors.filter(F.exists(vector, lambda x: x != 0))
    return nonzero.groupBy(vector).agg(F.min(id_column).alias(id_column)).select(id_column, vector)


def _references(rows: DataFrame, id_column: str) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of the reference rows, at most MAX_REFERENCES."""
    found = rows.select(id_column, "vector").limit(MAX_REFERENCES + 1).collect()
    if len(found) > MAX_REFERENCES:
        raise ValueError(f"at most {MAX_REFERENCES} reference vectors")
    found.sort(key=lambda r: r[0])
    return [r[0] for r in found], np.array([r["vector"] for r in found], dtype=float)


def _distances_to(references: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def distances(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.maximum(1.0 - np.stack(vectors.to_numpy()) @ references.T, 0.0)))

    return distances


@F.pandas_udf(T.DoubleType())
def _row_dot(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series((np.stack(left.to_numpy()) * np.stack(right.to_numpy())).sum(axis=1))


def reference_distances(vectors: DataFrame, references: DataFrame, id_column: str) -> DataFrame:
    """Cosine distance of each vector to each reference: (id, reference_id, distance).

    Both sides hold unit vectors in ``vector``.
    """
    ids, matrix = _references(references, id_column)
    wide = vectors.select(id_column, _distances_to(matrix)("vector").alias("d"))
    pairs = F.arrays_zip(F.array(*[F.lit(i) for i in ids]).alias("reference_id"), F.col("d").alias("distance"))
    return wide.select(id_column, F.explode(pairs).alias("p")).select(
        id_column, F.col("p.reference_id").alias("reference_id"), F.col("p.distance").alias("distance")
    )


def assign_to_medoids(vectors: DataFrame, medoids: DataFrame, id_column: str) -> DataFrame:
    """Nearest medoid per vector (smallest id on ties): adds medoid_id, distance."""
    ids, matrix = _references(medoids, id_column)
    measured = vectors.withColumn("__d", _distances_to(matrix)("vector")).withColumn(
        "distance", F.array_min("__d")
    )
    nearest = F.array(*[F.lit(i) for i in ids])[
        (F.array_position("__d", F.col("distance")) - 1).cast("int")
    ]
    return measured.withColumn("medoid_id", nearest).drop("__d")


def best_medoids(assigned: DataFrame, id_column: str) -> DataFrame:
    """The member of each cluster with the least summed distance to the others.

    For unit vectors the distances of x to its cluster sum to n - x . S, where
    S is the cluster's vector sum: exact, and linear in the cluster.
    """
    sums = (
        assigned.select("medoid_id", F.posexplode("vector").alias("pos", "x"))
        .groupBy("medoid_id", "pos").agg(F.sum("x").alias("x"))
        .groupBy("medoid_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e.x).alias("total"))
    )
    sizes = assigned.groupBy("medoid_id").agg(F.count(F.lit(1)).alias("n_members"))
    clusters = sums.join(sizes, "medoid_id")
    dot = _row_dot("vector", "total")
    # One row per cluster, and there are at most MAX_REFERENCES of them.
    costed = assigned.join(F.broadcast(clusters), "medoid_id").withColumn(
        "total_distance", F.col("n_members") - dot
    )
    return costed.groupBy("medoid_id").agg(
        F.min_by(F.struct(F.col(id_column), "vector", "total_distance"), F.struct(F.round("total_distance", 9), F.col(id_column))).alias("best"),
        F.max("n_members").alias("n_members"),
    ).select("medoid_id", "n_members", "best.*")


def k_medoids(vectors: DataFrame, seeds: DataFrame, id_column: str) -> DataFrame:
    """Alternate assignment and medoid choice until the medoids stay.

    Each change lowers the total distance, so it ends; should rounding bring
    medoids back, the first ones to come again stay.  Returns the vectors with
    ``medoid_id`` and ``distance``.
    """
    vectors = written(vectors.select(id_column, "vector"), "vectors")
    medoids = seeds.select(id_column, "vector")
    seen: set[frozenset] = set()
    while True:
        assigned = written(assign_to_medoids(vectors, medoids, id_column), "assigned")
        medoids = written(best_medoids(assigned, id_column), "medoids").select(id_column, "vector")
        now = frozenset(_references(medoids, id_column)[0])
        if now in seen:
            break
        seen.add(now)
    return assign_to_medoids(vectors, medoids, id_column)


def pca_project(vectors: DataFrame, k: int, id_column: str) -> DataFrame:
    """The k principal coordinates of each vector."""
    features = vectors.select(id_column, array_to_vector("vector").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(features)
    return model.transform(features).select(id_column, vector_to_array("projected").alias("projected"))


def dense_cells(points: DataFrame, coordinates: Sequence[str], width: float, min_points: int) -> DataFrame:
    """Cells of a grid over the coordinates that hold at least ``min_points``."""
    cells = [F.floor(F.col(c) / width).alias(f"cell_{i}") for i, c in enumerate(coordinates)]
    return points.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_points")).filter(
        F.col("n_points") >= min_points
    )


def _neighbours(cells: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of dense cells that touch, found by each cell naming its neighbours."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = cells.select("cell", *names)
    for name in names:
        near = near.withColumn("__step", F.explode(steps)).withColumn(name, F.col(name) + F.col("__step")).drop("__step")
    there = cells.select(F.col("cell").alias("other"), *names)
    return near.join(there, names).filter(F.col("cell") != F.col("other")).select("cell", "other")


def density_clusters(
    points: DataFrame, coordinates: Sequence[str], width: float, min_points: int
) -> DataFrame:
    """Flat density clusters on a grid: adds ``cluster``, NULL for noise.

    Points are counted per cell first; touching dense cells form a cluster,
    named after its first cell (indexes as text).  Only cells, never pairs of points, are
    compared.
    """
    names = [f"cell_{i}" for i in range(len(coordinates))]
    key = F.concat_ws(",", *[F.col(n).cast("string") for n in names])
    cells = written(dense_cells(points, coordinates, width, min_points).withColumn("cell", key), "cells")
    edges = written(_neighbours(cells, names), "cell-edges")
    labels = cells.select("cell", F.col("cell").alias("cluster"))
    lows, rounds = Rounds(points.sparkSession, "cell-lowest"), Rounds(points.sparkSession, "cell-labels")
    for _ in range(MAX_CLUSTER_ROUNDS):
        offered = edges.join(labels, "cell").select(F.col("other").alias("cell"), "cluster")
        lowest = labels.unionByName(offered).groupBy("cell").agg(F.min("cluster").alias("cluster"))
        # Follow the label of the labelling cell too, which doubles the reach.
        lowest = lows.write(lowest)
        via = lowest.select(F.col("cell").alias("cluster"), F.col("cluster").alias("lower"))
        moved = lowest.join(via, "cluster").select("cell", F.col("lower").alias("cluster"))
        changed = not moved.exceptAll(labels).isEmpty()
        labels = rounds.write(moved)
        if not changed:
            break
    else:
        raise ValueError(f"clusters not settled after {MAX_CLUSTER_ROUNDS} rounds")
    placed = cells.join(labels, "cell").select(*names, "cluster")
    located = points.select(
        "*", *[F.floor(F.col(c) / width).alias(n) for n, c in zip(names, coordinates, strict=True)]
    )
    return located.join(placed, names, "left").drop(*names)


def top_clusters(clustered: DataFrame, cluster: str, n: int = 8) -> DataFrame:
    """Relabel the n largest clusters by rank; all others share label 1 with rank 1."""
    largest = (
        clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), cluster).limit(n)
        .agg(F.collect_list(F.struct(F.col("__n").alias("n"), F.col(cluster).alias("c"))).alias("top"))
        .select(F.transform(
            F.array_sort("top", lambda a, b: F.when(a.n > b.n, -1).when(a.n < b.n, 1).when(a.c < b.c, -1).otherwise(1)),
            lambda e: e.c,
        ).alias("top"))
    )
    rank = F.array_position(largest.scalar(), F.col(cluster)).cast("int")
    return clustered.withColumn("label", F.when(rank > 0, rank).otherwise(1))


def vector_positions(weights: DataFrame, periods: Sequence[int], value: str = "weight") -> DataFrame:
    """(author, period, position): where each author's vector stands among a period's distinct vectors.

    Distinct vectors are numbered 1, 2, 3 ... without gaps, in the order of the smallest
    author that has them.  Numbers are given to distinct vectors only; authors get theirs
    by a digest, from the small side of a join, so a very common vector is no hot spot.
    """
    chosen = weights.filter(F.col("period").isin(list(periods)))
    vectors = term_vectors(chosen, ["author", "period"], value)
    spelled = F.sha2(F.to_json("vector"), 256)
    named = written(vectors.select("author", "period", spelled.alias("digest")), "author-vectors")
    unique = named.groupBy("period", "digest").agg(F.min("author").alias("first_author"))
    placed = written(numbered(unique, ["period", "first_author"], "place"), "distinct-vectors")
    starts = placed.groupBy("period").agg(F.min("place").alias("start"))  # one row per period asked for
    ids = placed.join(F.broadcast(starts), "period").select(
        "period", "digest", (F.col("place") - F.col("start") + 1).alias("position"))
    small = broadcast_up_to(written(ids, "vector-ids"), MAX_BROADCAST_VECTORS)
    return named.join(small, ["period", "digest"]).select("author", "period", "position")


def vector_transition(
    weights: DataFrame, period: int, other: int, value: str = "weight"
) -> DataFrame:
    """Where each author stands among the distinct vectors of two periods: (author, start_id, end_id).

    Positions as in ``vector_positions``.  The result has the authors present in both periods.
    """
    placed = vector_positions(weights, [period, other], value)
    at = [F.max(F.when(F.col("period") == p, F.col("position"))).alias(n) for p, n in ((period, "start_id"), (other, "end_id"))]
    return placed.groupBy("author").agg(*at).filter("start_id is not null and end_id is not null")
