"""Medoids by swaps: every round replaces the medoid whose exchange lowers the total distance most.

With the nearest and the second nearest medoid of every row, the change of the
total by any exchange is a sum over rows: rows of the leaving medoid go to the
candidate or to their second medoid, all others go to the candidate if it is
nearer.  So one pass sums the changes of all exchanges of a round.  Medoids and
candidates are bounded samples that travel with the tasks; the rows are all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.operators.neighbours import matrix
from threadstats.operators.vectors import _references, assign_to_medoids, k_medoids
from threadstats.storage import written

# Rows that may become medoids; sampled by a hash of their id beyond that.
MAX_CANDIDATES = 1_000
# An exchange must gain more than rounding does.
LEAST_GAIN = 1e-9


def nearest_two(vectors: DataFrame, medoids: DataFrame, id_column: str) -> DataFrame:
    """(id, medoid_id, distance, second_id, second_distance); ties go to the smaller medoid id, NULL without a second."""
    ids, points = _references(medoids, id_column)
    kind = vectors.schema[id_column].dataType.simpleString()

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids)
        for batch in batches:
            far = _distances(matrix(batch.column("vector")), points)
            order = np.argsort(far, axis=1, kind="stable")[:, :2]
            rows = np.arange(len(far))
            columns = [batch.column(id_column), names.take(pa.array(order[:, 0])), pa.array(far[rows, order[:, 0]])]
            if order.shape[1] > 1:
                columns += [names.take(pa.array(order[:, 1])), pa.array(far[rows, order[:, 1]])]
            else:
                columns += [pa.nulls(len(far), names.type), pa.nulls(len(far), pa.float64())]
            yield pa.record_batch(columns, [id_column, "medoid_id", "distance", "second_id", "second_distance"])

    schema = f"`{id_column}` {kind}, medoid_id {kind}, distance double, second_id {kind}, second_distance double"
    return vectors.select(id_column, "vector").mapInArrow(two, schema)


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.maximum(1.0 - rows @ points.T, 0.0)


def swap_gains(vectors: DataFrame, medoids: np.ndarray, candidates: np.ndarray) -> DataFrame:
    """(medoid, candidate, change): by how much the total distance changes if the candidate takes the medoid's place.

    ``medoid`` and ``candidate`` are row numbers of the two arrays.
    """
    k, count = len(medoids), len(candidates)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((k, count))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = matrix(batch.slice(at, 4096).column("vector"))
                to_medoid, to_candidate = _distances(rows, medoids), _distances(rows, candidates)
                nearest = to_medoid.argmin(axis=1)
                first = to_medoid[np.arange(len(rows)), nearest]
                to_medoid[np.arange(len(rows)), nearest] = np.inf
                second = to_medoid.min(axis=1)
                joining = np.minimum(to_candidate - first[:, None], 0.0)
                leaving = np.minimum(to_candidate, second[:, None]) - first[:, None] - joining
                change += joining.sum(axis=0)
                members = np.zeros((len(rows), k))
                members[np.arange(len(rows)), nearest] = 1.0
                change += members.T @ leaving
        yield pa.record_batch([pa.array(np.arange(k * count)), pa.array(change.ravel())], ["place", "change"])

    sums = vectors.select("vector").mapInArrow(partial, "place bigint, change double")
    place = F.col("place")
    return sums.groupBy("place").agg(F.sum("change").alias("change")).select(
        F.floor(place / count).cast("int").alias("medoid"), (place % count).cast("int").alias("candidate"), "change")


def swapped_medoids(
    vectors: DataFrame, seeds: DataFrame, id_column: str, candidates: int = MAX_CANDIDATES
) -> tuple[DataFrame, list]:
    """The rows with ``medoid_id`` and ``distance`` once no exchange lowers the total, and the medoids' ids.

    Starts from the alternating form (``vectors.k_medoids``), so its total is never above
    that one's.  Candidates are all rows, or the ``candidates`` ones with the smallest hash.
    """
    if candidates > MAX_CANDIDATES:
        raise ValueError(f"at most {MAX_CANDIDATES} candidates")
    vectors = written(vectors.select(id_column, "vector"), "vectors")
    settled = k_medoids(vectors, seeds, id_column)
    used = settled.select("medoid_id").distinct()
    start = written(vectors.join(F.broadcast(used), F.col(id_column) == F.col("medoid_id")).select(id_column, "vector"), "medoids")
    ids, medoids = _references(start, id_column)
    sample = written(vectors.orderBy(F.xxhash64(id_column), id_column).limit(candidates), "candidates")
    names, points = _references(sample, id_column)
    while True:
        best = swap_gains(vectors, medoids, points).agg(
            F.min(F.struct(F.round("change", 9).alias("change"), "medoid", "candidate")).alias("b")).first()["b"]
        if best is None or not best["change"] < -LEAST_GAIN:
            break
        ids[best["medoid"]], medoids[best["medoid"]] = names[best["candidate"]], points[best["candidate"]]
    chosen = vectors.filter(F.col(id_column).isin(ids))
    return assign_to_medoids(vectors, chosen, id_column), sorted(ids)
