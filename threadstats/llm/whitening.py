"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Each component c becomes the integer x = floor(scale * c) + shift.  The scatter
of the centred x-vectors is summed per task and then by Spark: width x width
numbers, whatever the number of rows.  It is factored as G G' by Cholesky with
diagonal pivoting; rotations of pairs of the factor's columns then make them
orthogonal (one-sided Jacobi, on the factor itself, so the scatter is never
squared or multiplied again).  The norms of the rotated columns give the
eigenvalues, the columns over their norms the components.

Passes over the rows: sums (exact integers), scatter, projection.  Only sums of
the width or its square reach the driver.

Rows whose vector is null, holds null or non-finite components, or components
beyond 2^50 / scale (they have no exact integer) are dropped; so are vectors
whose length is not the most frequent one (ties: the longer).  Null ids and
repeated rows are kept and returned as often as they come.  Components without
variance can't be whitened and are left out, so constant rows, one row and an
empty table give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.storage import scope, written

#: Rows of a batch that are widened at once.
ROWS = 4096
#: Integers beyond this lose digits as doubles once centred.
EXACT = 1 << 50


def nothing(width: int) -> float:
    """A pivot (or eigenvalue) below this share of the largest one is rounding."""
    return max(1e-13, 4 * width * np.finfo(float).eps)


def usable(vector: Column, scale: int) -> Column:
    """True for a vector whose components all are finite numbers with an exact integer."""
    limit = float(EXACT // scale)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(vector.isNotNull() & fine & (F.size(vector) > 0), F.lit(False))


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """G with G G' = scatter, one column per pivot; the largest remaining diagonal element is the next pivot."""
    rest = scatter.copy()
    width = len(rest)
    factor = np.zeros((width, width))
    open_rows = np.ones(width, bool)
    first = float(rest.diagonal().max(initial=0.0))
    rank = 0
    while rank < width:
        diagonal = np.where(open_rows, rest.diagonal(), -np.inf)
        pivot = int(diagonal.argmax())
        if not diagonal[pivot] > nothing(width) * first:
            break
        column = np.where(open_rows, rest[:, pivot], 0.0) / np.sqrt(diagonal[pivot])
        factor[:, rank] = column
        rest -= np.outer(column, column)
        open_rows[pivot] = False
        rank += 1
    return factor[:, :rank]


def rotated_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` turned pair by pair until all are orthogonal: one-sided Jacobi.

    All pairs of a round are disjoint (a round-robin tournament), so a round is one array operation.
    """
    g = factor.copy()
    count = g.shape[1]
    if count < 2:
        return g
    places = list(range(count + count % 2))  # an odd number of columns: one rests
    limit = np.finfo(float).eps * np.sqrt(g.shape[0])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(places) - 1):
            half = len(places) // 2
            pairs = [(a, b) for a, b in zip(places[:half], places[:half - 1:-1]) if max(a, b) < count]
            p, q = np.array(pairs).T
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = np.abs(xy) > limit * np.sqrt(xx * yy)
            if do.any():
                turned = True
                p, q, x, y = p[do], q[do], x[:, do], y[:, do]
                zeta = (yy[do] - xx[do]) / (2 * xy[do])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                g[:, p], g[:, q] = c * x - s * y, s * x + c * y
            places = [places[0], places[-1], *places[1:-1]]
        if not turned:
            break
    return g


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a scatter matrix, those without variance left out."""
    g = rotated_columns(pivoted_cholesky(scatter))
    squares = (g * g).sum(0)
    order = np.argsort(-squares, kind="stable")
    order = order[squares[order] > nothing(len(scatter)) * squares.max(initial=0.0)]
    return squares[order], g[:, order] / np.sqrt(squares[order])


def _whole(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * rows).astype(np.int64).reshape(batch.num_rows, -1) + shift


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _exact_squares(offsets: np.ndarray, n: int) -> list[int]:
    """Per row the sum of the squared (n x - S), as Python integers; in 64 bits where that can't overflow."""
    most = int(np.abs(offsets).max(initial=0))
    if most * most * offsets.shape[1] < 1 << 63:
        return (offsets * offsets).sum(1).tolist()
    return [sum(v * v for v in row) for row in offsets.tolist()]


class Whitener:
    """The fit: number of rows, exact sums, eigenvalues of the covariance, components, trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, scale: int, shift: int) -> None:
        self.n, self.sums, self.scale, self.shift = n, sums, scale, shift
        squares, self.components = principal(scatter)
        self.values = squares / max(n, 1)
        self.trace = float(scatter.trace()) / max(n, 1)

    def shares(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64 bits if they hold it, else Python integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(rows: DataFrame, scale: int, shift: int) -> Whitener:
    """The whitener of a written table of usable vectors of one length in ``vector``."""
    first = rows.select(F.size("vector")).first()
    if first is None:
        return Whitener(0, [], np.zeros((0, 0)), scale, shift)
    width = first[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        count = 0
        for part in _parts(batches):  # 4,096 integers below 2^51 add up within 64 bits
            total = [t + s for t, s in zip(total, _whole(part, scale, shift).sum(0).tolist())]
            count += part.num_rows
        yield pa.record_batch([pa.array(range(width + 1), pa.int32()), pa.array([str(t) for t in [*total, count]])],
                              ["place", "n"])

    added = rows.select("vector").mapInArrow(sums, "place int, n string").groupBy("place").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).orderBy("place").collect()  # width + 1 rows
    *total, n = [int(row["n"]) for row in added]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_sum = np.zeros((width, width))
        for part in _parts(batches):
            centred = _offsets(_whole(part, scale, shift), n, total).astype(np.float64) / n
            part_sum += centred.T @ centred
        upper = np.triu_indices(width)
        yield pa.record_batch([pa.array(upper[0] * width + upper[1], pa.int32()), pa.array(part_sum[upper])],
                              ["place", "n"])

    added = rows.select("vector").mapInArrow(scatter, "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
    whole = np.zeros(width * width)
    for place, value in added.collect():  # half of width x width rows
        whole[place] = value
    whole = whole.reshape(width, width)
    return Whitener(n, total, whole + np.triu(whole, 1).T, scale, shift)


def project(rows: DataFrame, model: Whitener, count: int) -> DataFrame:
    """(vec_id, deviation decimal, whitened array) for each usable row; ``count`` components at most."""
    values, axes = model.values[:count], model.components[:, :count]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            offsets = _offsets(_whole(part, model.scale, model.shift), model.n, model.sums)
            placed = offsets.astype(np.float64) / model.n @ axes / np.sqrt(values)
            ends = pa.array(np.arange(0, placed.size + 1, len(values)), pa.int32())
            yield pa.record_batch(
                [part.column("vec_id"), pa.array([str(d) for d in _exact_squares(offsets, model.n)]),
                 pa.ListArray.from_arrays(ends, pa.array(placed.ravel()))], ["vec_id", "deviation", "whitened"])

    found = rows.select("vec_id", "vector").mapInArrow(whitened, "vec_id bigint, deviation string, whitened array<double>")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(projected: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance (divisor n, centred) of ``whitened`` minus the identity."""
    entries = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j))
               for i in range(count) for j in range(i, count)]
    return projected.agg(F.greatest(*entries, F.lit(0.0), F.lit(0.0))).first()[0]


def whiten(vectors: DataFrame, count: int = 8, scale: int = 1024, shift: int = 100_000, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    ``deviation`` is decimal(38,0) and exact; ``component`` counts from 1 by falling eigenvalue.
    """
    with scope(vectors.sparkSession) as keep:
        v = F.col(vector).cast("array<double>")
        rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector")).filter(
            usable(F.col("vector"), scale))
        sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        rows = written(rows.filter(F.size("vector") == (sizes["width"] if sizes else 0)), "vectors")
        model = fit(rows, scale, shift)
        count = min(count, len(model.values))
        if not count:
            return rows.sparkSession.createDataFrame(
                [], "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
                    "identity_error double")
        projected = written(project(rows, model, count), "whitened")
        error = identity_error(projected, count)
        shares = F.array(*[F.lit(s) for s in model.shares()[:count]])
        out = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        return keep(out.select(
            "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
            "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
        ), "whitening")
