"""Coordinates that keep distances: classical scaling of landmarks, and every row by its distances to them.

The squared distances among a bounded sample of landmarks are centred twice; the
leading eigenvectors of the result are the landmarks' coordinates.  Any other row
has its coordinates from its squared distances to the landmarks (it is placed
where the landmarks' distances say), so nothing grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadstats.operators.neighbours import matrix
from threadstats.operators.vectors import _references

#: An eigenvalue below this share of the largest one is no dimension.
NOTHING = 1e-10


def _squared(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Squared straight distances of unit vectors: twice their cosine distances."""
    return np.maximum(2.0 - 2.0 * (rows @ landmarks.T), 0.0)


def landmark_coordinates(vectors: DataFrame, landmarks: DataFrame, k: int, id_column: str) -> DataFrame:
    """(id, coordinates): up to k coordinates of every unit vector, by falling share of the landmarks' spread.

    ``landmarks`` are up to 1,000 of the rows.  Distances between coordinates are the straight
    distances of the unit vectors (the root of twice the cosine distance): never above them by
    more than rounding, and equal if k is as large as the landmarks' rank.
    Directions are turned so that the landmark farthest out lies on the positive side.
    """
    _, points = _references(landmarks, id_column)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, coordinates array<double>"
    if not len(points):
        return vectors.sparkSession.createDataFrame([], schema)
    among = _squared(points, points)
    means = among.mean(axis=0)
    centred = -0.5 * (among - means[:, None] - means[None, :] + means.mean())
    values, axes = np.linalg.eigh((centred + centred.T) / 2)
    order = np.argsort(-values)[:k]
    order = order[values[order] > NOTHING * max(values.max(), 0.0)]
    values, axes = values[order], axes[:, order]
    if len(order):
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    turn = axes / np.sqrt(values)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = -0.5 * (_squared(matrix(batch.column("vector")), points) - means) @ turn
            ends = pa.array(np.arange(len(placed) + 1) * placed.shape[1], pa.int32())
            yield pa.record_batch([batch.column(id_column), pa.ListArray.from_arrays(ends, pa.array(placed.ravel()))],
                                  [id_column, "coordinates"])

    return vectors.select(id_column, "vector").mapInArrow(place, schema)
