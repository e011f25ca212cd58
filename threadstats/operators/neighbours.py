"""Nearest neighbours of all points: cells around pivots, pruned by the triangle inequality.

Points are unit vectors.  A bounded sample of them are pivots; every point lies in
the cell of its nearest pivot, and the table is written in the order (cell,
distance to the pivot).  It is cut into blocks; a part of a cell in a block (a
zone) is an annulus around its pivot, so the distance of a point to all members of
a zone is bounded from below by two numbers.

Questions are asked in slices of bounded size.  A slice sees its own blocks first,
which bounds the distances that still matter, and then only zones that can hold
something nearer; blocks without such a zone are left out of the scan.  A task
keeps a bounded number of answers per question, so no table of pairs is made.
Points without any structure make every zone a candidate: then a slice is
compared with all points, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadstats.operators.numbering import numbered
from threadstats.storage import scratch_path, written

# What the driver and every task hold: pivots, zones (blocks grow beyond), questions of a slice.
MAX_PIVOTS, MAX_BLOCKS, SLICE = 512, 20_000, 8_192
BLOCK = 1_024
TILE_QUESTIONS, TILE_POINTS = 512, 2_048
# Stands in lists that are not full yet.
NOBODY = np.iinfo(np.int64).max
# Products of blocks differ from products of rows by rounding only.
SLACK = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chord(cosine: np.ndarray) -> np.ndarray:
    """Straight distance of unit vectors; unlike the cosine distance it is a metric."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def distances(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distances of the pairs (i, j), summed pair by pair: the same in every block and either way round."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]])
    return np.maximum(1.0 - out, 0.0)


@dataclass
class Zones:
    """Pivots, and of each (block, cell) the least and greatest distance to its pivot: what tasks need to know."""

    pivots: np.ndarray
    ends: dict[tuple[int, int], tuple[float, float]]

    def reach(self, vectors: np.ndarray, block: int, cell: int) -> np.ndarray:
        """A lower bound of each vector's chord distance to the members of a zone."""
        low, high = self.ends[block, cell]
        away = chord(vectors @ self.pivots[cell])
        return np.maximum(np.maximum(away - high, low - away) - SLACK, 0.0)


@dataclass
class Index:
    """The written table (node, <id>, vector, cell, radius, block) and its zones."""

    table: DataFrame
    id_column: str
    count: int
    block: int
    zones: Zones

    def slices(self, size: int = SLICE) -> Iterator[tuple[int, int]]:
        for start in range(0, self.count, size):
            yield start, min(start + size, self.count)

    def of_blocks(self, table: DataFrame, blocks: list[int]) -> DataFrame:
        """The rows of these blocks; runs of blocks are ranges, which the files' statistics can refute."""
        runs: list[list[int]] = []
        for block in sorted(blocks):
            if runs and runs[-1][1] == block - 1:
                runs[-1][1] = block
            else:
                runs.append([block, block])
        if len(runs) > 100:
            return table.filter(F.col("block").isin(blocks))
        wanted = F.lit(False)
        for low, high in runs:
            wanted = wanted | F.col("block").between(low, high)
        return table.filter(wanted)


def build(points: DataFrame, id_column: str, block: int = BLOCK) -> Index:
    """Index the unit vectors of a table (id, vector); ids must be unique and not null."""
    points = points.select(id_column, "vector")
    count = points.count()
    wanted = min(MAX_PIVOTS, max(1, int(np.sqrt(count))))
    chosen = points.orderBy(F.xxhash64(id_column), id_column).limit(wanted).select("vector").toArrow()
    pivots = matrix(chosen.column("vector")).astype(float) if count else np.zeros((0, 0))

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column("vector")) @ pivots.T
            cell = near.argmax(axis=1)
            radius = chord(near[np.arange(len(cell)), cell])
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                                  [*batch.schema.names, "cell", "radius"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    celled = points.mapInArrow(nearest_pivot, f"{kinds}, cell int, radius double")
    block = max(block, -(-count // MAX_BLOCKS))
    placed = numbered(celled, ["cell", "radius", id_column], "node")
    table = written(placed.withColumn("block", F.floor(F.col("node") / block).cast("int")), "points")
    rows = table.groupBy("block", "cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    zones = {(r["block"], r["cell"]): (r["low"], r["high"]) for r in rows}  # at most blocks + pivots
    return Index(table, id_column, count, block, Zones(pivots, zones))


def first_of_each(group: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k rows of each group in the given order (most significant first)."""
    places = np.lexsort([*order[::-1], group])
    sorted_groups = group[places]
    starts = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]])) if len(places) else places
    rank = np.arange(len(places)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(places)]])))
    return places[rank < k]


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, slice]]:
    """(block, cell, rows) for every stretch of a batch that lies in one zone, cut to tiles."""
    block, cell = batch.column("block").to_numpy(), batch.column("cell").to_numpy()
    if not len(block):
        return
    edge = (block[1:] != block[:-1]) | (cell[1:] != cell[:-1])
    cuts = np.flatnonzero(np.concatenate([[True], edge, [True]]))
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for at in range(start, stop, TILE_POINTS):
            yield int(block[start]), int(cell[start]), slice(at, min(at + TILE_POINTS, stop))


def _scan_nearest(zones: Zones, table: DataFrame, nodes: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> DataFrame:
    """(node, other, distance): per task the k nearest others of each node, as far as they lie within its bound."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = bound.copy()
        near, names = np.full((len(nodes), k), np.inf), np.full((len(nodes), k), NOBODY)
        for batch in batches:
            others, points = batch.column("node").to_numpy(), matrix(batch.column("vector"))
            for block, cell, rows in runs_of(batch):
                for start in range(0, len(nodes), TILE_QUESTIONS):
                    tile = slice(start, start + TILE_QUESTIONS)
                    ask = np.flatnonzero(zones.reach(vectors[tile], block, cell) ** 2 / 2 <= limit[tile] + SLACK) + start
                    if len(ask):
                        join(near, names, limit, ask, others[rows], points[rows])
        found = np.isfinite(near)
        yield pa.record_batch([pa.array(np.repeat(nodes, found.sum(axis=1))), pa.array(names[found]), pa.array(near[found])],
                              ["node", "other", "distance"])

    def join(near, names, limit, ask, others, points):
        """Put what is nearer into the lists of the questions that it is nearer to; the others' lists are not touched."""
        rough = 1.0 - vectors[ask] @ points.T
        rough[nodes[ask][:, None] == others[None, :]] = np.inf
        most = limit[ask]
        if rough.shape[1] > k:  # more than the k nearest of a tile can't count
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((rough <= most[:, None] + SLACK) & np.isfinite(rough))
        if not len(i) or not k:
            return
        changed, place = np.unique(ask[i], return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(changed)), k), place])
        distance = np.concatenate([near[changed].ravel(), distances(vectors, points, ask[i], j)])
        name = np.concatenate([names[changed].ravel(), others[j]])
        best = first_of_each(owner, [distance, name], k)  # k of each: lists are filled up
        near[changed], names[changed] = distance[best].reshape(-1, k), name[best].reshape(-1, k)
        limit[changed] = np.minimum(limit[changed], near[changed, -1])

    return table.select("block", "cell", "node", "vector").mapInArrow(scan, "node bigint, other bigint, distance double")


def needed_blocks(index: Index, vectors: np.ndarray, bound: np.ndarray,
                  skip: Callable[[int, int], np.ndarray] | None = None) -> list[int]:
    """Blocks with a zone that may lie within the bound (a cosine distance) of any vector.

    ``skip(block, cell)`` says which of the vectors have nothing to ask of a zone.
    """
    away = chord(vectors @ index.zones.pivots.T)  # questions of a slice x pivots
    reach = np.sqrt(2 * np.maximum(bound + SLACK, 0.0)) + SLACK
    found: list[int] = []
    for (block, cell), (low, high) in sorted(index.zones.ends.items()):
        if found and found[-1] == block:
            continue
        may = (away[:, cell] - high <= reach) & (low - away[:, cell] <= reach)
        if skip is not None:
            may &= ~skip(block, cell)
        if may.any():
            found.append(block)
    return found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbour_graph(index: Index, k: int, slice_size: int = SLICE) -> DataFrame:
    """(node, rank, other, distance): the k nearest other points of every point by cosine distance.

    Exact; ties go to the smaller node.  A written table; points have fewer rows if there are fewer others.
    """
    spark = index.table.sparkSession
    path = scratch_path(spark, "neighbour-graph")
    schema = "node bigint, rank int, other bigint, distance double"
    spark.createDataFrame([], schema).write.parquet(path)
    for start, stop in index.slices(slice_size):
        part = index.table.filter(F.col("node").between(start, stop - 1)).orderBy("node").select("node", "vector").toArrow()
        nodes, vectors = part.column("node").to_numpy(), matrix(part.column("vector"))
        bound = np.full(len(nodes), 2.0)
        own = index.of_blocks(index.table, list(range(start // index.block, (stop - 1) // index.block + 1)))
        for row in _ranked(_scan_nearest(index.zones, own, nodes, vectors, bound, k), k).filter(F.col("rank") == k).collect():
            bound[row["node"] - start] = row["distance"]  # one row per question
        blocks = needed_blocks(index, vectors, bound)
        found = _ranked(_scan_nearest(index.zones, index.of_blocks(index.table, blocks), nodes, vectors, bound, k), k)
        found.select("node", "rank", "other", "distance").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
