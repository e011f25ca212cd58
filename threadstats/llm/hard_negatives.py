"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers, so that scores (inner products) are exact.  All rows are
written in the order of a Hilbert curve through their most spread dimensions and
cut into blocks; the zone map of a block holds the least and greatest value of
every dimension and of the label.  Interval arithmetic over a zone map bounds the
scores that an anchor can have in a block from both sides.

Anchors are taken in slices of bounded size.  A slice first reads the blocks that
its anchors lie in, for a lower bound of the k-th best score, and then only blocks
whose bounds reach it: first for the positives, then for the windows that the
positives' scores open.  Blocks that no anchor of the slice needs are left out of
the scan (a filter that Parquet's statistics apply); in a task, an anchor meets
only the blocks it needs.  A task keeps no more than k rows per anchor and window,
so what is shuffled follows the anchors, not the pairs.

Bounds prune where the data have structure; vectors without any make every block
a candidate, and a slice then is compared with all rows, block by block.

Rows with a null id, label or vector, with null or non-finite components, or with
components beyond 2^27 / scale (their scores have no exact 64-bit integer) take no
part; neither do vectors whose length is not the most frequent one (ties: the
longer).  Of rows that repeat an id, the one with the smallest label and vector
counts.  Ties in score go to the smaller id.  Anchors without a positive or
without a row in the window give no rows.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadstats.operators.numbering import numbered
from threadstats.storage import scope, scratch_path, written

#: Rows of a block, and blocks at most (then blocks grow): the zone maps are sent to every task.
BLOCK, MAX_BLOCKS = 1024, 65_536
#: Anchors of a slice: what the driver and every task hold.
SLICE = 16_384
#: Dimensions of the curve and bits of each.
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
#: Anchors and rows that are multiplied at once.
TILE_ANCHORS, TILE_ROWS = 512, 2048
#: Components, once integers, stay below this, so that scores of 64 bits are exact.
LIMIT = 1 << 27

ROW = "vec_id bigint, label bigint, vector array<int>"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows x dimensions, ``bits`` bits each) along the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    flip = 1 << (bits - 1)
    while flip > 1:  # undo the rotations and reflections of the curve, coarse to fine
        low = flip - 1
        for i in range(len(x)):
            high = (x[i] & flip) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        flip >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    flip = 1 << (bits - 1)
    while flip > 1:
        turn ^= np.where((x[-1] & flip) != 0, flip - 1, 0)
        flip >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> bit & 1
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' in exact integers: by doubles where all sums stay below 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Zones:
    """Zone maps by block: least and greatest values of the dimensions and of the label."""

    low: np.ndarray
    high: np.ndarray
    first_label: np.ndarray
    last_label: np.ndarray

    def bounds(self, anchors: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score (anchors x blocks) that a row of the block can have."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        low, high = self.low[blocks], self.high[blocks]
        return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass
class Slice:
    """Anchors of a slice, and per window what a row must score to count: at least ``least``, at most ``most``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same_label: bool
    least: np.ndarray  # anchors x windows
    most: np.ndarray

    def needs(self, zones: Zones, at: slice, blocks: np.ndarray) -> np.ndarray:
        """Which anchors (of the tile ``at``) need which blocks."""
        low, high = zones.bounds(self.vectors[at], blocks)
        label = self.labels[at][:, None]
        first, last = zones.first_label[blocks], zones.last_label[blocks]
        fits = (first <= label) & (label <= last) if self.same_label else (first != label) | (last != label)
        reach = np.zeros(low.shape, bool)
        for least, most in zip(self.least[at].T, self.most[at].T):
            reach |= (high >= least[:, None]) & (low <= most[:, None])
        return fits & reach

    def tiles(self) -> Iterator[slice]:
        for at in range(0, len(self.ids), TILE_ANCHORS):
            yield slice(at, min(at + TILE_ANCHORS, len(self.ids)))


def _best(window: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each window: higher scores first, ties to smaller ids."""
    order = np.lexsort((vec_id, -score, window))
    sorted_windows = window[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_windows[1:] != sorted_windows[:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return order[rank < k]


def search(table: DataFrame, zones: Zones, asked: Slice, k: int) -> DataFrame:
    """(anchor, place, vec_id, score): per task the first k rows of every window of every anchor.

    ``anchor`` and ``place`` number the slice's anchors and an anchor's windows; an
    anchor never finds itself.
    """
    windows = asked.least.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = asked.least.copy()
        kept = [np.zeros(0, np.int64)] * 3  # window, score, vec_id
        for batch in batches:
            own = batch.column("block").to_numpy()
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            vectors = _matrix(batch.column("vector"))
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else []
            for start, stop in zip(cuts[:-1], cuts[1:]):
                for at in range(start, stop, TILE_ROWS):
                    rows = slice(at, min(at + TILE_ROWS, stop))
                    kept = merge(kept, least, int(own[start]), ids[rows], labels[rows], vectors[rows])
        window, score, vec_id = kept
        yield pa.record_batch([pa.array((window // windows).astype(np.int32)), pa.array((window % windows).astype(np.int32)),
                               pa.array(vec_id), pa.array(score)], ["anchor", "place", "vec_id", "score"])

    def merge(kept, least, block, ids, labels, vectors):
        found = [kept]
        for tile in asked.tiles():
            need = np.flatnonzero(asked.needs(zones, tile, np.array([block]))[:, 0]) + tile.start
            if not len(need):
                continue
            score = products(asked.vectors[need], vectors)
            fits = asked.labels[need][:, None] == labels[None, :]
            fits = (fits if asked.same_label else ~fits) & (asked.ids[need][:, None] != ids[None, :])
            for place in range(windows):
                i, j = np.nonzero(fits & (score >= least[need, place][:, None]) & (score <= asked.most[need, place][:, None]))
                if len(i):
                    part = need[i] * windows + place, score[i, j], ids[j]
                    best = _best(*part, k)
                    found.append([x[best] for x in part])
        if len(found) == 1:
            return kept
        together = [np.concatenate(parts) for parts in zip(*found)]
        best = _best(*together, k)
        together = [x[best] for x in together]
        full, count = np.unique(together[0], return_counts=True)
        ends = np.cumsum(count) - 1  # the last of a full window is what later rows must reach
        full, ends = full[count == k], ends[count == k]
        least.ravel()[full] = together[1][ends]
        return together

    return table.select("block", "vec_id", "label", "vector").mapInArrow(
        scan, "anchor int, place int, vec_id bigint, score bigint")


def needed_blocks(spark: SparkSession, zones: Zones, asked: Slice) -> list[int]:
    """The blocks that any anchor of the slice needs."""
    count = len(zones.low)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("id").to_numpy()
            for at in range(0, len(blocks), 512):
                some = blocks[at:at + 512]
                need = np.zeros(len(some), bool)
                for tile in asked.tiles():
                    need |= asked.needs(zones, tile, some).any(0)
                yield pa.record_batch([pa.array(some[need])], ["block"])

    found = spark.range(0, count, 1, max(1, count // 512)).mapInArrow(check, "block bigint")
    return sorted(row[0] for row in found.collect())  # at most MAX_BLOCKS numbers


def _only(table: DataFrame, blocks: list[int]) -> DataFrame:
    """The rows of these blocks; runs of blocks become ranges, which Parquet's statistics can refute."""
    runs: list[list[int]] = []
    for block in blocks:
        if runs and runs[-1][1] == block - 1:
            runs[-1][1] = block
        else:
            runs.append([block, block])
    if len(runs) > 200:
        return table.filter(F.col("block").isin(blocks))
    wanted = F.lit(False)
    for low, high in runs:
        wanted = wanted | F.col("block").between(low, high)
    return table.filter(wanted)


def usable(vector: Column, scale: int) -> Column:
    """True for a vector of finite components whose integers are in bounds."""
    limit = float(LIMIT // scale)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(vector.isNotNull() & fine & (F.size(vector) > 0), F.lit(False))


def spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variance, least and greatest value of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, count = np.zeros(width), np.zeros(width), 0
        low, high = np.full(width, np.iinfo(np.int32).max), np.full(width, np.iinfo(np.int32).min)
        for batch in batches:
            x = _matrix(batch.column("vector"))
            if len(x):
                total, squares, count = total + x.sum(0), squares + (x.astype(float) ** 2).sum(0), count + len(x)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if count:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(np.full(width, count)), pa.array(total),
                                   pa.array(squares), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                                  ["place", "n", "total", "squares", "low", "high"])

    sums = rows.select("vector").mapInArrow(
        partial, "place int, n bigint, total double, squares double, low int, high int").groupBy("place").agg(
        F.sum("n"), F.sum("total"), F.sum("squares"), F.min("low"), F.max("high")).orderBy("place").collect()  # width rows
    n, total, squares, low, high = (np.array([row[c] for row in sums], float) for c in range(1, 6))
    return squares / n - (total / n) ** 2, low, high


def ordered_blocks(rows: DataFrame, width: int, block: int) -> DataFrame:
    """The table of rows in curve order, with their ``position`` and ``block``."""
    variance, low, high = spread(rows, width)
    # Equal variances (to six digits) keep the order of the dimensions, so that summing order can't change the curve.
    axes = np.lexsort((np.arange(width), -np.round(variance / max(variance.max(), 1e-300), 6)))[:CURVE_DIMENSIONS]
    low, span = low[axes], (high - low + 1)[axes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))[:, axes]
            cells = np.floor((x - low) / span * (1 << CURVE_BITS)).astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(hilbert_keys(cells, CURVE_BITS))], [*batch.schema.names, "key"])

    keyed = rows.select("vec_id", "label", "vector").mapInArrow(place, f"{ROW}, key bigint")
    placed = numbered(keyed, ["key", "vec_id"]).drop("key")
    path = scratch_path(rows.sparkSession, "blocks")
    placed = placed.withColumn("block", F.floor(F.col("position") / block).cast("bigint"))
    # A row group of Parquet then holds about one block.
    placed.write.option("parquet.block.size", max(1 << 16, block * width * 4)).parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def zone_maps(table: DataFrame, width: int) -> Zones:
    """The zone map of every block of the table."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("block").to_numpy()
            x = np.column_stack([_matrix(batch.column("vector")).astype(np.int64), batch.column("label").to_numpy()])
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
            if len(starts):
                yield pa.record_batch([
                    pa.array(own[starts]), pa.array(np.minimum.reduceat(x, starts).tolist(), pa.list_(pa.int64())),
                    pa.array(np.maximum.reduceat(x, starts).tolist(), pa.list_(pa.int64()))], ["block", "low", "high"])

    parts = table.select("block", "vector", "label").mapInArrow(partial, "block bigint, low array<bigint>, high array<bigint>")
    flat = parts.select("block", F.posexplode(F.arrays_zip("low", "high")).alias("place", "e"))
    ends = flat.groupBy("block", "place").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    ends = ends.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("e"))
    found = ends.select("block", F.transform("e", lambda e: e["low"]).alias("low"),
                        F.transform("e", lambda e: e["high"]).alias("high")).orderBy("block").toArrow()  # <= MAX_BLOCKS rows
    low, high = _matrix(found.column("low").combine_chunks()), _matrix(found.column("high").combine_chunks())
    return Zones(low[:, :width], high[:, :width], low[:, width], high[:, width])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _kth(found: DataFrame, k: int, asked: Slice) -> np.ndarray:
    """Per window the k-th score found so far, or the window's own lower end."""
    least = asked.least.copy()
    for row in _first(found, k).filter(F.col("rank") == k).select("anchor", "place", "score").collect():
        least[row["anchor"], row["place"]] = max(least[row["anchor"], row["place"]], row["score"])
    return least


def _two_steps(table: DataFrame, zones: Zones, asked: Slice, home: list[int], k: int) -> DataFrame:
    """The first k rows of every window: the anchors' own blocks give a bound, then all blocks that can reach it."""
    asked.least = _kth(search(_only(table, home), zones, asked, k), k, asked)
    blocks = needed_blocks(table.sparkSession, zones, asked)
    return _first(search(_only(table, blocks), zones, asked, k), k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
         percent: tuple[int, int] = (30, 90), scale: int = 256, block: int = BLOCK, slice_size: int = SLICE,
         vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an expression over the given columns.
    A negative's score lies between the two percentages of its positive's.
    """
    spark = vectors.sparkSession
    with scope(spark) as keep:
        rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                              F.col(vector).cast("array<double>").alias("vector"))
        rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), scale))
        whole = F.transform("vector", lambda x: F.floor(x * scale).cast("int"))
        sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        if sizes is None:
            return spark.createDataFrame([], RESULT)
        width = sizes["width"]
        one = rows.filter(F.size("vector") == width).select("vec_id", F.struct("label", whole.alias("vector")).alias("r"))
        rows = written(one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vector"), "vectors")
        block = max(block, -(-rows.count() // MAX_BLOCKS))
        table = ordered_blocks(rows, width, block)
        zones = zone_maps(table, width)
        anchors = written(numbered(table.filter(is_anchor), ["position"], "anchor_no"), "anchors")
        path = scratch_path(spark, "mined")
        for start in range(0, max(1, anchors.count()), slice_size):
            part = anchors.filter(F.col("anchor_no").between(start, start + slice_size - 1)).orderBy("anchor_no")
            _mined(table, zones, part.toArrow(), positives, negatives, percent).write.mode("append").parquet(path)
        return keep(spark.read.schema(RESULT).parquet(path), "hard_negatives")


def _mined(table: DataFrame, zones: Zones, part: pa.Table, positives: int, negatives: int,
           percent: tuple[int, int]) -> DataFrame:
    """The result rows of the anchors of one slice."""
    ids, count = part.column("vec_id").to_numpy(), part.num_rows
    labels = part.column("label").to_numpy()
    points = _matrix(part.column("vector").combine_chunks()) if count else np.zeros((0, zones.low.shape[1]), np.int32)
    home = sorted(set(part.column("block").to_pylist()))
    any_score = np.iinfo(np.int64)
    asked = Slice(ids, labels, points, True, np.full((count, 1), any_score.min), np.full((count, 1), any_score.max))
    found = _two_steps(table, zones, asked, home, positives)
    rank = {"id": np.zeros((count, positives), np.int64), "score": np.zeros((count, positives), np.int64)}
    known = np.zeros((count, positives), bool)
    for row in found.select("anchor", "rank", "vec_id", "score").collect():  # positives x slice rows
        at = row["anchor"], row["rank"] - 1
        rank["id"][at], rank["score"][at], known[at] = row["vec_id"], row["score"], True
    low, high = percent
    least = np.where(known, -(-low * rank["score"] // 100), any_score.max)
    most = np.where(known, high * rank["score"] // 100, any_score.min)
    found = _two_steps(table, zones, Slice(ids, labels, points, False, least, most), home, negatives)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("anchor").to_numpy(), batch.column("place").to_numpy()
            yield pa.record_batch([
                pa.array(ids[at[0]]), pa.array(rank["id"][at]), batch.column("rank"), batch.column("vec_id"),
                pa.array(rank["score"][at]), batch.column("score")], [c.split()[0] for c in RESULT.split(", ")])

    return found.select("anchor", "place", "vec_id", "score", "rank").mapInArrow(named, RESULT)
