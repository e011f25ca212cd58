"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of all vectors, so that the
leading coordinates hold most of every product.  Vectors are cut into blocks
along a Hilbert curve through the leading axes; a block's box (least and greatest
value on every axis) decides which blocks, and which vectors, can have anything
near in it.  Within a pair of blocks, products are first taken over so many leading
coordinates that what is left holds a small part of a vector, then a few coordinates
at a time; what the remaining ones can add is at most the product of the suffix
norms, and a pair is left as soon as it can't reach the threshold.  Survivors are
decided by the cosine of the original vectors in double precision.

Vectors spread evenly over many axes leave no box out: then all blocks meet, and
the blocks' size, set by a task's memory, says how often a vector is sent.

Equal vectors are one node with a weight, so copies never pair up.  A pair of
blocks gives one row per linked node (its links, and the smallest node of its
component within the pair), never a row per link.

Vectors that are null, zero, hold null or non-finite components, or whose
length is not the most frequent one (ties: the longer) link with nothing.  Null
ids take part but never name a component.  Repeated rows count as copies.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.llm.components import components
from threadstats.llm.hard_negatives import hilbert_keys
from threadstats.operators.numbering import numbered
from threadstats.storage import scope, written

#: Bytes of a block's vectors, its vectors at least, blocks at most (then blocks grow), and blocks that small tables are cut into.
BLOCK_BYTES, LEAST_BLOCK, MAX_BLOCKS, FEW_BLOCKS = 8 << 20, 1024, 4_000, 6
TILE = 1024
#: Coordinates added at each step of a comparison after the first.
STEP = 16
#: Axes of the curve and bits of each.
CURVE_AXES, CURVE_BITS = 12, 5
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """True for a vector with a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components keep their precision."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def axes(nodes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the unit vectors as columns, by falling share of the squared length, and these shares."""
    if width > 4096:
        raise ValueError("vectors are limited to 4,096 components: their second moments are held by the driver")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = unit(_matrix(batch.column("vector")))
            total += rows.T @ rows
        yield pa.record_batch([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["place", "n"])

    sums = nodes.select("vector").mapInArrow(partial, "place int, n double").groupBy("place").agg(F.sum("n"))
    moments = np.zeros(width * width)
    for place, n in sums.collect():  # width x width rows
        moments[place] = n
    shares, turn = np.linalg.eigh(moments.reshape(width, width))
    shares = np.maximum(shares[::-1], 0.0)
    return turn[:, ::-1], shares / max(shares.sum(), 1e-300)


def first_step(shares: np.ndarray, threshold: float) -> int:
    """So many leading coordinates that the others hold at most half the threshold of a typical product."""
    left = 1.0 - np.cumsum(shares)
    enough = np.flatnonzero(left <= threshold / 2)
    return int(min(len(shares), -(-(enough[0] + 1 if len(enough) else len(shares)) // 8) * 8))


def linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float,
           first: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs between two tiles with a cosine of at least the threshold.

    ``a``, ``b``: unit vectors on the principal axes; ``ua``, ``ub``: on the original ones;
    ``first``: coordinates of the first step.
    """
    width = a.shape[1]
    rest = np.sqrt((a[:, first:] ** 2).sum(1)), np.sqrt((b[:, first:] ** 2).sum(1))
    # One product gives the leading part and the bound of the rest.
    reach = np.column_stack([a[:, :first], rest[0]]) @ np.column_stack([b[:, :first], rest[1]]).T
    i, j = np.nonzero(reach >= threshold - SLACK)
    near = reach[i, j] - rest[0][i] * rest[1][j]
    for at in range(first, width, STEP):
        if not len(i):
            break
        end = min(at + STEP, width)
        rest = np.sqrt((a[:, end:] ** 2).sum(1)), np.sqrt((b[:, end:] ** 2).sum(1))
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            near[part] += np.einsum("ij,ij->i", a[i[part], at:end], b[j[part], at:end])
        stay = near + rest[0][i] * rest[1][j] >= threshold - SLACK
        i, j, near = i[stay], j[stay], near[stay]
    for low in range(0, len(i), 1 << 16):  # the decision, on the original axes
        part = slice(low, low + (1 << 16))
        near[part] = np.einsum("ij,ij->i", ua[i[part]], ub[j[part]])
    return i[near >= threshold], j[near >= threshold]


def blocks_of(nodes: DataFrame, turn: np.ndarray, shares: np.ndarray, block: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written table (node, weight, vector, block) along the curve, and the boxes: low and high (blocks x axes)."""
    lead = turn[:, :CURVE_AXES]
    spread = 4 * np.sqrt(shares[:CURVE_AXES]) + 1e-12  # cells reach over most of what an axis holds

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (unit(_matrix(batch.column("vector"))) @ lead / spread + 1) / 2
            cells = np.clip(np.floor(at * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.record_batch([batch.column("node"), batch.column("weight"), batch.column("vector"),
                                   pa.array(hilbert_keys(cells, CURVE_BITS))], ["node", "weight", "vector", "key"])

    keyed = nodes.select("node", "weight", "vector").mapInArrow(
        place, "node bigint, weight bigint, vector array<double>, key bigint")
    placed = written(numbered(keyed, ["key", "node"]).select(
        "node", "weight", "vector", F.floor(F.col("position") / block).cast("int").alias("block")), "placed")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
            if len(starts):
                turned = unit(_matrix(batch.column("vector"))) @ turn
                yield pa.record_batch([
                    pa.array(own[starts]), pa.array(np.minimum.reduceat(turned, starts).tolist(), pa.list_(pa.float64())),
                    pa.array(np.maximum.reduceat(turned, starts).tolist(), pa.list_(pa.float64()))], ["block", "low", "high"])

    parts = placed.select("block", "vector").mapInArrow(ends, "block int, low array<double>, high array<double>")
    flat = parts.select("block", F.posexplode(F.arrays_zip("low", "high")).alias("place", "e"))
    least = flat.groupBy("block", "place").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    boxes = least.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("e")).select(
        "block", F.transform("e", lambda e: e["low"]).alias("low"), F.transform("e", lambda e: e["high"]).alias("high"))
    found = boxes.orderBy("block").collect()  # at most MAX_BLOCKS rows of the width
    return placed, np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def partners(low: np.ndarray, high: np.ndarray, reach: float) -> list[np.ndarray]:
    """For each block, the blocks (itself too) whose box lies within reach of its own."""
    return [np.flatnonzero((np.maximum(np.maximum(low - high[k], low[k] - high), 0.0) ** 2).sum(1) <= reach * reach)
            for k in range(len(low))]


def links(nodes: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(node, n, label) for every node that has a link within a pair of blocks.

    ``nodes`` is a written table (node, weight, vector) of usable vectors of one
    length.  n: the weight of the nodes linked there; label: the smallest node
    reachable there.
    """
    spark, n = nodes.sparkSession, nodes.count()
    width = nodes.select(F.size("vector")).first()[0] if n else 0
    if not width:
        return spark.createDataFrame([], "node bigint, n bigint, label bigint")
    turn, shares = axes(nodes, width)
    first = first_step(shares, threshold)
    if block is None:
        block = max(LEAST_BLOCK, min(BLOCK_BYTES // (8 * width), -(-n // FEW_BLOCKS)))
    block = max(block, -(-n // MAX_BLOCKS))
    placed, lows, highs = blocks_of(nodes, turn, shares, block)
    count = len(lows)
    # |u - v|^2 = 2 - 2 cos: nearer than this, or not linked.
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    near = partners(lows, highs, reach)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for own in np.unique(blocks).tolist():
                rows = np.flatnonzero(blocks == own)
                for at in range(0, len(rows), 1024):
                    part = rows[at:at + 1024]
                    taken = batch.take(pa.array(part)).select(["node", "weight", "vector"])
                    turned = unit(_matrix(taken.column("vector"))) @ turn
                    for other in near[own].tolist():
                        gap = np.maximum(np.maximum(lows[other] - turned, turned - highs[other]), 0.0)
                        close = taken.filter(pa.array((gap * gap).sum(1) <= reach * reach))
                        if close.num_rows:
                            pair = min(own, other) * count + max(own, other)
                            yield pa.record_batch([*close.columns, pa.array(np.full(close.num_rows, pair)),
                                                   pa.array(np.full(close.num_rows, own <= other))],
                                                  ["node", "weight", "vector", "pair", "left"])

    def compare(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        node, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        units = unit(_matrix(group.column("vector").combine_chunks()))
        turned = units @ turn
        pair = group.column("pair")[0].as_py()
        same = pair // count == pair % count
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        counts, label = np.zeros(len(node), np.int64), node.copy()
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for p in range(0, len(a), TILE):
            for q in range(p if same else 0, len(b), TILE):
                x, y = a[p:p + TILE], b[q:q + TILE]
                i, j = linked(turned[x], turned[y], units[x], units[y], threshold, first)
                i, j = x[i], y[j]
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                counts += np.bincount(i, weight[j], len(node)).astype(np.int64)
                counts += np.bincount(j, weight[i], len(node)).astype(np.int64)
                pairs.append(_forest(i, j, label))
        i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
        _forest(i, j, label)
        has = counts > 0
        return pa.table({"node": node[has], "n": counts[has], "label": label[has]})

    dealt = placed.mapInArrow(deal, "node bigint, weight bigint, vector array<double>, pair bigint, left boolean")
    return dealt.groupBy("pair").applyInArrow(compare, "node bigint, n bigint, label bigint")


def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Give linked rows the smallest label of their component; return few pairs that connect the same rows."""
    own = np.unique(np.concatenate([i, j]))
    if not len(own):
        return i, j
    x, y = np.searchsorted(own, i), np.searchsorted(own, j)
    root = np.arange(len(own))
    while True:
        before = root.copy()
        np.minimum.at(root, x, before[y])
        np.minimum.at(root, y, before[x])
        root = root[root]
        if (root == before).all():
            break
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, root, label[own])
    label[own] = least[root]
    return own, own[root]


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
                     block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    with scope(vectors.sparkSession) as keep:
        v = F.col(vector)
        rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                              F.when(usable(v), v.cast("array<double>")).alias("vector"))
        sizes = (rows.filter("vector is not null").groupBy(F.size("vector").alias("width")).count()
                 .orderBy(F.desc("count"), F.desc("width")).first())
        same = F.size("vector") == (sizes[0] if sizes else 0)
        rows = rows.select("vec_id", F.when(same, F.col("vector")).alias("vector"))
        digest = F.md5(F.col("vector").cast("string").cast("binary"))
        rows = written(rows.withColumn("digest", digest), "vectors")
        nodes = rows.filter("digest is not null").groupBy("digest").agg(
            F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        found = written(links(nodes, threshold, block), "links")
        labels = written(components(found.select(F.col("node").alias("a"), F.col("label").alias("b"))), "labels")
        counts = written(found.groupBy("node").agg(F.sum("n").alias("n")), "counts")
        named = written(
            nodes.select("digest", "node", "first", "weight").join(labels.hint("merge"), "node", "left")
            .join(counts.hint("merge"), "node", "left")
            .select("digest", "first", F.coalesce("label", "node").alias("label"),
                    (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named")
        names = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "names")
        named = written(named.join(names.hint("merge"), "label").select("digest", "n_links", "component_id"), "named")
        out = rows.select("vec_id", "digest").filter("digest is not null").join(named.hint("merge"), "digest").select(
            "vec_id", "n_links", "component_id").union(rows.filter("digest is null").select(
                "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
        kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
        return keep(out.withColumn("kept", kept), "embedding_groups")
