"""Density clusters by mutual reachability.

The core distance of a point is the distance to its ``min_points``-th nearest
point, itself counted; two points reach each other at the greatest of their core
distances and their own distance.  The spanning forest of least reach (Boruvka
rounds) holds everything that clusters at any distance need: at a distance, the
clusters are the components of the forest's shorter edges.  Stable clusters are
read from a ladder of distances: a cluster lives on, splits or ends from one rung
to the next tighter one, and the clusters with the greatest excess of mass stay.

Distances are cosine distances of unit vectors.  Every round is a written table;
points are asked in slices against blocks (``neighbours``), never in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.operators.components import lowest_labels
from threadstats.operators.neighbours import (
    SLACK, SLICE, TILE_QUESTIONS, Index, Zones, distances, first_of_each, matrix, needed_blocks, neighbour_graph, runs_of,
)
from threadstats.storage import Rounds, scratch_path, written

# Every round at least halves the trees.
MAX_ROUNDS = 64
MAX_RUNGS = 200


def core_distances(index: Index, graph: DataFrame, min_points: int) -> DataFrame:
    """(node, core): the distance to the ``min_points``-th nearest point, the point itself being the first."""
    if min_points == 1:
        return index.table.select("node", F.lit(0.0).alias("core"))
    near = graph.filter(F.col("rank") < min_points)  # with fewer points than that, the farthest one counts
    return near.groupBy("node").agg(F.max("distance").alias("core"))


def _edges_of(graph: DataFrame, cores: DataFrame) -> DataFrame:
    """The neighbour graph's pairs with their mutual reach, each pair once."""
    pairs = graph.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "distance").distinct()
    core = cores.select(F.col("node").alias("a"), F.col("core").alias("core_a"))
    other = cores.select(F.col("node").alias("b"), F.col("core").alias("core_b"))
    joined = pairs.join(core, "a").join(other, "b")
    return joined.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("weight"))


def _scan_outgoing(zones: Zones, table: DataFrame, asked: dict[str, np.ndarray]) -> DataFrame:
    """(tree, weight, a, b): per task the shortest edge out of each asked tree that beats its bound.

    ``asked`` has node, vector, core, tree and bound of each point that may have such an edge.
    """
    nodes, vectors, core, tree = (asked[c] for c in ("node", "vector", "core", "tree"))
    names, place = np.unique(tree, return_inverse=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.full(len(names), np.inf)
        np.minimum.at(bound, place, asked["bound"])
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            others, points = batch.column("node").to_numpy(), matrix(batch.column("vector"))
            other_core, other_tree = batch.column("core").to_numpy(), batch.column("tree").to_numpy()
            for block, cell, rows in runs_of(batch):
                own = other_tree[rows]
                single = own[0] if (own == own[0]).all() else None
                for start in range(0, len(nodes), TILE_QUESTIONS):
                    tile = slice(start, start + TILE_QUESTIONS)
                    may = zones.reach(vectors[tile], block, cell) ** 2 / 2 <= bound[place[tile]] + SLACK
                    may &= core[tile] <= bound[place[tile]]
                    if single is not None:
                        may &= tree[tile] != single
                    ask = np.flatnonzero(may) + start
                    if len(ask):
                        kept = join(kept, bound, ask, others[rows], points[rows], other_core[rows], own)
        yield pa.record_batch([pa.array(names[kept[0]]), *map(pa.array, kept[1:])], ["tree", "weight", "a", "b"])

    def join(kept, bound, ask, others, points, other_core, other_tree):
        rough = np.maximum(np.maximum(1.0 - vectors[ask] @ points.T, core[ask][:, None]), other_core[None, :])
        rough[tree[ask][:, None] == other_tree[None, :]] = np.inf
        least = bound[place[ask]]
        np.minimum.at(best_of := bound.copy(), place[ask], rough.min(axis=1))
        i, j = np.nonzero((rough <= np.minimum(least, best_of[place[ask]])[:, None] + SLACK) & np.isfinite(rough))
        if not len(i):
            return kept
        i = ask[i]
        weight = np.maximum(np.maximum(distances(vectors, points, i, j), core[i]), other_core[j])
        a, b = np.minimum(nodes[i], others[j]), np.maximum(nodes[i], others[j])
        together = [np.concatenate(x) for x in zip(kept, (place[i], weight, a, b))]
        best = first_of_each(together[0], together[1:], 1)
        together = [x[best] for x in together]
        bound[together[0]] = np.minimum(bound[together[0]], together[1])
        return together

    columns = table.select("block", "cell", "node", "vector", "core", "tree")
    return columns.mapInArrow(scan, "tree bigint, weight double, a bigint, b bigint")


def _shortest(edges: DataFrame) -> DataFrame:
    """Per tree its shortest edge out, ties by its ends: (tree, weight, a, b)."""
    return edges.groupBy("tree").agg(F.min(F.struct("weight", "a", "b")).alias("e")).select("tree", "e.*")


def _portions(asking: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of nodes, each with at most ``size`` of the asking points, so that few points make few scans."""
    counts = asking.groupBy(F.floor(F.col("node") / size).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    out: list[tuple[int, int]] = []
    held = 0
    for part, n in counts:  # one row per slice of nodes
        start, stop = part * size, (part + 1) * size
        if out and held + n <= size:
            out[-1], held = (out[-1][0], stop), held + n
        else:
            out.append((start, stop))
            held = n
    return out


def _outgoing(index: Index, edges: DataFrame, reach: DataFrame, trees: DataFrame, slice_size: int) -> DataFrame:
    """(tree, weight, a, b): the shortest edge that leaves each tree, among all pairs of points.

    The neighbour graph's ``edges`` give a bound.  A point can beat it only if the farthest of
    its listed neighbours (``reach``) is nearer than the bound: such points ask all blocks.
    """
    spark = edges.sparkSession
    end_a = trees.select(F.col("node").alias("a"), F.col("tree").alias("tree_a"))
    end_b = trees.select(F.col("node").alias("b"), F.col("tree").alias("tree_b"))
    leaving = edges.join(end_a, "a").join(end_b, "b").filter("tree_a <> tree_b")
    sides = leaving.select(F.col("tree_a").alias("tree"), "weight", "a", "b").union(
        leaving.select(F.col("tree_b").alias("tree"), "weight", "a", "b"))
    listed = written(_shortest(sides), "listed-edges")
    bounds = listed.select("tree", F.col("weight").alias("bound"))
    joined = (
        index.table.select("node", "vector", "block", "cell").join(reach, "node").join(trees, "node")
        .join(bounds, "tree", "left").withColumn("bound", F.coalesce("bound", F.lit(np.inf))))
    points = written(joined.repartitionByRange("node").sortWithinPartitions("node"), "reach-points")
    asking = points.filter(F.col("farthest") < F.col("bound"))
    portions = _portions(asking, slice_size)
    if not portions:
        return listed
    path = scratch_path(spark, "outgoing")
    schema = "tree bigint, weight double, a bigint, b bigint"
    listed.write.parquet(path)
    for start, stop in portions:
        part = asking.filter(F.col("node").between(start, stop - 1)).orderBy("node").select(
            "node", "vector", "core", "tree", "bound").toArrow()
        asked = {c: part.column(c).to_numpy() for c in ("node", "core", "tree", "bound")}
        asked["vector"] = matrix(part.column("vector"))
        blocks = needed_blocks(index, asked["vector"], asked["bound"])
        _scan_outgoing(index.zones, index.of_blocks(points, blocks), asked).write.mode("append").parquet(path)
    return written(_shortest(spark.read.schema(schema).parquet(path)), "outgoing-edges")


def _hooked(chosen: DataFrame, trees: DataFrame, rounds: Rounds) -> DataFrame:
    """The trees after every tree has hooked on along its chosen edge: (node, tree).

    Ties are broken by the edge's ends, so two trees can only choose each other; then
    the smaller name stays.
    """
    pairs = chosen.select("tree", "a", "b").join(
        trees.select(F.col("node").alias("a"), F.col("tree").alias("tree_a")), "a").join(
        trees.select(F.col("node").alias("b"), F.col("tree").alias("tree_b")), "b")
    names = trees.select(F.col("tree").alias("node")).distinct()
    labels = lowest_labels(names, pairs.select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b")))
    merged = labels.select(F.col("node").alias("tree"), F.col("label"))
    return rounds.write(trees.join(merged, "tree").select("node", F.col("label").alias("tree")))


def reach_forest(index: Index, graph: DataFrame, min_points: int, slice_size: int = SLICE) -> DataFrame:
    """(a, b, weight): the edges of the spanning tree of least mutual reach over all points of the index.

    Exact: the neighbour graph only saves work.  Of edges with equal reach the one with the
    smaller ends counts, so the result is unique.
    """
    spark = index.table.sparkSession
    cores = written(core_distances(index, graph, min_points), "cores")
    edges = written(_edges_of(graph, cores), "reach-edges")
    farthest = graph.groupBy("node").agg(F.max("distance").alias("farthest"))
    reach = written(cores.join(farthest, "node", "left").select("node", "core", F.coalesce("farthest", F.lit(0.0)).alias("farthest")), "reach")
    rounds = Rounds(spark, "reach-trees")
    trees = rounds.write(index.table.select("node", F.col("node").alias("tree")))
    path = scratch_path(spark, "reach-forest")
    schema = "a bigint, b bigint, weight double"
    spark.createDataFrame([], schema).write.parquet(path)
    for _ in range(MAX_ROUNDS):
        if trees.agg(F.count_distinct("tree")).first()[0] <= 1:
            return spark.read.schema(schema).parquet(path)
        chosen = _outgoing(index, edges, reach, trees, slice_size)
        chosen.select("a", "b", "weight").distinct().write.mode("append").parquet(path)
        trees = _hooked(chosen, trees, rounds)
    raise ValueError(f"forest not complete after {MAX_ROUNDS} rounds")


# --- stable clusters -------------------------------------------------------------


def rungs_of(forest: DataFrame, count: int) -> list[float]:
    """A ladder of distances: quantiles of the forest's edges, the longest one last."""
    shares = [i / count for i in range(1, count + 1)]
    found = forest.agg(F.percentile_approx("weight", shares, 100 * count)).first()[0]
    return sorted({d for d in found or [] if d > 0})


def _ladder(forest: DataFrame, nodes: DataFrame, rungs: Sequence[float], min_size: int) -> DataFrame:
    """(rung, node, cluster): the cluster of every point on every rung, if it has ``min_size`` points there."""
    steps = F.array(*[F.lit(d) for d in rungs])
    numbered = F.transform(steps, lambda d, i: F.struct(d.alias("distance"), i.cast("int").alias("rung")))
    edges = forest.select("a", "b", F.explode(F.filter(numbered, lambda s: s.distance >= F.col("weight"))).alias("s")).select(
        "s.rung", "a", "b")
    every = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(len(rungs) - 1))).alias("rung"), "node")
    labels = written(lowest_labels(every, edges, ["rung"]).withColumnRenamed("label", "cluster"), "rung-clusters")
    large = labels.groupBy("rung", "cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labels.join(written(large, "large-clusters"), ["rung", "cluster"]).select("rung", "node", "cluster", "size")


def stable_clusters(index: Index, forest: DataFrame, min_size: int, rungs: Sequence[float]) -> DataFrame:
    """(node, cluster): the most stable cluster of each point, NULL for noise; a cluster is named by its smallest node.

    ``rungs`` are rising distances.  A cluster on a rung is a component of at least
    ``min_size`` points.  Going to the next tighter rung it lives on if one such component
    is left of it, ends if none is, and is followed by new clusters if there are several.
    Its mass is the sum over its rungs of its points there times the gain in density
    (1 / distance, against the next wider rung).  Clusters are chosen so that the summed
    mass is greatest and none lies within another (ties: the wider one); what lives on
    the widest rung is the whole and never chosen.
    """
    if not 1 <= len(rungs) <= MAX_RUNGS or list(rungs) != sorted(set(rungs)) or rungs[0] <= 0:
        raise ValueError(f"1 to {MAX_RUNGS} rising positive distances")
    nodes = index.table.select("node")
    members = written(_ladder(forest, nodes, rungs, min_size), "members")
    stages = written(members.select("rung", "cluster", "size").distinct(), "stages")
    # A cluster's smallest node names it; on the next wider rung it lies in that node's cluster.
    wider = members.select((F.col("rung") - 1).alias("rung"), F.col("node").alias("cluster"), F.col("cluster").alias("up"))
    linked = written(stages.join(wider, ["rung", "cluster"], "left"), "stages-up")
    children = linked.filter("up is not null").groupBy((F.col("rung") + 1).alias("rung"), F.col("up").alias("cluster")).agg(
        F.count(F.lit(1)).alias("children"))
    gain = F.array(*[F.lit(1 / d - (1 / rungs[i + 1] if i + 1 < len(rungs) else 0.0)) for i, d in enumerate(rungs)])
    born = linked.join(children.select((F.col("rung") - 1).alias("rung"), F.col("cluster").alias("up"), "children"), ["rung", "up"], "left")
    born = written(born.select(
        "rung", "cluster", "up", (F.col("size") * gain[F.col("rung")]).alias("mass"),
        (F.col("up").isNull() | (F.coalesce("children", F.lit(0)) > 1)).alias("new")), "born")
    # From the widest rung down: a stage takes the life of the one it continues.
    rounds = Rounds(index.table.sparkSession, "lives")
    lives = None
    for rung in range(len(rungs) - 1, -1, -1):
        here = born.filter(F.col("rung") == rung)
        name = F.concat_ws(":", F.col("rung"), F.col("cluster"))
        if lives is None:
            now = here.select("rung", "cluster", "mass", name.alias("life"), F.lit(None).cast("string").alias("parent"))
            lives = rounds.write(now)
            continue
        above = lives.filter(F.col("rung") == rung + 1).select(
            F.col("cluster").alias("up"), F.col("life").alias("up_life"), F.col("parent").alias("up_parent"))
        now = here.join(above, "up", "left").select(
            "rung", "cluster", "mass", F.when(F.col("new"), name).otherwise(F.col("up_life")).alias("life"),
            F.when(F.col("new"), F.col("up_life")).otherwise(F.col("up_parent")).alias("parent"))
        lives = rounds.write(lives.unionByName(now))
    own = written(lives.groupBy("life", "parent").agg(F.sum("mass").alias("mass"), F.max("rung").alias("since")), "masses")
    # From the tightest birth up: the greater of a life's own mass and what its children hold.
    held = Rounds(index.table.sparkSession, "held")
    best = None
    for rung in range(len(rungs)):
        here = own.filter(F.col("since") == rung)
        if best is None:
            now = here.select("life", "parent", F.col("mass").alias("value"), F.lit(True).alias("chosen"))
            best = held.write(now)
            continue
        below = best.groupBy(F.col("parent").alias("life")).agg(F.sum("value").alias("below"))
        now = here.join(below, "life", "left").select(
            "life", "parent", F.greatest("mass", F.coalesce("below", F.lit(0.0))).alias("value"),
            (F.col("mass") >= F.coalesce("below", F.lit(0.0))).alias("chosen"))
        best = held.write(best.unionByName(now))
    chosen = best.filter(F.col("chosen") & F.col("parent").isNotNull()).select("life")
    named = lives.join(chosen, "life").groupBy("life").agg(F.max(F.struct("rung", "cluster")).alias("widest"))
    placed = lives.join(named, "life").select("rung", "cluster", "widest")
    found = members.join(placed, ["rung", "cluster"]).groupBy("node").agg(
        F.max(F.struct("widest.rung", "widest.cluster")).alias("w")).select("node", F.col("w.cluster").alias("cluster"))
    return written(nodes.join(found, "node", "left"), "stable-clusters")
