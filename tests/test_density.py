"""Neighbours, mutual reach and stable clusters against plain computations over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadstats.operators import density as K
from threadstats.operators import neighbours as N
from threadstats.operators.components import lowest_labels


def _points(n=240, width=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = np.concatenate([centres[i % 5] + rng.normal(scale=(0.05, 0.1, 0.2, 0.4, 0.8)[i % 5], size=width)[None] for i in range(n)])
    rows = np.concatenate([rows, np.repeat(rows[:1], 12, axis=0)])  # copies
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def indexed(spark):
    rows = _points()
    frame = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, vector array<double>")
    index = N.build(frame.repartition(3), "vec_id", block=32)
    ids = [r["vec_id"] for r in index.table.orderBy("node").collect()]
    return index, N.neighbour_graph(index, 6, slice_size=50), rows[np.array(ids) - 100]


def _distances(rows):
    far = np.maximum(1 - np.einsum("ik,jk->ij", rows, rows), 0)
    np.fill_diagonal(far, np.inf)
    return far


def test_neighbours_equal_all_pairs(indexed):
    index, graph, rows = indexed
    far = _distances(rows)
    got = graph.collect()
    assert len(got) == 6 * len(rows)
    wanted = np.sort(far, axis=1)
    for r in got:
        assert abs(r["distance"] - wanted[r["node"], r["rank"] - 1]) < 1e-12
        assert abs(far[r["node"], r["other"]] - r["distance"]) < 1e-12
    assert len({(r["node"], r["other"]) for r in got}) == len(got)


def test_zones_leave_far_blocks_out(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    rows = np.repeat(centres, 100, axis=0) + rng.normal(scale=0.005, size=(800, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, vector array<double>")
    index = N.build(frame, "vec_id", block=50)
    some = index.table.filter("node < 50").select("vector").toArrow()
    near = N.needed_blocks(index, N.matrix(some.column("vector")), np.full(50, 0.001))
    assert 0 < len(near) <= 6


def _reach(rows, min_points):
    far = _distances(rows)
    core = np.sort(far, axis=1)[:, min_points - 2]
    return np.maximum(np.maximum(core[:, None], core[None, :]), far)


def _spanning(reach):
    """Kruskal's way."""
    n = len(reach)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = []
    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            edges.append((w, a, b))
    return edges


@pytest.fixture(scope="module")
def forest(indexed):
    index, graph, rows = indexed
    return K.reach_forest(index, graph, 4, slice_size=70)


def test_forest_has_the_least_weight(indexed, forest):
    index, graph, rows = indexed
    reach = _reach(rows, 4)
    got = forest.collect()
    assert len(got) == len(rows) - 1
    assert all(abs(reach[r["a"], r["b"]] - r["weight"]) < 1e-12 for r in got)
    assert abs(sum(r["weight"] for r in got) - sum(w for w, *_ in _spanning(reach))) < 1e-9
    cores = {r["node"]: r["core"] for r in K.core_distances(index, graph, 4).collect()}
    assert all(abs(cores[i] - c) < 1e-12 for i, c in enumerate(np.sort(_distances(rows), axis=1)[:, 2]))


def _plain_clusters(n, edges, rungs, min_size):
    """The same ladder, by sets of nodes."""
    levels = []
    for d in rungs:
        label = list(range(n))
        for _ in range(n):
            before = label[:]
            for w, a, b in edges:
                if w <= d:
                    label[a] = label[b] = min(label[a], label[b])
            if label == before:
                break
        groups = {}
        for x, l in enumerate(label):
            groups.setdefault(l, set()).add(x)
        levels.append([frozenset(g) for g in groups.values() if len(g) >= min_size])
    density = [1 / d for d in rungs] + [0.0]

    def life(level, group):
        """Mass of the life that begins with this group, and the lives that follow it."""
        mass = 0.0
        while True:
            mass += len(group) * (density[level] - density[level + 1])
            inside = [g for g in levels[level - 1] if g <= group] if level else []
            if len(inside) != 1:
                return mass, [(level - 1, g) for g in inside]
            level, group = level - 1, inside[0]

    def choose(level, group, whole):
        mass, after = life(level, group)
        below = [choose(l, g, False) for l, g in after]
        held = sum(v for v, _ in below)
        if not whole and mass >= held - 1e-12:
            return mass, [group]
        return held, [g for _, gs in below for g in gs]

    label = [None] * n
    for group in levels[-1]:
        for g in choose(len(rungs) - 1, group, True)[1]:
            for x in g:
                label[x] = min(g)
    return label


@pytest.mark.parametrize("min_size,count", [(4, 10), (8, 25)])
def test_stable_clusters_equal_the_plain_ladder(indexed, forest, min_size, count):
    index, _, rows = indexed
    rungs = K.rungs_of(forest, count)
    got = {r["node"]: r["cluster"] for r in K.stable_clusters(index, forest, min_size, rungs).collect()}
    edges = [(r["weight"], r["a"], r["b"]) for r in forest.collect()]
    wanted = _plain_clusters(len(rows), edges, rungs, min_size)
    assert [got[i] for i in range(len(rows))] == wanted
    assert len({c for c in wanted if c is not None}) > 1


def test_small_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, vector array<double>")
    index = N.build(one, "vec_id")
    graph = N.neighbour_graph(index, 3)
    assert graph.count() == 0
    forest = K.reach_forest(index, graph, 3)
    assert forest.count() == 0
    assert K.stable_clusters(index, forest, 2, [0.5]).collect()[0]["cluster"] is None
    with pytest.raises(ValueError):
        K.stable_clusters(index, forest, 2, [0.5, 0.1])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    nodes = sorted({x for e in edges for x in e})
    shuffled = np.random.default_rng(1).permutation(10_000)
    edges = [(int(shuffled[a]), int(shuffled[b])) for a, b in edges]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    names = spark.createDataFrame([(int(shuffled[x]),) for x in nodes], "node bigint")
    got = {r["node"]: r["label"] for r in lowest_labels(names, frame).collect()}
    path = {int(shuffled[i]) for i in range(301)}
    star = {int(shuffled[1000 + i]) for i in range(200)}
    for x, label in got.items():
        assert label == (min(path) if x in path else min(star) if x in star else x)


def test_few_asking_points_are_asked_at_once(spark):
    nodes = [3, 15, 27, 39, 41, 42, 43, 44, 45, 70, 99]
    asking = spark.createDataFrame([(n,) for n in nodes], "node bigint")
    portions = K._portions(asking, 10)  # the slices hold 1, 1, 1, 1, 5, 1 and 1 of them
    assert portions == [(0, 80), (90, 100)]
    assert all(sum(a <= n < b for n in nodes) <= 4 for a, b in K._portions(asking, 4))
    assert sorted(n for a, b in portions for n in nodes if a <= n < b) == nodes
    assert K._portions(asking.limit(0), 10) == []


def test_a_tile_sorts_no_lists_but_its_own(monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)

    class Table:
        def select(self, *names):
            return self

        def mapInArrow(self, scan, schema):
            return scan

    batch = pa.record_batch([pa.array(np.zeros(300, np.int64)), pa.array(np.arange(300) // 30), pa.array(np.arange(300)),
                             pa.array(list(points))], ["block", "cell", "node", "vector"])
    zones = N.Zones(np.zeros((10, 6)), {(0, c): (0.0, 9.0) for c in range(10)})
    sorted_rows, plain = [], N.first_of_each
    monkeypatch.setattr(N, "TILE_QUESTIONS", 20)
    monkeypatch.setattr(N, "first_of_each", lambda group, order, k: sorted_rows.append(len(group)) or plain(group, order, k))
    scan = N._scan_nearest(zones, Table(), np.arange(300), points, np.full(300, 2.0), 3)
    (found,) = scan(iter([batch]))
    assert max(sorted_rows) <= 20 * (3 + 3)
    got = {}
    for node, other, distance in zip(*(found.column(c).to_pylist() for c in range(3))):
        got.setdefault(node, []).append((distance, other))
    for node in range(300):
        far = np.maximum(1 - points @ points[node], 0)
        assert [o for _, o in got[node]] == [o for o in np.lexsort([np.arange(300), far]).tolist() if o != node][:3]
