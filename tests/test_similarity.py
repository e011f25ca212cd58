"""Similar pairs, medoids by swaps and landmark coordinates against plain computations."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadstats.operators import landmarks as A
from threadstats.operators import medoids as M
from threadstats.operators import similarity as Y
from threadstats.operators import vectors as V


def _documents(n=150, seed=4):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:  # a changed copy
            base = dict(rng.choice(docs))
            for _ in range(rng.randrange(0, 4)):
                base[f"w{rng.randrange(400)}"] = rng.randrange(1, 6)
            docs.append(base)
        else:
            docs.append({f"w{int(rng.paretovariate(0.6)) % 400}": rng.randrange(1, 6) for _ in range(rng.randrange(1, 25))})
    docs += [{"common": 1}] * 5 + [{"common": 3, "w1": 1}, {"w2": 0}]
    return docs


def _plain(docs, threshold):
    vectors = [{t: w for t, w in d.items() if w} for d in docs]
    first = {}
    for i, v in enumerate(vectors):
        if v:
            first.setdefault(frozenset(v.items()), i)
    out = {}
    for a, b in combinations(sorted(first.values()), 2):
        x, y = vectors[a], vectors[b]
        s = sum(w * y.get(t, 0) for t, w in x.items()) / (sum(w * w for w in x.values()) * sum(w * w for w in y.values())) ** 0.5
        if s >= threshold:
            out[a, b] = s
    return out


@pytest.mark.parametrize("threshold,block", [(0.5, 1000), (0.8, 4), (0.95, 2)])
def test_similar_pairs_equal_all_pairs(spark, threshold, block):
    docs = _documents()
    rows = [(i, t, w) for i, d in enumerate(docs) for t, w in d.items()]
    frame = spark.createDataFrame(rows, "doc bigint, term string, weight int").repartition(3)
    got = {(r["a"], r["b"]): r["similarity"] for r in Y.similar_pairs(frame, "doc", threshold, block=block).collect()}
    wanted = {p: s for p, s in _plain(docs, threshold - 1e-6).items()}
    assert {p for p, s in wanted.items() if s >= threshold + 1e-9} <= set(got) <= set(wanted)
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in got)
    assert got
    empty = Y.similar_pairs(frame.limit(0), "doc", threshold)
    assert empty.count() == 0


def test_prefixes_are_short_and_meet_without_a_cross_join(spark):
    rows = [(i, "common", 3.0) for i in range(300)] + [(i, f"rare{i}", 4.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc bigint, term string, weight double")
    vectors = Y.ordered_vectors(frame, "doc")
    indexed = Y.postings(vectors, "doc", 0.7).cache()
    assert indexed.count() == 300  # the common term, of length 0.6, is not indexed
    pairs = Y.candidates(indexed, "doc", 0.7)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_candidates_grow_with_the_rows(spark):
    counts = []
    for n in (400, 1600):
        rng = random.Random(n)
        rows = [(i, f"t{rng.randrange(n)}", 1.0) for i in range(n) for _ in range(12)] + [(i, "all", 1.0) for i in range(n)]
        frame = spark.createDataFrame(rows, "doc bigint, term string, weight double").groupBy("doc", "term").agg(F.max("weight").alias("weight"))
        indexed = Y.postings(Y.ordered_vectors(frame, "doc"), "doc", 0.8)
        counts.append(Y.candidates(indexed, "doc", 0.8).count() + n)
    assert np.log(counts[1] / counts[0]) / np.log(4) < 1.2


def _units(spark, n=200, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = np.stack([centres[i % 6] + rng.normal(scale=0.7, size=8) for i in range(n)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, vector array<double>"), rows


def test_no_exchange_improves_swapped_medoids(spark):
    frame, rows = _units(spark)
    seeds = frame.filter("vec_id < 5")
    placed, ids = M.swapped_medoids(frame, seeds, "vec_id")
    far = np.maximum(1 - rows @ rows.T, 0)
    total = far[:, ids].min(axis=1).sum()
    assert abs(placed.agg(F.sum("distance")).first()[0] - total) < 1e-9
    alternating = V.k_medoids(frame, seeds, "vec_id").agg(F.sum("distance")).first()[0]
    assert total <= alternating + 1e-9
    for out in range(5):
        rest = [m for m in ids if m != ids[out]]
        for c in range(len(rows)):
            assert far[:, [*rest, c]].min(axis=1).sum() >= total - 1e-8
    gains = {(r["medoid"], r["candidate"]): r["change"] for r in M.swap_gains(frame, rows[ids], rows[:30]).collect()}
    for (m, c), change in gains.items():
        rest = [x for i, x in enumerate(ids) if i != m]
        assert abs(far[:, [*rest, c]].min(axis=1).sum() - total - change) < 1e-9


def test_one_medoid_and_copies(spark):
    frame, rows = _units(spark, 30)
    both = frame.union(frame.select((F.col("vec_id") + 100).alias("vec_id"), "vector"))
    placed, ids = M.swapped_medoids(both, frame.filter("vec_id = 3"), "vec_id")
    far = np.maximum(1 - rows @ rows.T, 0)
    assert abs(far.sum(0).min() - far[:, ids[0] % 100].sum()) < 1e-9
    two = M.nearest_two(both, frame.filter("vec_id = 3"), "vec_id").first()
    assert two["medoid_id"] == 3 and two["second_id"] is None


def test_coordinates_keep_distances(spark):
    frame, rows = _units(spark)
    got = A.landmark_coordinates(frame, frame.filter("vec_id < 40"), 8, "vec_id").collect()
    placed = np.array([r["coordinates"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert np.allclose(np.linalg.norm(placed[:, None] - placed[None], axis=2), np.linalg.norm(rows[:, None] - rows[None], axis=2), atol=1e-9)
    few = A.landmark_coordinates(frame, frame.filter("vec_id < 40"), 3, "vec_id").collect()
    flat = np.array([r["coordinates"] for r in sorted(few, key=lambda r: r["vec_id"])])
    assert np.allclose(flat, placed[:, :3])
    short = np.linalg.norm(flat[:, None] - flat[None], axis=2) - np.linalg.norm(rows[:, None] - rows[None], axis=2)
    assert short.max() < 1e-6 and np.abs(short).mean() < 0.5
    assert A.landmark_coordinates(frame, frame.limit(0), 3, "vec_id").count() == 0


@pytest.mark.parametrize("meetings,dense", [(4_000_000, 16_000_000), (50, 200), (1, 1)])
def test_products_are_summed_in_any_portions(monkeypatch, meetings, dense):
    monkeypatch.setattr(Y, "MEETINGS", meetings)
    monkeypatch.setattr(Y, "DENSE", dense)
    rng = np.random.default_rng(3)
    full = rng.random((40, 60)) * (rng.random((40, 60)) < 0.15)
    full[:, 59] += 0.01  # no vector is empty
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    lists = [np.flatnonzero(v) for v in full]
    side = Y.Side(pa.array(lists, pa.list_(pa.int32())), pa.array([v[t] for v, t in zip(full, lists)]), 0.4, 60)
    parts = np.zeros_like(full)
    parts[side.row[side.kept], side.term[side.kept]] = side.unit[side.kept]
    found = {(x, y): s for a, b, sums in Y._products(side, side, 0.05, True) for x, y, s in zip(a.tolist(), b.tolist(), sums)}
    wanted = {(x, y) for x in range(40) for y in range(x) if (parts @ parts.T)[x, y] >= 0.05}
    assert set(found) == {(y, x) for x, y in wanted} and 20 < len(found) < 780
    assert all(abs(s - (parts @ parts.T)[p]) < 1e-12 for p, s in found.items())
    row, term = np.divmod(np.arange(40 * 60), 60)
    left = [np.linalg.norm(full[r, t + 1:]) for r, t in zip(row, term)]
    assert np.allclose(side.left_after(row, term), left)


def test_vectors_of_candidates_are_not_joined_to_pairs(spark):
    rows = [(i, f"w{(i * k) % 97}", float(k)) for i in range(1, 90) for k in range(1, 6)]
    frame = spark.createDataFrame(rows, "doc bigint, term string, weight double")
    assert "Join" not in Y.similar_pairs(frame, "doc", 0.6)._jdf.queryExecution().toString()


def test_vectors_are_read_in_place_and_not_sent_to_pairs_of_blocks(spark):
    rows = [(i, t, float(w)) for i, d in enumerate(_documents()) for t, w in d.items()]
    frame = spark.createDataFrame(rows, "doc bigint, term string, weight double")
    vectors = Y.ordered_vectors(frame, "doc")
    plans = [Y.products(vectors, "doc", 0.5, 0.4, block) for block in (1000, 15)]
    assert all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    whole, parts = (sorted((r.a, r.b, round(r.similarity, 9)) for r in p.collect()) for p in plans)
    assert whole == parts and whole and len({r[:2] for r in whole}) == len(whole)
