"""Hard negatives against all pairs in plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadstats.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, rank string"


def _plain(rows, anchor, scale=256, positives=5, negatives=10):
    x = {i: ([math.floor(scale * float(np.float32(c))) for c in v], l) for i, v, l in rows}
    out = set()
    for a in [i for i in x if anchor(i)]:
        scores = sorted((-sum(p * q for p, q in zip(x[a][0], x[b][0])), b) for b in x if b != a)
        same = [(s, b) for s, b in scores if x[b][1] == x[a][1]][:positives]
        other = [(s, b) for s, b in scores if x[b][1] != x[a][1]]
        for ps, p in same:
            fit = [(s, b) for s, b in other if 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out |= {(a, p, k + 1, b, -ps, -s) for k, (s, b) in enumerate(fit)}
    return out


def _rows(n=400, width=10, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(i, (centres[i % 6] + 0.6 * rng.normal(size=width)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(60)]  # copies, so ties
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("block,slice_size", [(16, 7), (64, 1000), (100_000, 3)])
def test_equals_all_pairs(spark, block, slice_size):
    rows = _rows()
    got = H.mine(_frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, F.col("label"),
                 block=block, slice_size=slice_size)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _plain(rows, lambda i: i % 10 == 0)


def test_odd_rows_take_no_part(spark):
    rows = _rows(120)
    odd = [(10, None, 1), (None, rows[0][1], 1), (2000, rows[0][1], None), (2100, [float("nan")] * 10, 1),
           (2200, [None] * 10, 1), (2300, [1.0] * 3, 1), (2400, [1e30] * 10, 1), (2500, [], 1)]
    clean = [r for r in rows if r[0] != 10] + [(10, rows[10][1], rows[10][2])]
    frame = _frame(spark, rows + odd + rows[:5])
    got = {tuple(r) for r in H.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"), block=32).collect()}
    assert got == _plain(clean, lambda i: i % 10 == 0)
    assert H.mine(frame.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert H.mine(frame, F.col("vec_id") < 0, F.col("label")).count() == 0
    assert H.mine(frame.filter("vec_id = 0"), F.col("vec_id") == 0, F.col("label")).count() == 0


def test_the_curve_visits_every_cell_by_single_steps():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[range(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = H.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_bounds_hold_and_leave_blocks_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i, (centres[i % 8] + 0.05 * rng.normal(size=6)).tolist(), i % 8) for i in range(800)]
    frame = _frame(spark, rows).select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x * 256).cast("int")).alias("vector"))
    table = H.ordered_blocks(frame, 6, 50)
    zones = H.zone_maps(table, 6)
    stored = table.orderBy("position").collect()
    assert [r["position"] for r in stored] == list(range(800))
    assert {r["block"] for r in stored} == set(range(16))
    anchors = np.array([stored[i]["vector"] for i in (0, 400)])
    low, high = zones.bounds(anchors, np.arange(16))
    for r in stored:
        score = anchors @ np.array(r["vector"])
        assert (low[:, r["block"]] <= score).all() and (score <= high[:, r["block"]]).all()
    labels = np.array([stored[i]["label"] for i in (0, 400)])
    own = (anchors * anchors).sum(1)[:, None]
    asked = H.Slice(np.array([-1, -2]), labels, anchors, True, own * 9 // 10, own * 2)
    assert len(H.needed_blocks(spark, zones, asked)) <= 8


def test_scores_beyond_double_precision_are_exact():
    a, b = np.full((1, 64), (1 << 27) - 1), np.full((1, 64), (1 << 27) - 3)
    assert int(H.products(a, b)[0, 0]) == 64 * ((1 << 27) - 1) * ((1 << 27) - 3)
