"""Mixing against plain targets, and the properties of the sample."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadstats.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target double"


def _plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by source: shares by weight, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = whole - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > most * sizes[s]]
        if not above:
            return {**fixed, **got}
        fixed |= {s: most * sizes[s] for s in above}


def _docs(n=900, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.pareto(1.2) * 20) + 1 if i % 11 else 0
        source = [None, "b", "a", "é", "big", "tiny"][min(int(rng.exponential(1.5)), 4)] if i % 100 else "tiny"
        rows.append((i, " \n\t".join(f"W{j}" for j in range(size)), source, "clash", 0.5))
    rows += [(None, "no id", "b", "", 0.0)] * 7 + [rows[3], rows[3]] + [(5000, None, "a", "", 0.0)]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    rows = _docs()
    return rows, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), block=64).collect()


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_every_row_comes_back_with_its_size_and_target(mixed):
    rows, got = mixed
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += _size(r[1])
    targets = _plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], _size(r[1])) for r in rows)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - targets[source[r["doc_id"]]]) < 1e-6
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6


def test_words_taken_meet_the_targets(mixed):
    rows, got = mixed
    source = {r[0]: r[2] for r in rows}
    taken, target, cuts = Counter(), {}, Counter()
    for r in got:
        name = source[r["doc_id"]]
        taken[name] += r["taken"]
        target[name] = r["target"]
        cuts[name] += r["copies"] != int(r["copies"])
        rate = r["target"] / r["source_size"]
        assert r["taken"] == round(r["size"] * r["copies"])
        assert np.floor(rate) <= r["copies"] <= min(3, np.ceil(rate))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(1, 0.001 * target[s])
        assert cuts[s] <= 1
    assert cuts["é"] == 1  # one document holds most of its words
    assert sum(cuts.values()) < len(target)


def test_reruns_and_other_partitions_agree(spark, mixed):
    rows, got = mixed
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2), block=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_flight_keeps_both_totals_and_leaves_two_open():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 5000, 500), rng.random(500)
    p[::50], p[1::50] = 0, 1
    out = mixing.flight(sizes, p, np.random.default_rng(2), 0)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(sizes @ out - sizes @ p) < 1e-3
    mean = np.mean([mixing.flight(sizes[:12], p[:12], np.random.default_rng(s), 0) for s in range(4000)], axis=0)
    assert np.abs(mean - p[:12]).max() < 0.04  # every probability keeps its expectation


def test_landing_equals_all_choices():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            sizes, words, documents = rng.integers(0, 30, n), rng.random() * 15 * n, rng.random() * n
            best = min((abs(sum(s for i, s in enumerate(sizes.tolist()) if m >> i & 1) - words)) for m in range(1 << n))
            assert abs(abs(sizes @ mixing.landing(sizes, words, documents) - words) - best) < 1e-9


def test_hot_groups_of_alike_rows_are_split(spark):
    rows = [(None, "a b c", "x", "", 0.0)] * 9000 + [(1, "a", "y", "", 0.0)] * 50
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 9050
    by = defaultdict(int)
    for r in got:
        by[r["size"]] += r["taken"]
    target = {r["size"]: r["target"] for r in got}
    assert all(abs(by[s] - target[s]) <= 3 for s in target)


def test_nothing_and_empty_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "", 0.0), (2, " \n", None, "", 0.0)], SCHEMA)
    assert sorted(map(tuple, mixing.mix(blank).collect())) == [(1, 0, 0, 0.0, 0, 0.0), (2, 0, 0, 0.0, 0, 0.0)]
    long = spark.createDataFrame([(1, "w " * 500_000, "a", "", 0.0), (2, "w", "b", "", 0.0)], SCHEMA)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(long).collect()} == {1: 500_000, 2: 1}
