"""Interval labels, running sums and the first rows against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from threadstats.operators import intervals as T
from threadstats.operators.numbering import first_rows, running_sum

SCHEMA = "entry_id string, parent_id string, submission_id string, n int"


def _forest(seed, n=120, roots=4):
    rng = random.Random(seed)
    rows, members = [], {}
    for r in range(roots):
        root = f"s{r}"
        members[root] = [root]
        if r:  # the first submission is missing
            rows.append((root, None, root, rng.randrange(5)))
    for i in range(n):
        root = rng.choice(list(members))
        parent = members[root][-1] if rng.random() < 0.4 else rng.choice(members[root])
        rows.append((f"c{rng.randrange(10**6)}x{i}", parent, root, rng.randrange(5)))
        members[root].append(rows[-1][0])
    return rows


def _walk(rows):
    below = {}
    for e, p, s, _ in rows:
        below.setdefault(p, []).append(e)
    known = {r[0] for r in rows}
    roots = sorted({r[2] for r in rows})
    labels, count = {}, 0

    def visit(entry, depth):
        nonlocal count
        start, count = count, count + 1
        for child in sorted(below.get(entry, [])):
            visit(child, depth + 1)
        labels[entry] = (start, count - 1, depth)

    for root in roots:
        visit(root, 0)
    return labels, known


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_are_those_of_a_walk(spark, seed):
    rows = _forest(seed)
    entries = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = T.interval_labels(entries)
    labels, known = _walk(rows)
    assert {r["entry_id"]: (r["start"], r["stop"], r["depth"]) for r in got.collect()} == labels
    assert {r["entry_id"] for r in got.filter("is_entry").collect()} == known
    of = spark.createDataFrame([(e,) for e in sorted(labels)[::3]], "entry_id string")
    found = {(r["of_id"], r["entry_id"], r["depth"]) for r in T.descendants_by_range(got, of).collect()}
    wanted = {(a, e, labels[e][2] - labels[a][2]) for a in sorted(labels)[::3] for e in known
              if labels[a][0] < labels[e][0] <= labels[a][1]}
    assert found == wanted
    value = {r[0]: r[3] for r in rows}
    sums = {r["entry_id"]: r["total"] for r in T.range_sums(got, entries, "n").collect()}
    assert sums == {a: sum(value[e] for e in known if labels[a][0] <= labels[e][0] <= labels[a][1]) for a in known}


def test_no_entries(spark):
    assert T.interval_labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_sums(spark):
    rows = spark.range(3000).select(F.col("id"), ((F.col("id") * 31) % 17 - 5).alias("n"))
    got = running_sum(rows.repartition(5), ["id"], "n").orderBy("id").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["running"] == total
    assert running_sum(rows.limit(0), ["id"], "n").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 50, 99, 100, 1000])
def test_first_rows(spark, n):
    data = [(None if i % 10 == 0 else i % 7, i % 3, i) for i in range(100)]
    frame = spark.createDataFrame(data, "day int, kind int, id int").repartition(3)
    got = {tuple(r) for r in first_rows(frame, n, ["day", "kind", "id"]).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got == set(order[:n])
    plan = first_rows(frame, 50, ["day", "kind", "id"])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
