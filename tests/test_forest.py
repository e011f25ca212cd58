import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadstats.operators import forest as G

SCHEMA = "entry_id string, parent_id string, submission_id string, comment_id string, author string, period int, stance int"


def random_forest(seed, n):
    """Bushy and chain-like threads over few authors, with one author's replies to itself."""
    rng = random.Random(seed)
    rows, ids = [], defaultdict(list)
    for i in range(n):
        sub = f"s{rng.randrange(4)}"
        if not ids[sub]:
            rows.append((sub, None, sub, None, f"a{rng.randrange(5)}", 1, 0))
            ids[sub].append(sub)
            continue
        parent = ids[sub][-1] if sub == "s0" else rng.choice(ids[sub])
        rows.append((f"c{i}", parent, sub, f"c{i}", f"a{rng.randrange(5)}", rng.randrange(1, 4), 0))
        ids[sub].append(f"c{i}")
    return [(*r[:6], (int(r[4][1:]) + r[5]) % 3) for r in rows]


def brute_pairs(rows):
    parent = {r[0]: r[1] for r in rows}
    pairs = []
    for entry in parent:
        above, depth = parent[entry], 1
        while above is not None:
            pairs.append((above, entry, depth))
            above, depth = parent.get(above), depth + 1
    return pairs


@pytest.fixture(scope="module")
def sample(spark):
    rows = random_forest(7, 160)
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_reply_counts_match_brute_force(sample):
    rows, entries = sample
    about = {r[0]: r for r in rows}
    rd, r_all = defaultdict(int), defaultdict(int)
    for above, entry, depth in brute_pairs(rows):
        own = about[above][4] == about[entry][4]
        stance = about[entry][6]
        if depth == 1 and not own:
            rd[above, stance] += 1
        if depth > 1 or not own:
            r_all[above, stance] += 1
    for row in G.reply_counts(entries).collect():
        for stance in (0, 1, 2):
            assert row[G.DIRECT[stance]] == rd[row.entry_id, stance]
            assert row[G.ALL[stance]] == r_all[row.entry_id, stance]
        assert row.author == about[row.entry_id][4]


def test_subtree_size_positions_and_closure(sample):
    rows, entries = sample
    pairs = brute_pairs(rows)
    size, depth = defaultdict(lambda: 1), defaultdict(int)
    for above, entry, distance in pairs:
        size[above] += 1
        depth[entry] = max(depth[entry], distance)
    assert max(depth.values()) > 20  # the chain needs several doublings
    assert {r.entry_id: r.n_entries for r in G.subtree_size(entries).collect()} == {r[0]: size[r[0]] for r in rows}
    placed = {r.entry_id: (r.root_id, r.depth) for r in G.thread_positions(entries).collect()}
    assert placed == {r[0]: (r[2], depth[r[0]]) for r in rows}
    found = G.descendants(entries, entries.select("entry_id")).collect()
    assert sorted((r.of_id, r.entry_id, r.depth) for r in found) == sorted(pairs)
    asked = entries.filter("entry_id = 'c150' or parent_id = 's0'").select("entry_id")
    wanted = {r.entry_id for r in asked.collect()}
    path = G.path_to_root(entries, asked).filter("distance > 0").collect()
    assert sorted((r.entry_id, r.of_id, r.distance) for r in path) == sorted(p for p in pairs if p[1] in wanted)


def test_orphans_hang_on_the_submission_even_if_absent(spark):
    rows = [("s1", None, "s1", None), ("c1", "gone", "s1", "c1"), ("c2", "c1", "s1", "c2"), ("c3", "gone", "s9", "c3"), ("c4", "s9", "s9", "c4")]
    entries = spark.createDataFrame(rows, "entry_id string, parent_id string, submission_id string, comment_id string")
    got = {r.entry_id: r.parent_id for r in G.repair_orphans(entries).collect()}
    assert got == {"s1": None, "c1": "s1", "c2": "c1", "c3": "s9", "c4": "s9"}


def test_absent_submission_gets_no_row_but_is_a_root(spark):
    rows = [("c3", "s9", "s9", "c3", "a", 1, 0), ("c4", "c3", "s9", "c4", "a", 1, 0), ("c5", "c4", "s9", "c5", "a", 1, 1)]
    entries = spark.createDataFrame(rows, SCHEMA)
    counts = {r.entry_id: (r.rd_a + r.rd_b + r.rd_n, r.r_a, r.r_b) for r in G.reply_counts(entries).filter("author is not null").collect()}
    # own direct reply does not count, the own deeper reply does
    assert counts == {"c3": (0, 0, 1), "c4": (0, 0, 0), "c5": (0, 0, 0)}
    assert {(r.root_id, r.depth) for r in G.thread_positions(entries).collect()} == {("s9", 1), ("s9", 2), ("s9", 3)}
    assert {r.entry_id for r in G.descendants(entries, spark.createDataFrame([("s9",)], "entry_id string")).collect()} == {"c3", "c4", "c5"}


def test_cycles_are_reported(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_ROUNDS", 3)
    rows = [("c1", "c2", "s", "c1", "a", 1, 0), ("c2", "c1", "s", "c2", "a", 1, 0)]
    entries = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(G.CyclicForest):
        G.subtree_size(entries)


def test_no_cartesian_product(sample):
    _, entries = sample
    plan = G.replies_with_parent(entries)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert G.reply_counts(entries).agg(F.sum("r_a")).first()[0] >= 0
