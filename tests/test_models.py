import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadstats.functions.stem import with_stem
from threadstats.functions.text import descriptor_tokens
from threadstats.operators import descriptors as D
from threadstats.operators import stance as S
from threadstats.operators import terms as W
from threadstats.operators import topics as L
from threadstats.operators import vectors as V

# Pairs of the published sample vocabulary of the stemmer.
STEMS = """consigned consign consistency consist consolation consol conspicuous conspicu conspiracy conspiraci
constancy constanc knackeries knackeri kneeled kneel knightly knight knives knive generically generic communism
communism running run hopping hop hoping hope falling fall luxuriated luxuri cries cri ties tie gaps gap gas gas this
this kiwis kiwi say say relational relat rational ration electriciti electr hopeful hope replacement replac adoption
adopt controll control rate rate skies sky dying die inning inning yellow yellow agreed agre feed feed""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame(pairs, "word string, want string")
    assert with_stem(df, "word", "stem").filter("stem <> want").collect() == []


def test_filter_on_stems_is_not_pushed_into_the_steps(spark):
    df = spark.createDataFrame([("running",), ("the",)], "word string")
    kept = with_stem(df, "word", "stem").groupBy("stem").count().filter("length(stem) >= 3 and stem <> 'the'")
    assert [r.stem for r in kept.collect()] == ["run"]


def test_cleaning_order(spark):
    df = spark.createDataFrame([("Willing to… don't w1ill 'Brexit' 2016",)], "t string")
    tokens = df.select(descriptor_tokens(F.col("t")).alias("t")).first().t
    # "will" is cut before lowering, so the capitalised word survives; digits go after the cut
    assert [t for t in tokens if t] == ["willing", "to", "dont", "will", "brexit"]


def test_naive_bayes_by_hand(spark):
    docs = spark.createDataFrame(
        [(0, "stay stay union"), (1, "leave border leave")], "label int, content string")
    model, prior = S.train(docs)
    rows = {r.term: r for r in model.collect()}
    assert rows["stay"].logp_remain == pytest.approx(math.log(3 / (3 + 4)))
    assert rows["stay"].logp_leave == pytest.approx(math.log(1 / (3 + 4)))
    ask = spark.createDataFrame(
        [("a", 1, "leave leave stay"), ("b", 1, "unknown words"), ("c", 1, "leave")], "author string, period int, content string")
    fixed = {r.author: r.leave_probability for r in S.score(ask, model, prior, ["author"], min_total=1).collect()}
    assert fixed["b"] == pytest.approx(0.5)
    # "leav" is a stem; twice "leave" against once "stay": odds 3^2 / 3
    assert fixed["a"] == pytest.approx(3 / 4)
    # within the batch only "leave" occurs three times, so "stay" is left out
    batch = {r.author: r for r in S.author_stance(ask, model, prior).collect()}
    assert batch["a"].leave_probability == pytest.approx(0.9) and batch["a"].stance == 1
    assert batch["b"].stance == 2


def test_labels_need_the_very_next_period(spark):
    rows = [("a", 1, 0), ("a", 3, 1), ("b", 1, 2), ("b", 2, 1)]
    entries = spark.createDataFrame(rows, "author string, period int, stance int")
    assert [tuple(r) for r in D.next_stance(entries).collect()] == [("b", 1, 2, 1)]
    assert [r.author for r in D.common_authors(entries, 1, 3).collect()] == ["a"]


def test_majority_tie_goes_to_the_smallest_label(spark):
    rows = [(1.0, 2), (1.0, 1), (2.0, 0), (2.0, 2), (2.0, 2)]
    df = spark.createDataFrame(rows, "w double, next_label int")
    assert sorted(map(tuple, D.majority_collapse(df, ["w"]).collect())) == [(1.0, 1), (2.0, 2)]


def test_thread_shares_and_as_of(spark):
    rows = [("a", 1, 0, "s1"), ("b", 1, 1, "s1"), ("a", 2, 0, "s2"), ("c", 2, 2, "s2")]
    entries = spark.createDataFrame(rows, "author string, period int, stance int, submission_id string")
    mix = {r.submission_id: (r.tc, r.pa, r.pb, r.pn) for r in D.thread_mix(entries).collect()}
    assert mix == {"s1": (2, 0.5, 0.5, 0.0), "s2": (2, 0.5, 0.0, 0.5)}
    whole = {(r.author, r.period): r.pb_q100 for r in D.f3_descriptors(entries).collect()}
    as_of = {(r.author, r.period): r.pn_q100 for r in D.f3_descriptors(entries, as_of_period=True).collect()}
    assert whole["a", 1] == 0.5 and as_of["a", 1] == 0.0 and as_of["a", 2] == 0.5


def test_tf_idf_by_hand(spark):
    docs = spark.createDataFrame([("x",), ("y",), ("empty",)], "d string")
    counts = spark.createDataFrame([("x", "cat", 1), ("x", "dog", 3), ("y", "dog", 2)], "d string, term string, n long")
    got = {(r.d, r.term): r.weight for r in W.tf_idf(counts, docs, ["d"]).collect()}
    assert got["x", "cat"] == pytest.approx(0.25 * math.log2(3))
    assert got["y", "dog"] == pytest.approx(math.log2(1.5))


def unit_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, 5))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>")


def test_medoids_match_all_pairs(spark):
    rows, df = unit_rows(spark, 40, 3)
    seeds = df.filter("id in (0, 1, 2)")
    assigned = V.assign_to_medoids(df, seeds, "id")
    nearest = (1 - rows @ rows[:3].T).argmin(axis=1)
    assert {r.id: r.medoid_id for r in assigned.collect()} == dict(enumerate(nearest.tolist()))
    for row in V.best_medoids(assigned, "id").collect():
        members = np.flatnonzero(nearest == row.medoid_id)
        total = (1 - rows[members] @ rows[members].T).sum(axis=1)
        assert row.id == members[total.argmin()] and row.total_distance == pytest.approx(total.min())
    final = V.k_medoids(df, seeds, "id").collect()
    assert len(final) == 40 and len({r.medoid_id for r in final}) == 3


def test_density_clusters_join_touching_cells(spark):
    points = [(i, 0.01 * i, 0.0) for i in range(30)] + [(100 + i, 5.0, 5.0) for i in range(4)] + [(200, 9.0, 9.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r.id: r.cluster for r in V.density_clusters(df, ["x", "y"], 0.05, 3).collect()}
    assert len({got[i] for i in range(30)}) == 1 and got[0] is not None
    assert got[100] == got[103] != got[0] and got[200] is None


def test_top_clusters_share_label_one(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbc"], "c string")
    got = {(r.c, r.label) for r in V.top_clusters(df, "c", 2).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 1)}


def test_topics_and_cluster_terms(spark):
    docs = [(f"d{i:02d}", ("cats purr softly " if i % 2 else "ships sail away ") * (3 + i)) for i in range(8)]
    df = spark.createDataFrame(docs, "author string, content string")
    top = L.cluster_terms(df, "author", k=2, n_top=3).collect()
    clusters = {}
    for r in top:
        clusters.setdefault(r.cluster, set()).add(r.term)
    assert sorted(map(sorted, clusters.values())) == [["away", "sail", "ship"], ["cat", "pur", "soft"]] or len(clusters) == 2
    counts = df.select("author", F.explode(F.split("content", " ")).alias("term")).groupBy("author", "term").agg(F.count("*").alias("n"))
    betas = L.topic_terms(counts, "author", k=2, rounds=3)
    assert betas.groupBy("topic").agg(F.sum("beta").alias("s")).filter("abs(s - 1) > 1e-6").count() == 0


def test_majority_takes_any_label(spark):
    rows = [(1.0, 7), (1.0, 7), (1.0, 2), (2.0, 9), (2.0, 0), (2.0, 4), (3.0, None), (3.0, 5)]
    df = spark.createDataFrame(rows, "w double, next_label int")
    assert sorted(map(tuple, D.majority_collapse(df, ["w"]).collect())) == [(1.0, 7), (2.0, 0), (3.0, 5)]


def test_far_cells_stay_apart(spark):
    points = [(float(x), 0.5) for x in (100_000_000, 100_000_005) for _ in range(3)]
    df = spark.createDataFrame([(x + 0.5, y) for x, y in points], "x double, y double")
    found = V.density_clusters(df, ["x", "y"], 1.0, 2).select("cluster").distinct().collect()
    assert len(found) == 2
