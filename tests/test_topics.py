"""Topics and Pearson clusters over large vocabularies, against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadstats.operators import topics as L


def _counts(n_docs=24, n_terms=7000, seed=1):
    rng = np.random.default_rng(seed)
    matrix = np.zeros((n_docs, n_terms))
    for d in range(n_docs):
        own = rng.integers(0, n_terms, 600) if d % 2 else rng.integers(n_terms // 3, n_terms // 2, 600)
        np.add.at(matrix[d], own, rng.integers(1, 9, 600))
    matrix[0, matrix.sum(0) == 0] = 1  # every term occurs
    return matrix


def _frame(spark, matrix):
    d, t = np.nonzero(matrix)
    return spark.createDataFrame([(int(a), f"w{b}", int(matrix[a, b])) for a, b in zip(d, t)], "doc int, term string, n int")


def test_topics_equal_the_plain_rounds(spark):
    matrix = _counts()
    k, n_terms = 3, matrix.shape[1]
    phi = np.array([[int(hashlib.md5(f"w{t}".encode()).hexdigest()[2 * i:2 * i + 2], 16) / 255 + 1 for t in range(n_terms)]
                    for i in range(k)])
    theta = np.ones((len(matrix), k))
    for _ in range(4):
        share = theta[:, :, None] * phi[None]
        share = matrix[:, None, :] * share / share.sum(1, keepdims=True)
        phi = share.sum(0) + 0.01
        phi /= phi.sum(1, keepdims=True)
        theta = share.sum(2) + 0.1
        theta /= theta.sum(1, keepdims=True)
    got = L.topic_terms(_frame(spark, matrix), "doc", k, rounds=4).collect()
    assert len(got) == k * n_terms  # more terms than any limit of old
    for r in got:
        assert abs(r["beta"] - phi[r["topic"] - 1, int(r["term"][1:])]) < 1e-12
    with pytest.raises(ValueError):
        L.topic_terms(_frame(spark, matrix), "doc", 99)


def test_pearson_medoids_equal_the_dense_computation(spark):
    matrix = _counts()
    centred = matrix - matrix.mean(1, keepdims=True)
    unit = centred / np.linalg.norm(centred, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    got = L.pearson_distances(_frame(spark, matrix).repartition(3), "doc", [0, 1]).collect()
    assert len(got) == 2 * len(matrix)
    assert all(abs(r["distance"] - far[r["doc"], r["reference_id"]]) < 1e-9 for r in got)
    medoids, seen = [0, 1], set()
    while True:
        label = far[:, medoids].argmin(1)
        if frozenset(medoids) in seen:
            break
        seen.add(frozenset(medoids))
        medoids = sorted(int(np.flatnonzero(label == c)[far[np.ix_(label == c, label == c)].sum(1).argmin()]) for c in range(2))
    members, found = L.pearson_medoids(_frame(spark, matrix), "doc", 2)
    assert found == medoids
    assert {r["doc"]: r["medoid_id"] for r in members.collect()} == {i: medoids[c] for i, c in enumerate(label)}


def test_documents_without_direction_are_left_out(spark):
    frame = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "b", 5)], "doc int, term string, n int")
    assert {r["doc"] for r in L.centred_sizes(frame, "doc").collect()} == {2, 3}
    far = {(r["doc"], r["reference_id"]): r["distance"] for r in L.pearson_distances(frame, "doc", [1, 2]).collect()}
    assert set(far) == {(2, 2), (3, 2)} and abs(far[3, 2] - 2) < 1e-12


def test_clusters_name_their_leading_terms(spark):
    texts = [(f"a{i}", " ".join(["apple pear plum"] * (i + 1) + [f"fruit{i}x"])) for i in range(4)]
    texts += [(f"b{i}", " ".join(["river lake ocean"] * (i + 1) + [f"water{i}x"])) for i in range(4)]
    frame = spark.createDataFrame(texts, "author string, content string")
    top = L.cluster_terms(frame, "author", k=2, n_top=3).collect()
    assert len({r["cluster"] for r in top}) == 2
    assert any("appl" in r["term"] for r in top)


@pytest.mark.parametrize("held", [0, 2])
def test_topics_do_not_depend_on_the_broadcast(spark, monkeypatch, held):
    rows = [(d, t, 1 + (d * i) % 3) for d in range(6) for i, t in enumerate(["ship", "sail", "cat", "purr", "oak"]) if (d + i) % 2]
    counts = spark.createDataFrame([*rows, (None, "ship", 2)], "doc int, term string, n long")

    def fitted():
        return {(r.topic, r.term): r.beta for r in L.topic_terms(counts, "doc", 2, 3).collect()}

    broadcast = fitted()
    monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", held)
    assert fitted() == pytest.approx(broadcast)


def test_topics_write_no_shares(spark, monkeypatch):
    counts = spark.createDataFrame([(1, "ship", 2), (1, "sail", 1), (2, "cat", 1)], "doc int, term string, n long")
    shares = []
    write = L.Rounds.write

    def noted(self, df):
        table = write(self, df)
        if {"doc", "term"} <= set(table.columns):
            shares.append(table.filter("doc is not null and term is not null").count())
        return table

    monkeypatch.setattr(L.Rounds, "write", noted)
    L.topic_terms(counts, "doc", 2, 1).collect()
    assert not any(shares)
