"""Quality: learning reads every passage of the sampled documents; scores equal a plain computation."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadstats.llm import quality as Q

DOCS = "doc_id bigint, text string, lang string, label int, score string"


def _long(seed, bad):
    """About forty passages; a bad document is bad in one of them only."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefghij ") for _ in range(Q.PASSAGE)) for _ in range(40)]
    if bad:
        parts[rng.randrange(40)] = "$$%%##@@" * (Q.PASSAGE // 8)
    return "".join(parts)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, _long(i, i % 2 == 1), "en", 7, "clash") for i in range(160)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(160)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_a_single_passage_of_forty_is_learnt(tables):
    docs, labels = tables
    model = Q.train(docs, labels)
    got = {r["doc_id"]: r for r in Q.quality(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held)
    assert np.mean([(got[i]["score"] > 0.5) == (i % 2 == 0) for i in held]) >= 0.9


def _plain(model, text):
    """One document's score, passage by passage in plain Python."""
    raw = text.encode()
    bags = [raw[i:i + Q.PASSAGE] for i in range(0, max(len(raw), 1), Q.PASSAGE)]
    hs, gates = [], []
    for bag in bags:
        row = Q.passages([bag])[0][0]
        assert len(Q.passages([bag])[1]) == 1
        x = (row - model["mean"]) / model["spread"]
        h = np.array([math.tanh(v) for v in x @ model["W"] + model["b"]])
        gate = sum(w * math.tanh(a) / (1 + math.exp(-b)) for w, a, b in zip(model["w"], h @ model["V"], h @ model["U"]))
        hs.append(h), gates.append(gate)
    weights = [math.exp(g - max(gates)) for g in gates]
    z = sum(w * h for w, h in zip(weights, hs)) / sum(weights)
    return 1 / (1 + math.exp(-(z @ model["c"] + model["d"][0])))


def test_scores_equal_the_plain_computation(spark, tables):
    docs, labels = tables
    model = Q.train(docs, labels)
    odd = spark.createDataFrame([(500, None, "", 0, ""), (501, "", "", 0, ""), (None, "x y", "", 0, ""), (502, "é" * 5000, "", 0, ""),
                                 (502, "é" * 5000, "", 0, "")], DOCS)
    some = docs.filter("doc_id < 6").union(odd)
    text = {(r["doc_id"]): r["text"] or "" for r in some.collect()}
    got = Q.quality(some, model).collect()
    assert len(got) == 11
    for r in got:
        assert abs(r["score"] - _plain(model, text[r["doc_id"]])) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_the_bound_is_on_documents(tables):
    docs, labels = tables
    model = Q.train(docs, labels, max_passages=2000)
    assert np.isfinite(model["c"]).all()
    assert Q.quality(docs.limit(0), model).count() == 0
    empty = Q.train(docs.limit(0), labels)
    assert Q.quality(docs, empty).count() == 160


def test_a_very_long_text(spark, tables):
    docs, labels = tables
    model = Q.train(docs, labels)
    long = spark.createDataFrame([(1, "word " * 1_000_000, "", 0, "")], DOCS)
    assert 0 <= Q.quality(long, model).first()["score"] <= 1
