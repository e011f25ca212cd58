"""Toxicity: the bound on grams drops documents, never grams; odd rows."""

import random

import numpy as np
import pytest

from threadstats.llm import toxicity as T

DOCS = "doc_id bigint, text string, lang string, label int, evidence string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
        if i % 3 == 0:
            words = [rng.choice(["vilefool", "dumbrat", "filthhead"]) if rng.random() < 0.2 else w for w in words]
        rows.append((i, " ".join(words), "en", 5, "clash"))
        labels.append((i, 1, int(i % 3 == 0)))
    return (spark.createDataFrame(rows, DOCS).repartition(4),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_rare_grams_stay_when_the_sample_shrinks(tables):
    docs, labels = tables
    whole, some = T.train(docs, labels), T.train(docs, labels, max_grams=20_000)
    assert len(whole.grams) > 20_000 >= len(some.grams) > 5_000
    # Most random words occur once: leaving singletons out would leave next to nothing.
    assert len(some.grams) > 0.2 * len(whole.grams)
    for model in (whole, some):
        got = {r["doc_id"]: r for r in T.toxicity(docs, model).collect()}
        held = [i for i in got if got[i]["held_out"]]
        assert np.mean([got[i]["predicted"] == int(i % 3 == 0) for i in held]) > 0.9


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = T.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "", 0, ""), (1, "", "", 0, ""), (None, "vilefool", "", 0, ""), (2, "a b " * 500_000, "", 0, "")], DOCS)
    got = T.toxicity(odd, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert T.toxicity(odd.limit(0), model).count() == 0
    assert T.toxicity(odd, T.train(docs.limit(0), labels)).count() == 4
