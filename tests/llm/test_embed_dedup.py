"""Near-duplicate vectors: links across blocks, dealt rows, odd rows."""

import numpy as np
import pytest

from threadstats.llm import embed_dedup as E

SCHEMA = "vec_id bigint, embedding array<double>, label int, kept string"


def _frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r], 0, "clash") for i, r in enumerate(rows)], SCHEMA)


def _wanted(rows, threshold):
    near = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = near @ near.T >= threshold
    label = np.arange(len(rows))
    while True:
        lower = np.array([label[near[i]].min() for i in range(len(rows))])
        if (lower == label).all():
            return near.sum(1) - 1, label
        label = lower


@pytest.mark.parametrize("block,kind", [(16, "even"), (64, "clustered"), (None, "even")])
def test_links_across_near_and_far_blocks(spark, block, kind):
    rng = np.random.default_rng(5)
    if kind == "even":
        rows = rng.normal(size=(300, 24))
        rows[100:160] = rows[:60] + rng.normal(scale=0.1, size=(60, 24))
    else:
        rows = np.repeat(rng.normal(size=(6, 24)) * 5, 50, axis=0) + rng.normal(scale=1.5, size=(300, 24))
    links, label = _wanted(rows, 0.9)
    got = {r["vec_id"]: r for r in E.embedding_groups(_frame(spark, rows).repartition(4), 0.9, block=block).collect()}
    assert [got[i]["n_links"] for i in range(300)] == links.tolist()
    assert [got[i]["component_id"] for i in range(300)] == label.tolist()
    assert links.sum() > 0


def test_boxes_leave_far_blocks_out():
    low = np.array([[0.0, 0.0], [0.3, 0.0], [2.0, 2.0]])
    near = E.partners(low, low + 0.1, 0.25)
    assert [n.tolist() for n in near] == [[0, 1], [0, 1], [2]]


def test_first_step_follows_the_shares():
    assert E.first_step(np.full(64, 1 / 64), 0.9) == 40
    strong = np.array([0.9] + [0.1 / 63] * 63)
    assert E.first_step(strong, 0.9) == 8
    assert E.first_step(np.array([0.5, 0.5]), 0.9) == 2


def test_null_and_repeated_ids(spark):
    frame = _frame(spark, np.eye(3)).union(spark.createDataFrame([(None, [1.0, 0.0, 0.0], 0, ""), (1, [0.0, 1.0, 0.0], 0, "")], SCHEMA))
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in E.embedding_groups(frame, 0.9).collect())
    assert got == [(False, 0, 1, 0), (False, 1, 1, 1), (False, 1, 1, 1), (False, 2, 0, 2), (True, 0, 1, 0)]
