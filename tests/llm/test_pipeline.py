"""The pipeline stage by stage: each stage's rows against plain versions of its decision."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_operators import _fingerprint
from threadstats.llm import quality, queries, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, label string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    good, bad, rude = "the river runs past quiet green fields and old stone mills".split(), ["$%", "#@!", "==", "~~|"], "idiot loser moron fool".split()
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        words = [rng.choice(bad if kind == 1 else good) + (str(rng.randrange(10)) if kind != 1 else "") for _ in range(rng.randrange(20, 120))]
        if kind == 2:
            words = [rng.choice(rude) if rng.random() < 0.4 else w for w in words]
        rows.append((i, " ".join(words), "en", "s", 0, "clash", "clash"))
        if i < 300:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [rows[0], rows[0], (900, rows[0][1] + " ", "en", "s", 0, "", ""), (901, None, "", "", 0, "", ""), (902, "", "", "", 0, "", ""),
             (None, " ".join(good), "", "", 0, "", ""), (903, "river " * 30_000, "", "", 0, "", "")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _key(row):
    return row["doc_id"], row["text"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_the_order_of_the_stages():
    assert [name for name, _ in P.STAGES] == ["quality", "toxicity", "simhash", "packing"]


@pytest.mark.parametrize("place,module,column", [(0, quality, "quality"), (1, toxicity, "toxicity")])
def test_filters_keep_what_their_scores_allow(spark, folder, stages, place, module, column):
    _, before, after = stages[place]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = module.train(before, labels)
    judged = {(r["doc_id"]): r["predicted"] for r in getattr(module, column)(before, model).collect() if r["doc_id"] is not None}
    keep = 1 if place == 0 else 0
    wanted = sorted((_key(r) for r in before.collect() if r["doc_id"] is not None and judged[r["doc_id"]] == keep), key=repr)
    assert sorted((_key(r) for r in after.collect() if r["doc_id"] is not None), key=repr) == wanted
    assert after.columns == before.columns and 0 < after.count() < before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = before.collect()
    prints = [_fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    kept = after.collect()
    assert len(kept) == len(set(label))
    group = {}
    for r, l in zip(rows, label):
        group.setdefault(_key(r), l)
    assert len({group[_key(r)] for r in kept}) == len(kept)
    assert after.columns == before.columns


def test_every_id_is_packed_once(stages):
    _, before, after = stages[3]
    library = Tokenizer.from_file(queries.WORD_BPE)
    ids = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in before.collect()}
    pieces = {}
    for r in after.collect():
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for doc_id, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[doc_id])
    assert set(pieces) == set(ids)


def test_run_gives_the_last_stage(spark, folder, stages):
    assert P.run(spark, folder).count() == stages[-1][2].count()


def test_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
