from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadstats.functions import cutting as K
from threadstats.functions import text as X
from threadstats.operators import descriptors as D
from threadstats.operators import stance as S
from threadstats.operators import terms as W
from threadstats.sources import dumps as I
from threadstats.storage import scratch_path

ROWS = [(1, "ships sail ships sailing"), (2, "cats bark"), (None, "cats sail"), (None, "sail sail sailed"), (3, None), (4, ""), (2, "barking cats")]


def _rows(df):
    return sorted(((str(r.doc), r.term, r.n) for r in df.select("doc", "term", "n").collect()))


@pytest.mark.parametrize("held", [0, 1, 500_000])
def test_counts_of_shared_and_null_keys(spark, monkeypatch, held):
    monkeypatch.setattr(W, "MAX_REPEATED_KEYS", held)
    docs = spark.createDataFrame(ROWS, "doc int, content string")
    want = Counter()
    for doc, content in ROWS:
        want.update((str(doc), w) for w in (content or "").split())
    assert _rows(W.descriptor_counts(docs, ["doc"], stem=False)) == sorted((d, w, n) for (d, w), n in want.items())


@pytest.mark.parametrize("held", [0, 500_000])
def test_counts_of_stems(spark, monkeypatch, held):
    monkeypatch.setattr(W, "MAX_ROW_VOCABULARY", held)
    docs = spark.createDataFrame(ROWS, "doc int, content string")
    stems = {"ships": "ship", "sailing": "sail", "sailed": "sail", "cats": "cat", "barking": "bark"}
    want = Counter()
    for doc, content in ROWS:
        want.update((str(doc), stems.get(w, w)) for w in (content or "").split())
    want = sorted((d, w, n) for (d, w), n in want.items())
    assert _rows(W.descriptor_counts(docs, ["doc"])) == want
    assert _rows(W.matrix_counts(docs, ["doc"])) == want
    assert _rows(W.model_counts(docs, ["doc"])) == want


def test_words_of_single_rows_are_not_moved(spark):
    docs = spark.createDataFrame([(1, "ships sail"), (2, "cats bark")], "doc int, content string")
    plan = W.descriptor_counts(docs, ["doc"], stem=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scoring_writes_no_words_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a", "ships sail ships"), (1, "b", "cats purr purring")], "label int, author string, content string")
    model, prior = S.train(docs)
    names = []

    def noted(df, name):
        names.append((name, df.columns))
        return kept(df, name)

    kept = S.written
    monkeypatch.setattr(S, "written", noted)
    assert S.score(docs, model, prior, ["author"], min_total=1).count() == 2
    assert names and not [n for n in names if "author" in n[1]]


def test_packed_csv_comes_back(spark):
    raw = spark.createDataFrame(
        [("c1", "ann", 'say "x",\nthen y', "3", "1/2/2024 3:04", "NaN", "t3_s", "t1_p")],
        ["Comment ID", "Author", "Body", "Score", "Publish Date", "Permalink", "Submission ID", "Parent ID"])
    path = scratch_path(spark, "packed-csv")
    I.write_csv(raw, path, compression="gzip")
    assert all(f.endswith(".gz") for f in spark.read.format("binaryFile").load(path).select("path").toPandas()["path"])
    row = I.read_comments(spark, path).first()
    assert (row.content, row.submission_id, row.parent_id) == ('say "x",\nthen y', "s", "p")


ODD = ["a'b 'c' d..e f.g will wi!ll w1ill WILL", None, "", "'x", "x'", "É́tude ΑΣ ας İx ½ Ⅷ 漢字 𝒜b 😀c", "see http://x.y/z?q www.ab.c end",
       "a b\x0bc\x1cd e ¿f… ‘g’", "will", "w", "ill", "12 3x4", "ﬁn\u0085ok", "a_b-c.d'e"]


def test_words_cut_from_bytes_are_those_of_the_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").coalesce(1)
    rows = docs.select("t", X.model_text(F.col("t")).alias("low"), X.model_tokens(F.col("t")).alias("m"),
                       X.descriptor_tokens(F.col("t")).alias("d")).collect()

    def lists(words, n):
        words = iter(words.to_pylist())
        return [[next(words) for _ in range(k)] for k in n]

    for start, part in ((0, len(rows)), (3, 5)):  # an array may be a part of a larger one
        chosen = rows[start:start + part]
        assert lists(*K.model_words(pa.array([r.low for r in rows]).slice(start, part), K.letters())) == [r.m or [] for r in chosen]
        cut = lists(*K.descriptor_words(pa.array([r.t for r in rows]).slice(start, part)))
        low = dict(spark.createDataFrame([(w,) for w in {w for ws in cut for w in ws}], "w string").select("w", F.lower("w")).collect())
        assert [[low[w] for w in ws] for ws in cut] == [[w for w in r.d or [] if w] for r in chosen]


@pytest.mark.parametrize("held", [0, 8_000_000])
def test_many_known_words_move_no_words_of_documents(spark, monkeypatch, held):
    docs = spark.createDataFrame(
        [(0, "a", 1, "ships sail ships"), (1, "b", 1, "cats purr purring"), (0, "a", 2, "purr ships"), (1, None, 1, "ships"), (1, "b", None, "purr")],
        "label int, author string, period int, content string")
    model, prior = S.train(docs)
    want = sorted(map(str, S.author_stance(docs, model, prior, min_total=1).collect()))
    names, kept = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: names.append(df.columns) or kept(df, name))
    monkeypatch.setattr(S, "STEM_MAP_BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "MAX_HELD_WORDS", held)
    assert sorted(map(str, S.author_stance(docs, model, prior, min_total=1).collect())) == want
    assert held == 0 or not [c for c in names if "author" in c]
    by_name = {(r.author, r.period): r.leave_probability for r in S.author_stance(docs, model, prior, min_total=1).collect()}
    assert by_name["a", 1] < by_name[None, 1] == by_name["b", None] == 0.5 < by_name["b", 1]


@pytest.mark.parametrize("held,columns", [(0, 250), (8_000_000, 250), (8_000_000, 1)])
def test_slots_are_counted_without_rows_of_words(spark, monkeypatch, held, columns):
    monkeypatch.setattr(D, "MAX_HELD_WORDS", held)
    monkeypatch.setattr(D, "F0_COLUMN_WORDS", columns)
    entries = spark.createDataFrame(
        [("a", 1, "Ships sail, the SHIP sailed will"), ("a", 1, "cats ab"), (None, 1, "ship"), ("b", None, "sail"), ("c", 2, None), ("d", 2, "will 12 the")],
        "author string, period int, content string")
    slots = spark.createDataFrame([(1, "ship"), (2, "sail")], "rank int, term string")
    names, kept = [], D.written
    monkeypatch.setattr(D, "written", lambda df, name: names.append(df.columns) or kept(df, name))
    got = {(r.author, r.period): (r["0"], r["1"], r["2"]) for r in D._slot_counts(entries, slots, [0, 1, 2]).collect()}
    assert got == {("a", 1): (1, 2, 2), (None, 1): (0, 1, 0), ("b", None): (0, 0, 1), ("c", 2): (0, 0, 0), ("d", 2): (0, 0, 0)}
    if held and columns > 1:
        assert names and not [c for c in names if "author" in c]
