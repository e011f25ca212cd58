"""Each operator against a brute-force version, and the cases that inputs may hold."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from threadstats.llm import (
    cross_polytope, embed_dedup, lm_scoring, packing, piece_scan, quality, queries, simhash, token_counts, toxicity, url_filter,
)

WORDS = "the of and onion rethan shed thing idiot loser atten bleer ingst heon ration".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, held_out string, component_id string"


def _texts(n=60, seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 90))) for _ in range(n)]
    return [None, "", " \t\n", "One", "TWO words", *out, out[0], out[0], out[1] + " end", "x" * 5000, "é 日本 <|endoftext|> 'S ́a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in enumerate(_texts())]
    rows += [(None, "no id", "en", "s", 0, "", ""), rows[8], rows[8]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    rows = [(r["doc_id"], _fingerprint(r["text"])) for r in docs.collect()]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in combinations(range(len(rows)), 2):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                label[i] = label[j] = min(label[i], label[j])
    first = {}
    for (doc_id, _), l in zip(rows, label):
        if doc_id is not None:
            first[l] = min(first.get(l, doc_id), doc_id)
    wanted = Counter((d, f"{fp:016x}", first.get(l)) for (d, fp), l in zip(rows, label))
    got = Counter((r[0], r[1], r[2]) for r in simhash.simhash_groups(docs).collect())
    assert got == wanted
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(first.values()))


def test_budgets_sum_to_the_bits_and_choose_the_cheaper_part():
    values = [np.array([0, 1], np.uint64), np.array([0, 0], np.uint64)]
    balls = [simhash.ball_counts(np.array([10_000, 1]), 3), simhash.ball_counts(np.array([2, 2]), 3)]
    given = simhash.budgets(values, balls, [1, 1], 4)
    assert (given.sum(0) == 4).all()
    for parts in (2, 3, 4):
        assert all(sum(e) == 4 for e in simhash.compositions(4, parts))


def _vectors(spark, n=400):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(n, 16))
    rows[50:90] = rows[0] + rng.normal(scale=0.12, size=(40, 16))
    rows[90:95] = rows[3]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0] * 3]
    data = [(i, [float(x) for x in r], 0, "clash") for i, r in enumerate(rows)]
    data += [(1000 + k, v, 0, "clash") for k, v in enumerate(odd)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, kept string"), rows


def test_embedding_groups_equal_brute_force(spark):
    df, rows = _vectors(spark)
    near = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = near @ near.T >= 0.9
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([label[near[i]].min() for i in range(len(rows))])
    got = {r["vec_id"]: r for r in embed_dedup.embedding_groups(df, 0.9, block=64).collect()}
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
    for i in range(1000, 1005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embed_dedup.embedding_groups(df.limit(0)).count() == 0


def test_nearest_recall_and_order(spark):
    df, rows = _vectors(spark)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    found = cross_polytope.nearest(df, F.col("id") % 50 == 0, k=5).collect()
    hit = 0
    for q in range(0, len(rows), 50):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - near[q, r["vec_id"]]) < 1e-12 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hit += len({r["vec_id"] for r in own} & set(np.argsort(-near[q])[:5].tolist()))
    assert hit >= 0.9 * len(found)
    few = cross_polytope.nearest(df.filter("vec_id < 3"), F.col("id") % 50 == 0, k=5)
    assert few.count() == 2
    assert cross_polytope.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def _labelled(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS[:7] + WORDS[9:]) for _ in range(rng.randrange(20, 120))]
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            for k in range(0, len(words), 9):
                words[k] = rng.choice(["idiot", "loser", "moron"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "s", 0, "", ""))
        if i % 3:
            labels.append((i, int(good), int(toxic), "clash"))
    rows += [(9000, None, "", "", 0, "", ""), (9001, "", "", "", 0, "", ""), (None, "idiot", "", "", 0, "", ""), rows[0]]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")


@pytest.mark.parametrize("operator, score, target", [(toxicity, "toxicity", "toxic"), (quality, "quality", "quality")])
def test_classifiers_learn_and_score_all_rows(spark, operator, score, target):
    df, labels = _labelled(spark)
    model = operator.train(df, labels)
    got = getattr(operator, score)(df, model).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[target] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held) > 0
    assert operator.accepted(df, model).columns == df.columns
    none = operator.train(df, labels.limit(0))
    assert getattr(operator, score)(df.limit(0), none).count() == 0


def test_url_verdicts(spark):
    urls = [(1, "https://A.Example.org/es/1?q=1", ""), (2, "http://example.org/en/12#x", ""), (3, "http://x.com/fr/", ""),
            (4, "http://x.com/de/7", ""), (5, "http://x.org", ""), (6, None, ""), (7, "no host", ""), (8, "http://x.net/es/1", ""),
            (8, "http://x.net/es/1", ""), (9, "HTTP://notexample.org/es/", "")]
    urls += [(100 + i, f"http://h{i}.example.org/es/{i}", "") for i in range(20)]
    urls += [(200 + i, f"http://h{i}.example.org/de/{i}", "") for i in range(20)]
    df = spark.createDataFrame(urls, "page_id bigint, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2]["rule"], got[3]["rule"], got[4]["rule"]) == ("example.org/en/1", "com/fr/", "com/de/")
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("x.org", "", None)
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (6, 7))
    assert (got[8]["rule"], got[8]["verdict"]) == (None, "block")  # "path:es" goes with block
    assert got[9]["rule"] == "org/"
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_pieces_have_the_best_sum_however_a_text_is_cut(spark, docs):
    own = piece_scan.Pieces(queries.PIECES)
    score = {i: s for s, i in own.score.values()}
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    whole = {r["doc_id"]: r["ids"] for r in piece_scan.encode(docs, queries.PIECES).collect()}
    cut = piece_scan.decode(piece_scan.encode(docs, queries.PIECES, chunk=40), queries.PIECES).collect()
    assert len(cut) == docs.count()
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in cut:
        assert abs(total(r["ids"]) - total(whole[r["doc_id"]])) < 0.5
        assert r["text"] == (texts_[r["doc_id"]] or "")

    def best(text):
        values = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - own.longest), end):
                piece = own.score.get(text[start:end])
                if piece:
                    values[end] = max(values[end], values[start] + piece[0])
        return values[-1]

    for text in ("the idiotic worlds", "onion rethan 77", "aaaaaaaaaaaaaaaaaaaaa"):
        normal = own.normal(text.encode())
        assert abs(total(own.encode([normal])[0]) - best(normal)) < 0.5


def test_lm_base_score_and_bits(docs, empty):
    tokens = lambda t: (t or "").encode().translate(lm_scoring.LOWER).split()
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count, ends = Counter(), 0
    for r in rows:
        if not held(r["doc_id"]):
            count.update(tokens(r["text"]))
            ends += 1
    n, kinds = sum(count.values()) + ends, len(count) + 1
    wanted = Counter()
    for r in rows:
        base = sum(math.log10((c + 1) / (n + kinds + 1)) for c in [*[count[w] for w in tokens(r["text"])], ends])
        wanted[(r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])) + 1,
                sum(count[w] > 0 for w in tokens(r["text"])) + 1, n, round(base, 6))] += 1
    got = lm_scoring.lm_scores(docs).collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == wanted
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.lm_scores(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    slots = np.sort(rng.choice(lm_scoring.FLAT, 5000, replace=False))
    model = lm_scoring.build(slots, rng.integers(1, 9, 5000), [])
    # All one-byte texts and what begins with them: the last byte's end excluded.
    first = lm_scoring.log10_probability(model, [b""])[0]
    ones = lm_scoring.log10_probability(model, [bytes([b]) for b in range(1, 256) if not 65 <= b <= 90])
    assert 0 < 10 ** first + (10 ** ones).sum() <= 1


def test_lm_first_weights_are_fitted_on_every_bit_of_the_training_texts(spark, monkeypatch):
    rng = random.Random(5)
    long_ = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(40_000))  # 296 KB
    rows = list(enumerate(_texts()))
    rows += [(None, long_), rows[8]]
    seen, fit = [], lm_scoring._fit_weights

    def spy(model, cells, counts):
        fit(model, cells, counts)
        seen.append((model, cells, counts))

    monkeypatch.setattr(lm_scoring, "_fit_weights", spy)
    lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    (model, cells, counts), = seen
    trained = [(t or "").encode() for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    assert long_.encode() in trained
    flat, begin, end = lm_scoring.joined(trained)
    inside = np.concatenate([np.arange(b, e) for b, e in zip(begin, end)])
    assert counts.sum() == model.code_length[flat[inside]].sum()
    ones = sum(int(model.bits[s:s + k].sum()) for s, k in zip(model.code_start[flat[inside]], model.code_length[flat[inside]]))
    assert counts[cells % 2 == 1].sum() == ones


def test_token_counts_are_the_library_s_and_cached(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(docs, queries.WORD_BPE, cache).collect()
    texts_ = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    wanted = Counter()
    for (doc_id, text), times in texts_.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        wanted[(doc_id, len(text.encode()), n, n > 2048)] += times
    assert Counter(map(tuple, got)) == wanted
    stored = spark.read.parquet(cache).count()
    again = token_counts.token_counts(docs, queries.WORD_BPE, cache)
    assert Counter(map(tuple, again.collect())) == wanted and spark.read.parquet(cache).count() == stored
    assert token_counts.token_counts(empty, queries.WORD_BPE, cache).count() == 0
    pieces = token_counts.token_counts(docs.limit(5), queries.PIECES, cache)
    assert pieces.count() == 5


def test_packing_keeps_every_id_once_and_pads_nothing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {(r["doc_id"], len(i := [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])): np.array(i, "<u4")
           for r in docs.collect()}
    got = packing.pack(docs, queries.WORD_BPE, size=64).collect()
    covered, sequences = Counter(), {}
    for r in got:
        own = ids[(r["doc_id"], r["doc_tokens"])]
        assert zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered[(r["doc_id"], r["doc_tokens"])] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    times = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert covered == Counter({k: k[1] * n for k, n in times.items()})
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0
    assert packing.pack(empty, queries.WORD_BPE).count() == 0


def test_minimum_bin_slack_fills_to_the_last_id():
    counts = {60: 2, 33: 3, 31: 3, 4: 1, 2: 2, 7: 1}
    found, left = packing.plan(counts, 64)
    used = Counter(left)
    for taken, times in found:
        assert sum(length * n for length, n in taken.items()) == 64
        for length, n in taken.items():
            used[length] += n * times
    assert dict(used) == counts
    assert packing.cuts(11, 64) == [(0, 8), (8, 2), (10, 1)]


def test_texts_about_as_long_as_a_chunk_keep_their_row(spark):
    sizes = [39, 40, 41, 42]
    rows = [(i, "ab cd " * 9) for i in range(2)] + [(n, ("word" * 20)[:n]) for n in sizes]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = piece_scan.decode(piece_scan.encode(df, queries.PIECES, chunk=40), queries.PIECES).collect()
    assert sorted((r["doc_id"], r["text"]) for r in cut) == sorted(rows)


def test_ids_of_a_merge_model_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts_ = [*_texts(6), "  two  spaces ", "tab\tand\nline", "▁mark a▁b", "x" * 100, "日本" * 60 + " é", "a\u0000b"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string").coalesce(2)
    wanted = {i: library.encode(t or "") for i, t in enumerate(texts_)}
    assert {r["doc_id"]: r["ids"] for r in piece_scan.encode(df, queries.PIECES, chunk=40).collect()} == wanted


def test_a_merge_cuts_texts_by_their_length_as_given(spark):
    texts_ = [*_texts(6), " " * 90, "word " * 7, "\u00bd" * 30, "\u00bd " * 50, "\ufdfa" * 40, "\ufdfa" * 41]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string").coalesce(2)
    wanted = {i: piece_scan.pieces(queries.PIECES).model.encode(t or "") for i, t in enumerate(texts_)}
    assert {r["doc_id"]: r["ids"] for r in piece_scan.encode(df, queries.PIECES, chunk=40).collect()} == wanted


def test_the_scan_keeps_texts_about_as_long_as_a_chunk(spark):
    rows = [(n, ("word" * 20)[:n]) for n in (39, 40, 41)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = piece_scan.decode(piece_scan.scan(df, queries.PIECES, chunk=40), queries.PIECES).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows


def test_special_strings_in_any_case_are_ordinary_text_to_the_library():
    from threadstats.llm.tokens import Encoder
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    texts_ = ["one two three", "a <|STARTOFTEXT|> b", "mixed <|EndOfText|>end", "<|endoftext|> x", "four <| five", "one two"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts_]
    own = Encoder(queries.WORD_BPE)
    batch = [t.encode() for t in texts_]
    for _ in range(2):  # the second time from the words remembered
        assert [i.tolist() for i in own.encode(batch)] == wanted
        assert own.counts(batch).tolist() == [len(i) for i in wanted]


def test_url_tokens_reach_to_the_last_segment(spark):
    urls = [(i, f"http://h{i}.example.org/es/1/2/3/4/ads/{i}") for i in range(20)]
    urls += [(100 + i, f"http://h{i}.com/fr/1/2/3/4/news/{i}") for i in range(20)]
    urls += [(200, "http://x.net/p/1/2/3/4/ads/7"), (201, "http://x.net/p/1/2/3/4/news/7")]
    df = spark.createDataFrame(urls, "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert (got[200], got[201]) == ("block", "allow")


def test_lm_words_of_a_block_and_bucket_are_one_row(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(lm_scoring, "BUCKETS", 8)
    rng, rows, seen = random.Random(4), [], []
    for i in range(240):
        rows.append((i, " ".join(rng.choice([f"w{rng.randrange(2_000)}", "The", "é,"]) for _ in range(rng.randrange(60)))))
    blocks = lm_scoring._blocks

    def spy(*args):
        seen.append(blocks(*args))
        return seen[0]

    monkeypatch.setattr(lm_scoring, "_blocks", spy)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs).collect()}
    n_blocks = seen[0].select("block").distinct().count()
    assert n_blocks > 6 and seen[0].count() <= 9 * n_blocks
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.lower().split())
    for i, text in rows:
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in text.lower().split()) + 1
        assert got[i]["train_tokens"] == sum(counts.values()) + sum(zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows)
