"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the probability of each byte of
a word after the ``ORDER - 1`` bytes before it.  Each has its own counts of the
longest grams; both fall back to the same Kneser-Ney continuation counts of the
shorter grams, so an expression that is rare in both classes is judged by what
they share and decides little.  A text's evidence is the difference of the two
log-likelihoods per byte; a logistic curve, fitted on labelled texts that the
counts have not seen, turns it into a probability.

With one backoff for both classes the difference of a gram that neither class
has seen is that of the two backoff weights, so scoring needs one table of
grams and one of contexts.

Learning uses at most about ``per_class`` labelled texts of either class (each
a whole text) and at most ``max_grams`` grams: beyond it the rarest counts go.
Without labels of both classes every score is the share of toxic labels (0 if
there are none).  Null texts are empty; an empty text has the evidence 0.
Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.llm.shared import chunks, fit_line, remainder, sampled_labels, texts, words_of
from threadstats.storage import scope, written

ORDER = 6
END = 10  # a byte that no word holds
NOTICED = 4.0  # nats: a word that is this much likelier in toxic text counts as such
MEMO = 400_000  # words whose evidence a task remembers


@dataclass
class Model:
    grams: np.ndarray  # sorted; each ORDER bytes in a number
    evidence: np.ndarray  # log P(byte | toxic) - log P(byte | ordinary)
    contexts: np.ndarray  # sorted; ORDER - 1 bytes each
    fallback: np.ndarray  # the same for a byte not seen after the context
    line: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)  # weights of the evidence, and the constant


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all words in turn (ORDER - 1 zeros before a word, an end after it), and each word's number."""
    lengths = np.array([len(w) for w in words], np.int64) + 1
    pad = ORDER - 1
    flat = np.frombuffer(b"".join([bytes(pad) + w + b"\n" for w in words]), np.uint8).astype(np.uint64)
    keys = np.zeros(len(flat) - pad if len(flat) else 0, np.uint64)
    for back in range(ORDER):
        keys |= flat[pad - back:len(flat) - back] << np.uint64(8 * back)
    ends = np.cumsum(lengths + pad)
    inside = np.ones(len(keys), bool)
    for k in range(pad):  # windows that end in the zeros of the next word
        between = ends[:-1] + k - pad
        inside[between] = False
    return keys[inside], lengths


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often ordinary and toxic texts hold each longest gram."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=16 << 20):
            label = np.array(batch.column("label").to_pylist())
            tables = []
            for c in (0, 1):
                words: Counter[bytes] = Counter()
                for text in batch.column("text").filter(pa.array(label == c)).to_pylist():
                    words.update(words_of(text))
                keys, lengths = grams_of(list(words))
                found, place = np.unique(keys, return_inverse=True)
                times = np.bincount(place, np.repeat(np.array(list(words.values()), np.int64), lengths), len(found))
                tables.append((found, times.astype(np.int64)))
            for c, (found, times) in enumerate(tables):
                zero = pa.array(np.zeros(len(found), np.int64))
                counts = [pa.array(times), zero] if c == 0 else [zero, pa.array(times)]
                yield pa.record_batch([pa.array(found.astype(np.int64)), *counts], ["gram", "n0", "n1"])

    found = labelled.select("text", "label").mapInArrow(each, "gram bigint, n0 bigint, n1 bigint")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def shared_probability(grams: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each gram's last byte after the ORDER - 2 bytes before it, from all classes.

    The counts of a shorter gram are the different longer grams that end in it.
    """
    lower = grams & np.uint64((1 << (8 * (ORDER - 1))) - 1)
    levels, current = [], grams
    for order in range(ORDER - 1, 0, -1):
        current, counts = np.unique(current & np.uint64((1 << (8 * order)) - 1), return_counts=True)
        levels.append((order, current, counts.astype(np.float64)))
    below = None
    for order, keys, counts in reversed(levels):
        if below is None:
            chance = (counts + 0.5) / (counts.sum() + 128.0)
        else:
            d = _discount(counts)
            _, place = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(place, counts), np.bincount(place)
            shorter = keys & np.uint64((1 << (8 * (order - 1))) - 1)
            backed = below[1][np.searchsorted(below[0], shorter)]
            chance = (np.maximum(counts - d, 0) + d * kinds[place] * backed) / total[place]
        below = keys, chance
    return below[1][np.searchsorted(below[0], lower)]


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> Model:
    """The evidence of every gram and context from the counts (row 0: ordinary, row 1: toxic) of sorted grams."""
    shared = shared_probability(grams)
    contexts, place = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, backoffs = [], []
    for row in counts.astype(np.float64):
        d = _discount(row)
        total, kinds = np.bincount(place, row, len(contexts)), np.bincount(place, row > 0, len(contexts))
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(row - d, 0) / np.maximum(total[place], 1)
        logs.append(np.log(own + weight[place] * shared))
        backoffs.append(np.log(weight))
    return Model(grams, (logs[1] - logs[0]).astype(np.float32), contexts, (backoffs[1] - backoffs[0]).astype(np.float32))


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def word_evidence(model: Model, words: list[bytes]) -> np.ndarray:
    """Each word's summed difference of the log-likelihoods."""
    if not words:
        return np.zeros(0)
    keys, lengths = grams_of(words)
    keys, place = np.unique(keys, return_inverse=True)
    value = np.zeros(len(keys))
    at, known = _found(keys, model.grams)
    value[known] = model.evidence[at[known]]
    rest = np.flatnonzero(~known)
    at, known = _found(keys[rest] >> np.uint64(8), model.contexts)
    value[rest[known]] = model.fallback[at[known]]
    return np.add.reduceat(value[place], np.cumsum(lengths) - lengths)


class Scorer:
    """The evidence of texts (one row each); remembers words, which repeat."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def __call__(self, batch: list[bytes]) -> np.ndarray:
        split = [words_of(text) for text in batch]
        memo = self.memo
        new = list({w for words in split for w in words if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for words in split for w in words})
        memo.update(zip(new, word_evidence(self.model, new).tolist()))
        out = np.zeros((len(batch), 3))
        filled = [i for i, words in enumerate(split) if words]
        if not filled:
            return out
        value = np.array([memo[w] for i in filled for w in split[i]])
        size = np.array([len(w) + 1 for i in filled for w in split[i]])
        count = np.array([len(split[i]) for i in filled])
        start = np.cumsum(count) - count
        out[filled, 0] = 10 * np.add.reduceat(value, start) / np.add.reduceat(size, start)
        out[filled, 1] = np.maximum.reduceat(value / size, start)
        out[filled, 2] = 10 * np.add.reduceat(np.maximum(value - NOTICED, 0), start) / count
        return out


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 10_000,
          max_grams: int = 3_000_000, modulus: int = 5, held: int = 0) -> Model:
    """Learn from labelled documents whose crc32(doc_id) mod ``modulus`` is not ``held``.

    Both bounds limit the labelled documents: about ``per_class`` of either class, and fewer (each
    document's chance falls alike) if they have more than ``max_grams`` different grams together.
    Of the documents that stay every gram counts, however rare.
    """
    sample, weight = sampled_labels(labels, target, per_class, modulus, held)
    empty = np.zeros(0, np.uint64)
    nothing = Model(empty, np.zeros(0, np.float32), empty, np.zeros(0, np.float32))
    with scope(docs.sparkSession):
        # About 2 x per_class ids: the sample's size is a parameter.
        labelled = written(texts(docs).join(F.broadcast(sample), "doc_id").withColumn(
            "fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4))), "labelled")
        present = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
        if len(present) < 2:
            share = float(1 in present)
            nothing.line = (0.0, 0.0, 0.0, 30.0 if share else -30.0)
            return nothing
        chance = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
        share = 1.0
        while True:
            counted = written(count_grams(labelled.filter((F.col("fold") != 0) & (chance < share))), "grams")
            found = counted.count()
            if found <= max_grams:
                break
            share *= 0.9 * max_grams / found
        rows = counted.toArrow().sort_by("gram")
        if not rows.num_rows:
            nothing.line = (0.0, 0.0, 0.0, float(np.log(weight[1] * present[1] / (weight[0] * present[0]))))
            return nothing
        model = kneser_ney(rows.column("gram").to_numpy().astype(np.uint64),
                           np.stack([rows.column(c).to_numpy() for c in ("n0", "n1")]))
        unseen = evidence(labelled.filter("fold = 0"), model).join(F.broadcast(sample), "doc_id").toArrow().to_pandas()
        if unseen["label"].nunique() < 2:
            model.line = (0.0, 4.0, 4.0, -4.0)  # too few texts to fit the curve
        else:
            y = unseen["label"].to_numpy()
            seen = np.array(unseen["evidence"].tolist())
            model.line = tuple(fit_line(seen, y, np.where(y == 1, weight[1], weight[0])).tolist())
        return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, evidence) for every row; the model has a bounded size and goes to all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches):
            found = scorer(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.tolist(), pa.list_(pa.float64()))],
                                  ["doc_id", "evidence"])

    return texts(docs).mapInArrow(each, "doc_id bigint, evidence array<double>")


def toxicity(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    *weights, constant = model.line
    total = sum((F.col("evidence")[i] * w for i, w in enumerate(weights)), F.lit(constant))
    score = 1 / (1 + F.exp(-total))
    return evidence(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose own text is not rejected, with all columns of ``docs``; nothing is shuffled or joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    weights, constant = np.array(model.line[:-1]), model.line[-1]

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for text in parts:
            whole = [(t or "").encode() for t in text]
            total = np.concatenate([scorer(whole[k:k + 256]) for k in range(0, len(whole), 256)] or [np.zeros((0, 3))])
            score = 1 / (1 + np.exp(-np.clip(total @ weights + constant, -700, 700)))
            yield pd.Series(score < threshold)

    return docs.filter(clean(F.col("text")))
