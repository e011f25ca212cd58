"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Every passage is encoded
(shares of its bytes and of its words' shapes, through one learned layer); a
learned gate gives each passage an attention weight within its document, and the
weighted sum of the encodings is what the document's score looks at.  Encoding,
gate and score are learned together from the labels of documents alone.

Learning uses a sample of the labelled documents, every passage of each: about
``per_class`` documents of either class, or fewer if they have more than
``max_passages`` passages together (then each document's chance falls alike).
Scoring reads every passage of every document.
Without labels of both classes every score is the share of good labels (1 if
there are none).  Null and empty texts are one empty passage.  Repeated rows are
scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.llm.shared import chunks, remainder, sampled_labels, texts
from threadstats.storage import scope

PASSAGE = 1024
HIDDEN, GATE = 24, 12
#: Byte classes: each printable ASCII byte, white space, other control bytes, lead and trail bytes beyond ASCII.
CLASS = np.array([96 if b < 32 and b not in (9, 10, 11, 12, 13) else 95 if b <= 32 else b - 33 + 1 if b < 127
                  else 96 if b == 127 else 97 if b >= 192 else 98 for b in range(256)], np.int64)
CLASSES = 99
SHAPES = 12
WIDTH = CLASSES + SHAPES


def passages(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of all texts in turn, and the number of passages of each text."""
    lengths = np.array([len(t) for t in texts_], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    flat = np.frombuffer(b"".join(texts_), np.uint8)
    first = np.cumsum(counts) - counts
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = np.repeat(first, lengths) + within // PASSAGE
    total = int(counts.sum())
    classes = CLASS[flat]
    out = np.zeros((total, WIDTH))
    size = np.maximum(np.bincount(own, minlength=total), 1)[:, None]
    out[:, :CLASSES] = np.bincount(own * CLASSES + classes, minlength=total * CLASSES).reshape(total, CLASSES)
    upper, lower = ((flat >= 65) & (flat <= 90)), ((flat >= 97) & (flat <= 122)) | (flat >= 128)
    space, digit = classes == 95, (flat >= 48) & (flat <= 57)
    mark = ~(upper | lower | space | digit)
    after = np.zeros(len(flat), bool)
    after[1:] = own[1:] == own[:-1]

    def share(where: np.ndarray) -> np.ndarray:
        return np.bincount(own[where], minlength=total)

    def follows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = y.copy()
        both[1:] &= x[:-1]
        return share(both & after)

    same = np.zeros(len(flat), bool)
    same[1:] = flat[1:] == flat[:-1]
    shapes = [share(upper), share(lower), share(digit), share(mark), follows(upper, upper), follows(lower, upper),
              follows(mark, mark), follows(space, mark), follows(mark, space), share(same & after), follows(space, upper),
              follows(digit, digit)]
    out[:, CLASSES:] = np.stack(shapes, axis=1)
    return np.sqrt(out / size), counts


def _softmax_weights(raw: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Attention of each passage within its document."""
    top = np.repeat(np.maximum.reduceat(raw, first), counts)
    weight = np.exp(raw - top)
    return weight / np.repeat(np.add.reduceat(weight, first), counts)


Model = dict[str, np.ndarray]


def forward(model: Model, rows: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    first = np.cumsum(counts) - counts
    h = np.tanh((rows - model["mean"]) / model["spread"] @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-np.clip(h @ model["U"], -30, 30)))
    weight = _softmax_weights((v * u) @ model["w"], first, counts)
    z = np.add.reduceat(weight[:, None] * h, first)
    score = 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["d"], -30, 30)))
    return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "score": score}


def learn(rows: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 256,
          rate: float = 0.01, seed: int = 5) -> Model:
    """Adam on the weighted log loss of whole documents."""
    rng = np.random.default_rng(seed)
    model: Model = {
        "mean": rows.mean(0), "spread": rows.std(0) + 0.02,
        "W": rng.normal(0, 1 / np.sqrt(rows.shape[1]), (rows.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE),
        "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    m1, m2 = {k: np.zeros_like(model[k]) for k in learned}, {k: np.zeros_like(model[k]) for k in learned}
    start, step = np.cumsum(counts) - counts, 0
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for low in range(0, len(order), batch):
            bags = order[low:low + batch]
            take = np.concatenate([np.arange(start[i], start[i] + counts[i]) for i in bags])
            x, n = rows[take], counts[bags]
            f = forward(model, x, n)
            slope = weight[bags] * (f["score"] - y[bags]) / len(bags)
            dz = np.repeat(slope[:, None] * model["c"], n, axis=0)
            along = (dz * f["h"]).sum(1)
            mean = np.repeat(np.add.reduceat(f["weight"] * along, np.cumsum(n) - n), n)
            draw = f["weight"] * (along - mean)
            dv = draw[:, None] * model["w"] * f["u"] * (1 - f["v"] ** 2)
            du = draw[:, None] * model["w"] * f["v"] * f["u"] * (1 - f["u"])
            dh = f["weight"][:, None] * dz + dv @ model["V"].T + du @ model["U"].T
            dh *= 1 - f["h"] ** 2
            scaled = (x - model["mean"]) / model["spread"]
            grad = {"W": scaled.T @ dh + 1e-4 * model["W"], "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
                    "w": (draw[:, None] * f["v"] * f["u"]).sum(0), "c": f["z"].T @ slope + 1e-4 * model["c"],
                    "d": slope.sum(keepdims=True)}
            step += 1
            for k in learned:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                model[k] = model[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _constant(share: float) -> Model:
    odds = float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 * (2 * share - 1)
    return {"mean": np.zeros(WIDTH), "spread": np.ones(WIDTH), "W": np.zeros((WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": np.zeros((HIDDEN, GATE)), "U": np.zeros((HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN),
            "d": np.array([odds])}


def n_passages(text: Column) -> Column:
    return F.greatest(F.ceil(F.octet_length(text) / PASSAGE), F.lit(1)).cast("bigint")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = 3000,
          max_passages: int = 150_000, modulus: int = 5, held: int = 0) -> Model:
    """Learn from labelled documents whose crc32(doc_id) mod ``modulus`` is not ``held``.

    Both bounds say how many labelled documents are learned from; of those, nothing is left out.
    """
    sample, weight = sampled_labels(labels, target, per_class, modulus, held)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            rows, counts = passages(batch.column("text").to_pylist())
            found = [r.astype(np.float32).tobytes() for r in np.split(rows, np.cumsum(counts)[:-1])]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                                  ["doc_id", "label", "rows"])

    with scope(docs.sparkSession):
        # About 2 x per_class documents and max_passages passages at most: the size is a parameter.
        labelled = texts(docs).join(F.broadcast(sample), "doc_id")
        total = labelled.agg(F.sum(n_passages(F.col("text")))).first()[0] or 0
        if total > max_passages:
            chance = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
            labelled = labelled.filter(chance < max_passages / total)
        found = labelled.mapInArrow(bags, "doc_id bigint, label int, rows binary").toArrow().to_pandas().sort_values(
            "doc_id", kind="stable")
    y = found["label"].to_numpy().astype(np.float64)
    if found["label"].nunique() < 2:
        return _constant(1.0 if not len(y) else float(y[0]))
    bags_ = [np.frombuffer(r, np.float32).reshape(-1, WIDTH) for r in found["rows"]]
    counts = np.array([len(b) for b in bags_])
    model = learn(np.concatenate(bags_).astype(np.float64), counts, y, np.where(y == 1, weight[1], weight[0]))
    return model


def quality(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            score = forward(shared.value, *passages(batch.column("text").to_pylist()))["score"]
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(each, "doc_id bigint, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose own text is not rejected, with all columns of ``docs``; nothing is shuffled or joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        whole = [(t or "").encode() for t in text]
        out: list[bool] = []
        while len(out) < len(whole):  # about a megabyte at a time
            stop, size = len(out), 0
            while stop < len(whole) and (stop == len(out) or size + len(whole[stop]) <= 1 << 20):
                size, stop = size + len(whole[stop]), stop + 1
            out += (forward(shared.value, *passages(whole[len(out):stop]))["score"] >= threshold).tolist()
        return pd.Series(out, dtype=bool)

    return docs.filter(good(F.col("text")))
