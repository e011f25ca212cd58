"""Language-model scores by online logistic context mixing.

Text is coded bit by bit: each byte (A-Z lower-cased; byte 0 ends a text) is a
path of a Huffman tree of the training bytes, and every decision is one bit.
Several predictors give the bit's odds from hashed contexts of the bytes before
it, counted over all training texts.  They are combined in the logistic domain
by weights that a gate picks (how often the longest context was seen at this
decision), first fitted on every bit of the training texts, whose odds are rounded
to ``LEVELS`` levels and counted; the weights are refined online: after every ``STEP`` bits they take a
gradient step, for each stretch of ``SEGMENT`` bytes anew, so that stretches are
coded side by side.  The sum of the bits' logs is the text's log probability; divided
by its bytes it gives bits per byte.

The plain score beside it is a smoothed unigram model of words.  Words are
counted by block of texts, summed over the corpus, and their counts go back to
the blocks: once per block and different word, so that frequent words are in
no one's hands, and as one row for all words of a block that fall into one bucket.

Null texts are empty: one end, no words.  Rows without an id are training texts
(their remainder is none) and scored like others; repeated rows too.  Extra
columns are ignored; an empty table gives an empty result.  Without training
texts N and V are zero, every word is unknown, and the odds are even.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.llm.shared import LOWER, chunks, remainder, texts
from threadstats.llm.tokens import cut_words
from threadstats.storage import scope, written

#: Bytes of context of each predictor, and bits of its hashed contexts.
ORDERS, TABLE_BITS = (2, 4, 6), (12, 14, 16)
FLAT = sum(256 << b for b in TABLE_BITS)
#: Bits of the hashed table of decisions of each predictor.
SLOT_BITS = 21
SEGMENT, LANES, STEP = 1024, 512, 8
BLOCK_BYTES = 4 << 20
COUNT_BYTES = 1 << 20
RATE = 0.004
#: Steps whose bits are laid side by side at once.
AHEAD = 16
GATES = 6
#: Lower-cases A-Z; the byte 0, which ends a text, is 1 within one.
PLAIN = b"\1" + LOWER[1:]
#: Levels of odds on which the gates' first weights are fitted, and bytes whose bits a task counts at once.
LEVELS, LEVEL_BYTES = 32, 1 << 18
#: Slots of the hashed contexts that are shuffled as one row.
SLOTS = 4096
#: Buckets of words at least, and bytes of training texts for each of them; a task sums a bucket's words in memory.
BUCKETS, BUCKET_BYTES = 256, 32 << 20


@dataclass
class Model:
    code_start: np.ndarray  # per byte: where its path begins in nodes and bits
    code_length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: list[np.ndarray]  # per order: log odds of each hashed decision
    seen: np.ndarray  # of the longest order: gate of each hashed decision
    weights: np.ndarray  # gate x order


# -- contexts ----------------------------------------------------------------------------------

def contexts(flat: np.ndarray) -> list[np.ndarray]:
    """The hashed context of each order before each byte; texts are apart by as many zeros as a context is long."""
    key, out, wide = np.zeros(len(flat), np.uint64), [], flat.astype(np.uint64)
    for back in range(1, ORDERS[-1] + 1):
        if back > 1:
            wide <<= np.uint64(8)
        key[back:] |= wide[:-back]
        if back in ORDERS:
            bits = TABLE_BITS[ORDERS.index(back)]
            out.append((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32))
    return out


def joined(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts in turn, each with its end and zeros in front; where each text begins, and where it ends."""
    pad = bytes(ORDERS[-1])
    plain = [t.translate(PLAIN) for t in texts_]
    flat = np.frombuffer(b"".join([x for p in plain for x in (pad, p, b"\0")]), np.uint8)
    ends = np.cumsum([len(p) + len(pad) + 1 for p in plain], dtype=np.int64)
    return flat, ends - [len(p) + 1 for p in plain], ends


def count_contexts(training: DataFrame) -> DataFrame:
    """(slot, n): how often each byte follows each hashed context, over all texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FLAT, np.int32)
        for batch in chunks(batches, size=COUNT_BYTES):
            flat, begin, end = joined(batch.column("text").to_pylist())
            inside = np.flatnonzero(_inside(len(flat), begin, end))
            base, byte = 0, flat[inside]
            for key, bits in zip(contexts(flat), TABLE_BITS):
                slots = (key[inside] << 8).astype(np.int64)
                slots |= byte
                # In place: a count of its own would be as large as the table; a one of the table's type is added fastest.
                np.add.at(total[base:base + (256 << bits)], slots, np.int32(1))
                base += 256 << bits
        for low in range(0, FLAT, 1 << 18):
            part = np.flatnonzero(total[low:low + (1 << 18)])
            ends = np.searchsorted(part, np.arange(0, (1 << 18) + 1, SLOTS))
            own = np.flatnonzero(np.diff(ends))
            if len(own):
                ends = pa.array(np.append(ends[own], len(part)).astype(np.int32))
                yield pa.record_batch(
                    [pa.array((low // SLOTS + own).astype(np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array((part % SLOTS).astype(np.int16))),
                     pa.ListArray.from_arrays(ends, pa.array(total[low + part]))], ["part", "at", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # a task's share of the FLAT slots
        for batch in batches:
            for part, at, n in zip(*(batch.column(c) for c in ("part", "at", "n"))):
                total = totals.setdefault(part.as_py(), np.zeros(SLOTS, np.int64))
                total[at.values.to_numpy()] += n.values.to_numpy()
        for part, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array((part * SLOTS + at).astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    # Many slots a row, so that little is shuffled; a part's rows then lie together.
    packed = training.mapInArrow(each, "part int, at array<smallint>, n array<int>").repartition("part")
    return packed.mapInArrow(summed, "slot int, n bigint")


def _inside(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for every byte of the stretches [begin, end), which are apart or follow each other; 0 for the others."""
    inside = np.zeros(size + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    return np.cumsum(inside[:-1], dtype=np.int8)


# -- the model ---------------------------------------------------------------------------------

def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each byte's path: (node, bit) decisions from the root."""
    order = counter()
    heap = [(int(n) + 1, next(order), byte) for byte, n in enumerate(counts)]
    heapq.heapify(heap)
    number, children = 0, {}
    while len(heap) > 1:
        (n0, _, left), (n1, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        children[256 + number] = (left, right)
        heapq.heappush(heap, (n0 + n1, next(order), 256 + number))
        number += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack = [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            for bit, child in enumerate(children[node]):
                stack.append((child, [*path, (node - 256, bit)]))
    return paths


def decision_keys(contexts_: np.ndarray) -> np.ndarray:
    """Where a context's decisions lie in the table: a node is added to it."""
    return (contexts_.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)


def build(slots: np.ndarray, counts: np.ndarray, training: DataFrame | Sequence[bytes] = ()) -> Model:
    """The model from the counts of filled slots; ``training``: a table (text) to fit the first weights on, else they are even."""
    order = np.argsort(slots)
    slots, counts = slots[order], counts[order].astype(np.float32)
    bytes_ = np.bincount(slots & 255, counts, 256) / len(ORDERS)
    paths = huffman(bytes_)
    length = np.array([len(p) for p in paths], np.int64)
    model = Model(np.cumsum(length) - length, length, np.array([n for p in paths for n, _ in p], np.int32),
                  np.array([b for p in paths for _, b in p], np.int8), [], np.zeros(0), np.zeros((GATES, len(ORDERS))))
    ones, all_ = np.zeros((256, 256), np.float32), np.zeros((256, 256), np.float32)
    for byte, path in enumerate(paths):
        for node, bit in path:
            ones[byte, node], all_[byte, node] = bit, 1
    n1, n, base = [], [], 0
    for bits in TABLE_BITS:
        right, total = (np.zeros((1 << SLOT_BITS) + 256, np.float32) for _ in range(2))
        for low in range(0, 1 << bits, 4096):  # so many contexts at a time
            begin, end = np.searchsorted(slots, [base + low * 256, base + (low + 4096) * 256])
            table = np.zeros((4096, 256), np.float32)
            table.ravel()[slots[begin:end] - base - low * 256] = counts[begin:end]
            used = table @ all_
            context, node = np.nonzero(used)
            where = decision_keys(context + low) + node
            np.add.at(total, where, used[context, node])
            np.add.at(right, where, (table @ ones)[context, node])
        model.odds.append(np.log((right + 0.3) / (total - right + 0.3)))
        n1.append(right), n.append(total)
        base += 256 << bits
    model.seen = _gate(n[-1])
    model.weights[:] = 0.4
    if isinstance(training, DataFrame):
        cells = count_cells(training, replace(model, odds=_levels(n1, n), seen=model.seen[:0])).toArrow()  # a row per cell at most
        _fit_weights(model, cells.column("cell").to_numpy(), cells.column("n").to_numpy())
    return model


def _gate(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1) / 1.5, GATES - 1).astype(np.uint8)


def _events(model: Model, flat: np.ndarray, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For every bit of the bytes ``own``: its slot for each order, its value, and the bits up to each byte's end."""
    size = model.code_length[flat] * own  # own: 1 or 0 for each byte
    ends = np.cumsum(size)
    code = np.repeat((model.code_start[flat] - (ends - size)).astype(np.int32), size)
    code += np.arange(len(code), dtype=np.int32)
    node = model.nodes[code]
    slots = []
    for context in contexts(flat):
        slot = np.repeat(decision_keys(context), size)
        slot += node
        slots.append(slot)
    return slots, model.bits[code], ends


def _level_odds() -> np.ndarray:
    """The odds of each level: close to each other around zero, where most bits are decided, wider apart at the ends."""
    return 2.3 * np.sinh((np.arange(LEVELS) - (LEVELS - 1) / 2) / 6)


def _levels(n1: list[np.ndarray], n: list[np.ndarray]) -> list[np.ndarray]:
    """Per order the level of slot * 2 + bit, the bit itself taken out of the counts it is judged by; the last one also tells the gate."""
    odds = _level_odds()
    between = (odds[1:] + odds[:-1]) / 2
    out = []
    for right, total in zip(n1, n):
        level = np.empty(2 * len(total), np.uint8)
        for bit in (0, 1):
            r, t = right - bit, total - 1
            level[bit::2] = np.searchsorted(between, np.log((np.maximum(r, 0) + 0.3) / (np.maximum(t - r, 0) + 0.3)))
        out.append(level)
    out[-1] += np.repeat(_gate(np.maximum(n[-1] - 1, 0)) * np.uint8(LEVELS), 2)
    return out


def count_cells(training: DataFrame, model: Model) -> DataFrame:
    """(cell, n): how often bits of the texts have a gate, levels of odds and a value; ``model.odds`` are the ``_levels``."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(2 * GATES * LEVELS ** len(ORDERS), np.int64)
        for batch in chunks(batches, size=COUNT_BYTES):
            flat, begin, end = joined(batch.column("text").to_pylist())
            inside = _inside(len(flat), begin, end)
            for low in range(0, len(flat), LEVEL_BYTES):
                first = max(low - ORDERS[-1], 0)  # bytes before, as context only
                counted = inside[first:low + LEVEL_BYTES].astype(np.int64)
                counted[:low - first] = 0
                slots, bits, _ = _events(own, flat[first:low + LEVEL_BYTES], counted)
                cell = np.zeros(len(bits), np.int32)
                for level, slot in zip(own.odds[::-1], slots[::-1]):
                    slot <<= 1
                    slot |= bits
                    cell *= LEVELS
                    cell += level.take(slot)
                cell <<= 1
                cell |= bits
                total += np.bincount(cell, minlength=len(total))
        found = np.flatnonzero(total)
        if len(found):
            yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(total[found])], ["cell", "n"])

    return training.select("text").mapInArrow(each, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _fit_weights(model: Model, cells: np.ndarray, counts: np.ndarray) -> None:
    """Logistic regression per gate over all counted bits."""
    order = np.argsort(cells)
    cells, counts, odds = cells[order].astype(np.int64), counts[order].astype(np.float64), _level_odds()
    bits, rest = cells & 1, cells >> 1
    levels = []
    for _ in ORDERS:
        levels.append(odds[rest % LEVELS])
        rest = rest // LEVELS
    for g in range(GATES):
        own = rest == g
        times = counts[own]
        if times.sum() < 1000:
            continue
        x, y = np.stack([o[own] for o in levels], 1), bits[own] * 2.0 - 1
        curb = 1e-3 * times.sum()  # towards the starting weights

        def cost(w: np.ndarray) -> float:
            return float((times * np.logaddexp(0, -y * (x @ w))).sum() + curb * ((w - 0.4) ** 2).sum() / 2)

        w, now = model.weights[g].copy(), cost(model.weights[g])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (times * p * (1 - p))[:, None]).T @ x + curb * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (times * ((y > 0) - p)) - curb * (w - 0.4))
            while np.abs(step).max() > 1e-4 and cost(w + step) > now:
                step = step / 2
            if np.abs(step).max() <= 1e-4:
                break
            w, now = w + step, cost(w + step)
        model.weights[g] = w


# -- scoring -----------------------------------------------------------------------------------

LIMIT = 14.0  # log odds of a bit at most


def log10_probability(model: Model, texts_: list[bytes]) -> np.ndarray:
    """The log10 probability of each text."""
    flat, text_begin, text_end = joined(texts_)
    out = np.zeros(len(texts_))
    # Stretches of SEGMENT bytes; contexts reach back into the stretch before.
    pieces = -(-(text_end - text_begin) // SEGMENT)
    owner = np.repeat(np.arange(len(pieces)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = text_begin[owner] + number * SEGMENT
    end = np.minimum(begin + SEGMENT, text_end[owner])
    low = 0
    while low < len(owner):  # about SEGMENT x LANES bytes at a time
        first = int(begin[low]) - ORDERS[-1]  # bytes before, as context only
        high = max(low + 1, min(low + 4 * LANES, int(np.searchsorted(end, first + SEGMENT * LANES, side="right"))))
        loss = _code(model, flat[first:int(end[high - 1])], begin[low:high] - first, end[low:high] - first)
        np.add.at(out, owner[low:high], -loss / np.log(10))
        low = high
    return out


def _code(model: Model, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The loss in nats of each stretch [begin, end) of the bytes, all coded side by side.

    The odds of all bits are looked up at once; then ``STEP`` bits of every
    stretch are coded with its present weights, which then take their step.
    """
    slots, bits, ends = _events(model, flat, _inside(len(flat), begin, end).astype(np.int64))
    total = len(bits)
    sign = (bits * 2 - 1).astype(np.float32)  # odds are those of the bit that came
    wide = AHEAD * STEP
    gate, base = model.seen.take(slots[-1], mode="clip").astype(np.intp), np.zeros(total + wide, np.float32)
    odds, weighted = [], np.empty(total, np.float32)
    for k, slot in enumerate(slots):
        value = np.empty(total + wide, np.float32)
        value[total:] = 0
        model.odds[k].take(slot, out=value[:total], mode="clip")
        value[:total] *= sign
        model.weights[:, k].astype(np.float32).take(gate, out=weighted, mode="clip")
        weighted *= value[:total]
        base[:total] += weighted
        odds.append(value)
    del slots, gate, bits, sign, weighted
    first = ends[begin - 1]
    n_bits = ends[end - 1] - first
    order = np.argsort(-n_bits, kind="stable")
    n_bits, first = n_bits[order], first[order]
    lanes, steps = len(order), -(-n_bits // STEP)
    deltas = [np.zeros(lanes, np.float32) for _ in odds]
    product, loss = np.ones(lanes), np.zeros(lanes)
    windows = [np.lib.stride_tricks.sliding_window_view(v, wide) for v in (base, *odds)]
    active = lanes - np.searchsorted(steps[::-1], np.arange(int(steps[0])), side="right")
    for step, n in enumerate(active.tolist()):
        if step % AHEAD == 0:  # the next bits of every stretch: step x bit x stretch
            parts = [w[first[:n] + step * STEP] for w in windows]
            left = n_bits[:n] - step * STEP
            whole = int(np.searchsorted(-left, -wide, side="right"))
            if whole < n:  # bits that are certain and without odds fill up what lies behind an end
                behind = np.arange(wide)[None, :] >= left[whole:, None]
                for part, fill in zip(parts, (LIMIT, *[0] * len(odds))):
                    part[whole:][behind] = fill
            laid = [np.ascontiguousarray(p.reshape(n, AHEAD, STEP).transpose(1, 2, 0)) for p in parts]
        x, *values = (np.ascontiguousarray(p[step % AHEAD, :, :n]) for p in laid)
        for value, delta in zip(values, deltas):
            x += value * delta[:n]
        np.clip(x, -LIMIT, LIMIT, out=x)
        np.negative(x, out=x)
        np.exp(x, out=x)  # odds against the bit that came
        one = x + 1
        product[:n] *= one.prod(axis=0, dtype=np.float64)
        x /= one
        for value, delta in zip(values, deltas):
            value *= x
            delta[:n] += RATE * value.sum(axis=0)
        if step % 4 == 3:
            loss += np.log(product)
            product[:] = 1
    loss += np.log(product) - (steps * STEP - n_bits) * np.log1p(np.exp(-LIMIT))
    out = np.empty(lanes)
    out[order] = loss
    return out


# -- the operator ------------------------------------------------------------------------------

BLOCKS = ("block bigint, bucket int, words binary, length binary, n binary, "
          "docs struct<doc_id:array<bigint>,remainder:array<int>,n_words:array<int>,"
          "score:array<double>,words:binary,place:binary>")


def _blocks(docs: DataFrame, model: Model, held: int, buckets: int) -> DataFrame:
    """Per block of texts: a row of its different words of each bucket (n: how often in training texts), and one row of its texts.

    ``place`` lists the block's words by bucket; a bucket's words, lengths and counts are in that order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs_type = pa.struct([("doc_id", pa.list_(pa.int64())), ("remainder", pa.list_(pa.int32())),
                           ("n_words", pa.list_(pa.int32())), ("score", pa.list_(pa.float64())),
                           ("words", pa.binary()), ("place", pa.binary())])
    names = ["block", "bucket", "words", "length", "n", "docs"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, size=BLOCK_BYTES):
            block = task << 32 | number
            number += 1
            content = batch.column("text").to_pylist()
            rest = np.array(batch.column("remainder").to_pylist(), np.int32)
            words, own, n_words = cut_words([t.translate(LOWER) for t in content])
            n = np.bincount(own[np.repeat(rest != held, n_words)], minlength=len(words)).astype("<i4")
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int32)
            length = np.array(list(map(len, words)), "<i4")
            place = np.argsort(bucket, kind="stable").astype("<i4")
            score = log10_probability(shared.value, content)
            kinds, begin = np.unique(bucket[place], return_index=True)
            parts = [place[i:j] for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(place)])]
            if parts:
                yield pa.record_batch([
                    pa.array(np.full(len(parts), block)), pa.array(kinds),
                    pa.array([b"".join([words[i] for i in p.tolist()]) for p in parts], pa.binary()),
                    pa.array([length[p].tobytes() for p in parts], pa.binary()),
                    pa.array([n[p].tobytes() for p in parts], pa.binary()), pa.nulls(len(parts), docs_type)], names)
            row = {"doc_id": batch.column("doc_id").to_pylist(), "remainder": rest.tolist(), "n_words": n_words.tolist(),
                   "score": score.tolist(), "words": own.astype("<i4").tobytes(), "place": place.tobytes()}
            yield pa.record_batch([pa.array([block]), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 3,
                                   pa.array([row], docs_type)], names)

    return docs.mapInArrow(each, BLOCKS)


def word_totals(blocks: DataFrame) -> DataFrame:
    """(block, bucket, total, n_all, n_kinds): the totals of a block's words of a bucket; in a row without block, what the bucket adds to N and V."""

    def each(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        text, length, n = (b"".join(rows.column(c).to_pylist()) for c in ("words", "length", "n"))
        ends = np.append(0, np.cumsum(np.frombuffer(length, "<i4"), dtype=np.int64))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        number = words.indices.to_numpy()
        total = np.zeros(len(words.dictionary), np.int64)
        np.add.at(total, number, np.frombuffer(n, "<i4").astype(np.int64))
        sizes = [len(x) // 4 for x in rows.column("length").to_pylist()]
        own = [x.astype("<i8").tobytes() for x in np.split(total[number], np.cumsum(sizes)[:-1])]
        return pa.table({
            "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
            "bucket": pa.array([*rows.column("bucket").to_pylist(), None], pa.int32()), "total": pa.array([*own, None], pa.binary()),
            "n_all": pa.array([None] * len(own) + [int(total.sum())], pa.int64()),
            "n_kinds": pa.array([None] * len(own) + [int(np.count_nonzero(total))], pa.int64())})

    return blocks.filter("words is not null").select("block", "bucket", "words", "length", "n").groupBy("bucket").applyInArrow(
        each, "block bigint, bucket int, total binary, n_all bigint, n_kinds bigint")


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    with scope(spark) as keep:
        source = texts(docs).withColumn("remainder", remainder(F.col("doc_id"), modulus))
        training = source.filter(F.col("remainder") != held)
        slots = written(count_contexts(training.select("text")), "contexts")
        found = slots.toArrow()  # at most FLAT rows: the size of the hashed tables
        n_docs = training.count()
        model = build(found.column("slot").to_numpy(), found.column("n").to_numpy(), training)

        n_bytes = int(np.sum(found.column("n").to_numpy())) // len(ORDERS)
        blocks = written(_blocks(source, model, held, max(BUCKETS, n_bytes // BUCKET_BYTES)), "blocks")
        totals = written(word_totals(blocks), "totals")
        zero = F.lit(0)
        size = totals.agg(F.coalesce(F.sum("n_all"), zero), F.coalesce(F.sum("n_kinds"), zero)).first()
        n_all, n_kinds = size[0] + n_docs, size[1] + (n_docs > 0)
        back = totals.filter("block is not null").groupBy("block").agg(
            F.array_sort(F.collect_list(F.struct("bucket", "total"))).alias("totals"))
        texts_ = blocks.filter("docs is not null").select("block", "docs")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    d = batch.column("docs")[row].as_py()
                    totals_ = batch.column("totals")[row].as_py() or []  # none for a block without words
                    place = np.frombuffer(d["place"], "<i4")
                    c = np.zeros(len(place), np.int64)
                    c[place] = np.frombuffer(b"".join([t["total"] for t in totals_]), "<i8")
                    own = c[np.frombuffer(d["words"], "<i4")]
                    n = np.array(d["n_words"], np.int64)
                    known = np.concatenate([[0], np.cumsum(own > 0)])
                    ends = np.cumsum(n)
                    spread = np.log10(n_all + 1.0 * (n_kinds + 1))
                    per_doc = [np.log10(own[e - k:e] + 1.0).sum() for e, k in zip(ends.tolist(), n.tolist())]
                    base = np.array(per_doc) + np.log10(n_docs + 1.0) - (n + 1) * spread
                    yield pa.record_batch([
                        pa.array(d["doc_id"], pa.int64()), pa.array([r == held for r in d["remainder"]]), pa.array(n + 1),
                        pa.array(known[ends] - known[ends - n] + int(n_docs > 0)), pa.array(np.full(len(n), n_all, np.int64)),
                        pa.array(base), pa.array(d["score"], pa.float64())],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        scored = texts_.join(back.hint("merge"), "block", "left").mapInArrow(
            each, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                  "base_score double, score double")
        return keep(scored, "lm_scores")
