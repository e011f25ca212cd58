"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is the one whose pieces' scores add up to most
(the unigram model's rule; every piece and score comes from the model file).  A
text longer than ``CHUNK`` characters is split into chunks wherever they end.  A
chunk gives a transfer matrix: entry state k means that the first cut at or after
its start lies k characters behind it, the exit state says the same of its end,
and the entry is the best sum between them.  Matrices combine by the max-plus
product, which is associative: blocks of chunks are combined first, then each
document's blocks, and the states found go back to blocks and chunks, each of
which is then traced back independently of all others.

Where no piece reaches over a point (before a space mark that follows another
character), every segmentation has a cut: the words between such points are
segmented once per task and remembered.

A file of the merge (BPE) type holds ranks instead of scores: ``encode`` gives
the ids of the library's merging, and the scan (``scan``) is for the others.  No
merge reaches over a point that no piece reaches over, so a long text is cut at
such points and its stretches are merged apart; a longer word stays whole.  If a
model's words cannot be merged apart, each text is merged whole.

In the scan, equal sums of different pieces go to the
larger fixed preference (``tie``), so a text gets the same pieces however it is
split; only orders of the same pieces may then differ.  A character that no
piece covers costs ``UNKNOWN`` more than the worst piece and becomes its bytes'
pieces, or the unknown piece if the model has none (neighbours are one).

Null and empty texts have no pieces.  Rows without an id and repeated rows are
encoded like any other.  Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.llm.shared import chunks, texts
from threadstats.storage import scope, written

SPACE = "▁"
UNKNOWN = 10.0
CHUNK, BLOCK = 32_768, 64
MEMO = 500_000  # words that a Python worker remembers
MERGED_BYTES = 1 << 20  # of text that a task merges at once
IDS = 200_000  # that a task decodes at once
NEVER = -np.inf
_BASE = np.uint64(0x100000001B3)


def tie(piece: int) -> float:
    """A preference far below any difference of scores."""
    return 1e-6 * (piece * 7919 % 1000)


def fields(data: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protobuf message; pieces (field 1 of a model) are only passed over."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            out[key >> 3] = data[at:at + size]
            at += size
    return out


class Pieces:
    """The pieces of a model, and segmentation with them."""

    def __init__(self, path: str) -> None:
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
        self.unknown_id = model.unk_id()
        self.not_text = {*self.byte_of, self.unknown_id}
        self.score = {self.text[i]: (model.get_score(i) + tie(i), i) for i in plain}
        self.unknown = min((model.get_score(i) for i in plain), default=0.0) - UNKNOWN
        self.longest = max((len(self.text[i]) for i in plain), default=1)
        self.words_apart = not any(SPACE in self.text[i].lstrip(SPACE) for i in plain)
        file = fields(model.serialized_model_proto())
        training, rule = fields(file.get(2, b"")), fields(file.get(3, b""))
        self.merges = training.get(3, 1) == 2
        # Words normalise to themselves, each begins with a space mark, and unknown characters are bytes.
        self.merged_apart = (self.words_apart and SPACE in self.score and len(self.bytes) == 256 and not rule.get(2)
                             and rule.get(3, 1) == 1 and rule.get(4, 1) == 0 and rule.get(5, 1) == 1 and not training.get(24))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.best: dict[str, float] = {}

    @cached_property
    def hashed(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces by length: sorted hashes, scores, ids.  Only segmentation by scores needs them."""
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            own = [i for score, i in self.score.values() if len(self.text[i]) == length]
            if own:
                codes = np.array([[ord(c) for c in self.text[i]] for i in own], np.uint64)
                key = np.zeros(len(own), np.uint64)
                for k in range(length):
                    key = key * _BASE + codes[:, k] + np.uint64(1)
                order = np.argsort(key)
                if len(np.unique(key)) < len(key):
                    raise ValueError("two pieces share a hash")
                found[length] = (key[order], np.array([self.score[self.text[i]][0] for i in own])[order],
                                 np.array(own, np.int64)[order])
        return found

    # -- one word or stretch ------------------------------------------------------------------

    def steps(self, text: str, start: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, piece) of every piece that begins at ``start``; piece -1 is an unknown character."""
        single = self.score.get(text[start])
        yield (start + 1, *single) if single else (start + 1, self.unknown, -1)
        for end in range(start + 2, min(len(text), start + self.longest) + 1):
            found = self.score.get(text[start:end])
            if found:
                yield (end, *found)

    def forward(self, text: str, entry: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best sums to every position from the entry vectors (one row per first position).

        Steps begin before ``stop`` only.  Also the last step's start and piece
        for the first column, which is what a single entry needs.
        """
        best = np.full((len(text) + 1, entry.shape[1]), NEVER)
        best[:len(entry)] = entry
        came, piece = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1)
        for start in range(min(stop, len(text))):
            here = best[start]
            if here.max() == NEVER:
                continue
            for end, score, which in self.steps(text, start):
                reached = here + score
                if reached[0] > best[end, 0]:
                    came[end], piece[end] = start, which
                np.maximum(best[end], reached, out=best[end])
        return best, came, piece

    def spelled(self, text: str, cuts: list[tuple[int, int, int]]) -> list[int]:
        """Ids of (start, end, piece) steps; unknown characters become bytes."""
        out: list[int] = []
        before = False
        for start, end, piece in cuts:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in text[start:end].encode("utf-8", "replace")]
            elif not before:
                out.append(self.unknown_id)
            before = piece < 0
        return out

    def trace(self, text: str, came: np.ndarray, piece: np.ndarray, end: int, begin: int) -> list[int]:
        cuts = []
        while end > begin:
            cuts.append((int(came[end]), end, int(piece[end])))
            end = int(came[end])
        return self.spelled(text, cuts[::-1])

    # -- many words ---------------------------------------------------------------------------

    def learn(self, words: list[str]) -> None:
        """Segment words side by side: position by position, one piece length at a time."""
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear(), self.best.clear()
        for low in range(0, len(words), 20_000):
            self._learn(sorted(words[low:low + 20_000], key=len, reverse=True))

    def _learn(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(lengths) - lengths
        left = np.repeat(start + lengths, lengths) - np.arange(len(flat))  # characters to the word's end
        scores, ids = {}, {}
        key = np.zeros(len(flat), np.uint64)
        for length in range(1, min(self.longest, int(lengths[0])) + 1):
            own = np.flatnonzero(left >= length)
            key[own] = key[own] * _BASE + flat[own + length - 1] + np.uint64(1)
            score, which = np.full(len(flat), NEVER), np.full(len(flat), -1)
            if length in self.hashed:
                keys, values, pieces = self.hashed[length]
                at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                hit = keys[at] == key[own]
                score[own[hit]], which[own[hit]] = values[at[hit]], pieces[at[hit]]
            if length == 1:
                score[score == NEVER] = self.unknown
            elif not (which >= 0).any():
                continue
            scores[length], ids[length] = score, which
        best = np.full((int(lengths[0]) + 1, len(words)), NEVER)
        back = np.zeros((int(lengths[0]) + 1, len(words)), np.int8)
        best[0] = 0
        active = len(words) - np.searchsorted(lengths[::-1], np.arange(1, int(lengths[0]) + 1), side="left")
        for p, n in enumerate(active.tolist(), 1):
            for length in scores:
                if length <= p:
                    reached = best[p - length, :n] + scores[length][start[:n] + p - length]
                    better = reached > best[p, :n]
                    best[p, :n][better] = reached[better]
                    back[p, :n][better] = length
        for w, word in enumerate(words):
            end, cuts = len(word), []
            while end:
                length = int(back[end, w])
                cuts.append((end - length, end, int(ids[length][start[w] + end - length])))
                end -= length
            self.memo[word] = tuple(self.spelled(word, cuts[::-1]))
            self.best[word] = float(best[len(word), w])

    # -- texts --------------------------------------------------------------------------------

    def normal(self, text: bytes) -> str:
        return self.model.normalize(text.decode("utf-8", "replace"))

    def split(self, text: str) -> list[str]:
        """The words: each begins with its space marks; the whole text if pieces reach over spaces."""
        if not self.words_apart:
            return [text] if text else []
        parts = text.split(SPACE)
        words, marks = [], 0
        for k, part in enumerate(parts):
            marks += k > 0
            if part:
                words.append(SPACE * marks + part)
                marks = 0
        if marks:
            words.append(SPACE * marks)
        return words

    def encode(self, texts_: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts_]
        memo = self.memo
        new = list({w for words in split for w in words if w not in memo})
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear(), self.best.clear()
                new = list({w for words in split for w in words})
            self.learn(new)
        return [[i for w in words for i in memo[w]] for words in split]

    def merged(self, stretches: list[str]) -> list[list[int]]:
        """The ids of stretches of normalised texts by the library's merging, if ``merged_apart``."""
        found = self.model.encode([t[1:] for t in stretches], num_threads=1)  # which puts the first space mark back
        return [[self.score[SPACE][1]] if t == SPACE else ids for t, ids in zip(stretches, found)]

    def stretches(self, normal: str, chunk: int) -> list[str]:
        """A text cut before words, ``chunk`` characters at most; a longer word is a stretch of its own."""
        out, part, size = [], [], 0
        for word in self.split(normal):
            if part and size + len(word) > chunk:
                out.append("".join(part))
                part, size = [], 0
            part.append(word)
            size += len(word)
        return [*out, "".join(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces, bytes put together, space marks as spaces, without the leading space."""
        if self.not_text.isdisjoint(ids):
            text = "".join([self.text[i] for i in ids]).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i] if i != self.unknown_id else " ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    # -- chunks -------------------------------------------------------------------------------

    def forced(self, text: str, stop: int) -> tuple[int, int] | None:
        """The first and the last point in [0, stop) that no piece reaches over."""
        if not self.words_apart:
            return None
        points = [p for p in range(1, stop) if text[p] == SPACE and text[p - 1] != SPACE]
        return (points[0], points[-1]) if points else None

    def transfer(self, text: str, size: int, last: bool) -> np.ndarray:
        """The matrix of a chunk of ``size`` characters; ``text`` goes on behind it for longest - 1 more."""
        states = self.longest
        entry = np.full((states, states), NEVER)
        np.fill_diagonal(entry, 0)
        points = self.forced(text, size)
        if points is None:
            best, _, _ = self.forward(text, entry[:len(text) + 1], size)
            return self._exits(best, size, states, last).T
        first, final = points
        head, _, _ = self.forward(text[:first], entry[:first + 1], first)
        words = self.split(text[first:final])
        new = list({w for w in words if w not in self.best})
        if new:
            self.learn(new)
            missing = list({w for w in words if w not in self.best})  # forgotten while learning
            if missing:
                self.learn(missing)
        middle = sum(self.best[w] for w in words)
        tail, _, _ = self.forward(text[final:], np.zeros((1, 1)), size - final)
        ways = self._exits(tail, size - final, states, last)
        return head[first][:, None] + middle + ways[:, 0][None, :]

    @staticmethod
    def _exits(best: np.ndarray, size: int, states: int, last: bool) -> np.ndarray:
        out = np.full((states, best.shape[1]), NEVER)
        if last:
            out[0] = best[-1]
        else:
            got = best[size:size + states]
            out[:len(got)] = got
        return out

    def backtrace(self, text: str, size: int, last: bool, enter: int, leave: int) -> list[int]:
        """The ids of a chunk between its entry and exit states."""
        end = len(text) if last else size + leave
        points = self.forced(text, size)
        if points is None or enter > points[0]:
            body = text[enter:end]
            _, came, piece = self.forward(body, np.zeros((1, 1)), size - enter)
            return self.trace(body, came, piece, len(body), 0)
        first, final = points
        head = self.encode([text[enter:first]])[0] if not self.words_apart or first > enter else []
        middle = self.encode([text[first:final]])[0]
        body = text[final:end]
        _, came, piece = self.forward(body, np.zeros((1, 1)), size - final)
        return head + middle + self.trace(body, came, piece, len(body), 0)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best way through a, then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states_between(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states at the boundaries of consecutive stretches on the best way from ``enter`` to ``leave``."""
    values = [np.full(len(matrices[0]), NEVER)]
    values[0][enter] = 0
    for m in matrices:
        reached = (values[-1][:, None] + m).max(axis=0)
        values.append(reached - reached.max())
    out = [leave]
    for value, m in zip(reversed(values[:-1]), reversed(matrices)):
        out.append(int(np.argmax(value + m[:, out[-1]])))
    return out[::-1]


def _split_texts(docs: DataFrame, path: str, chunk: int, long_: bool) -> DataFrame:
    """Texts of at most ``chunk`` characters as ids; or the chunks of the longer ones."""
    schema = ("row_id bigint, doc_id bigint, chunk int, size int, last boolean, piece_text string" if long_
              else "doc_id bigint, ids array<int>")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, row = pieces(path), TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            ids, plain = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if long_:
                for doc_id, text in zip(ids, plain):
                    row += 1
                    normal = own.normal(text)
                    if len(normal) <= chunk:
                        continue
                    starts = range(0, len(normal), chunk)
                    for k in range(0, len(starts), 64):
                        part = starts[k:k + 64]
                        yield pa.record_batch([
                            pa.array([task << 32 | row] * len(part)), pa.array([doc_id] * len(part), pa.int64()),
                            pa.array([s // chunk for s in part], pa.int32()),
                            pa.array([min(chunk, len(normal) - s) for s in part], pa.int32()),
                            pa.array([s + chunk >= len(normal) for s in part]),
                            pa.array([normal[s:s + chunk + own.longest - 1] for s in part], pa.string())],
                            ["row_id", "doc_id", "chunk", "size", "last", "piece_text"])
            else:
                normal = [own.normal(t) for t in plain]
                short = [k for k, t in enumerate(normal) if len(t) <= chunk]
                found = own.encode([normal[k] for k in short])
                yield pa.record_batch([pa.array([ids[k] for k in short], pa.int64()),
                                       pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(each, schema)


def _matrix(flat: list[float], states: int) -> np.ndarray:
    return np.array(flat, np.float64).reshape(states, states)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) for every row: by merging or by the best segmentation, as the model's type asks.

    Call it inside a ``scope`` that outlives the result.
    """
    return merge(docs, path, chunk) if pieces(path).merges else scan(docs, path, chunk)


def merge(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) for every row: the library's ids for a model of the merge type."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in chunks(batches, size=MERGED_BYTES):
            plain = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            keep = [k for k, t in enumerate(plain) if not own.merged_apart or len(t) <= chunk]
            found = own.model.encode([plain[k] for k in keep], num_threads=1)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(keep, pa.int64())),
                                   pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, row = pieces(path), TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                if len(text.decode("utf-8", "replace")) <= chunk:  # as given: normalising every text would take longer than cutting
                    continue
                parts = own.stretches(own.normal(text), chunk)
                for k in range(0, len(parts), 64):
                    part = parts[k:k + 64]
                    yield pa.record_batch([
                        pa.array([task << 32 | row] * len(part)), pa.array([doc_id] * len(part), pa.int64()),
                        pa.array(range(k, k + len(part)), pa.int32()), pa.array(part, pa.string())],
                        ["row_id", "doc_id", "chunk", "piece_text"])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in chunks(batches, "piece_text", MERGED_BYTES):
            found = own.merged(batch.column("piece_text").to_pylist())
            yield pa.record_batch([batch.column("row_id"), batch.column("doc_id"), batch.column("chunk"),
                                   pa.array(found, pa.list_(pa.int32()))], ["row_id", "doc_id", "chunk", "ids"])

    found = texts(docs).mapInArrow(short, "doc_id bigint, ids array<int>")
    if not pieces(path).merged_apart:
        return found
    long_ = texts(docs).filter(F.octet_length("text") > chunk)  # no shorter text has more characters
    parts = written(long_.mapInArrow(cut, "row_id bigint, doc_id bigint, chunk int, piece_text string")
                    .repartition("row_id", "chunk"), "stretches")
    return found.union(_whole(parts.mapInArrow(ids_of, "row_id bigint, doc_id bigint, chunk int, ids array<int>")))


def _whole(chunk_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of each text from the ids of its chunks."""
    whole = written(chunk_ids.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")), "traced")
    return whole.select("doc_id", F.flatten("parts.ids").alias("ids"))


def scan(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) for every row: the ids of the best segmentation of the whole text.

    Only the ids of texts longer than ``chunk`` are written; call it inside a
    ``scope`` that outlives the result.
    """
    states = pieces(path).longest
    if chunk < states:
        raise ValueError(f"a chunk holds at least the longest piece: {states} characters")
    parts = written(_split_texts(docs, path, chunk, True).repartition("row_id", "chunk"), "chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            rows = batch.select(["piece_text", "size", "last"]).to_pylist()
            found = [own.transfer(r["piece_text"], r["size"], r["last"]) for r in rows]
            # Only differences decide: a matrix is kept relative to its best entry.
            flat = [(m - m.max()).ravel().tolist() for m in found]
            yield pa.record_batch([batch.column("row_id"), batch.column("chunk"), pa.array(flat, pa.list_(pa.float64()))],
                                  ["row_id", "chunk", "matrix"])

    matrices = written(parts.mapInArrow(transfers, "row_id bigint, chunk int, matrix array<double>")
                       .withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "transfers")

    def ordered(table: pa.Table, key: str) -> tuple[list[int], list[np.ndarray]]:
        rows = sorted(zip(table.column(key).to_pylist(), table.column("matrix").to_pylist()), key=lambda r: r[0])
        return [k for k, _ in rows], [_matrix(m, states) for _, m in rows]

    def product(table: pa.Table) -> pa.Table:
        _, found = ordered(table, "chunk")
        total = found[0]
        for m in found[1:]:
            total = combine(total, m)
            total = total - total.max()
        return pa.table({"row_id": table.column("row_id")[:1], "block": table.column("block")[:1],
                         "matrix": pa.array([total.ravel().tolist()])})

    def block_states(table: pa.Table) -> pa.Table:  # one document: as many rows as a cell can hold blocks
        blocks, found = ordered(table, "block")
        way = states_between(found, 0, 0)
        return pa.table({"row_id": pa.array([table.column("row_id")[0].as_py()] * len(blocks), pa.int64()),
                         "block": pa.array(blocks, pa.int32()), "enter": pa.array(way[:-1], pa.int32()),
                         "leave": pa.array(way[1:], pa.int32())})

    def chunk_states(table: pa.Table) -> pa.Table:
        numbers, found = ordered(table, "chunk")
        way = states_between(found, table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
        return pa.table({"row_id": pa.array([table.column("row_id")[0].as_py()] * len(numbers), pa.int64()),
                         "chunk": pa.array(numbers, pa.int32()), "enter": pa.array(way[:-1], pa.int32()),
                         "leave": pa.array(way[1:], pa.int32())})

    blocks = written(matrices.groupBy("row_id", "block").applyInArrow(
        product, "row_id bigint, block int, matrix array<double>"), "blocks")
    ways = written(blocks.groupBy("row_id").applyInArrow(
        block_states, "row_id bigint, block int, enter int, leave int"), "ways")
    inner = written(matrices.join(ways, ["row_id", "block"]).groupBy("row_id", "block").applyInArrow(
        chunk_states, "row_id bigint, chunk int, enter int, leave int"), "inner")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            rows = batch.select(["piece_text", "size", "last", "enter", "leave"]).to_pylist()
            found = [own.backtrace(r["piece_text"], r["size"], r["last"], r["enter"], r["leave"]) for r in rows]
            yield pa.record_batch([batch.column("row_id"), batch.column("doc_id"), batch.column("chunk"),
                                   pa.array(found, pa.list_(pa.int32()))], ["row_id", "doc_id", "chunk", "ids"])

    chunk_ids = parts.join(inner, ["row_id", "chunk"]).mapInArrow(
        traced, "row_id bigint, doc_id bigint, chunk int, ids array<int>")
    return _split_texts(docs, path, chunk, False).union(_whole(chunk_ids))


def of_size(batches: Iterator[pa.RecordBatch], size: int = IDS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the ids of each number about ``size`` (a longer text is taken whole)."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in of_size(batches):
            found = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(found, pa.string())],
                                  ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id bigint, ids array<int>, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_bytes, text_crc32): checksums of the ids and of the text that decoding gives back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in of_size(batches):
            rows, flat = [], batch.column("ids").flatten().to_numpy().astype("<u4")
            ends = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(), dtype=np.int64)
            for ids in np.split(flat, ends[:-1]):
                text = own.decode(ids.tolist()).encode()
                rows.append((len(ids), zlib.crc32(ids), len(text), zlib.crc32(text)))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                                  ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "text_crc32"])

    return encoded.select("doc_id", "ids").mapInArrow(
        each, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, n_bytes bigint, text_crc32 bigint")
