"""Packing texts into sequences by minimum bin slack.

A text's ids, with an end, are cut into full sequences and a remainder.  The
remainders are packed by their lengths alone: a bitset subset-sum picks the
multiset of remaining lengths that fills the next sequence, beginning with the
longest length left, and backtracking gives how often it takes each length; the
multiset is then used as often as the remaining counts allow.  Texts and slots
of one length are matched by rank.  Lengths that no multiset fills up to the
last id are left over: they are laid end to end and cut at the sequences' ends,
and the last stretch at powers of two, so that nothing is padded.

Only the number of remainders of each length (fewer than ``size`` rows) reaches
the driver.  Ranks are counted within tasks and shifted by the sums of the tasks
before, so a length that a third of all texts share is in no one's hands.  Texts
whose remainder is cut are encoded once more to give the parts' checksums.

Null texts are empty; an empty text is one id, the end.  Rows without an id and
repeated rows are packed like any other.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadstats.llm import tokens
from threadstats.llm.shared import chunks, texts
from threadstats.storage import scope, written

END = 2
PIECE = ("doc_id bigint, row_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
         "task int, task_rank bigint")


def ids_of(batch: list[bytes], path: str) -> list[np.ndarray]:
    return [np.append(ids, np.uint32(END)) for ids in tokens.encoder(path).encode(batch)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def fill(lengths: list[int], counts: dict[int, int], size: int) -> dict[int, int] | None:
    """A multiset of the lengths (length -> times) that adds up to ``size``, with the longest length in it.

    ``lengths`` ascend.  Bit s of ``reached[k]`` says that the longest length and
    the longest k of those that still fit can add up to s.
    """
    first, full = lengths[-1], (1 << (size + 1)) - 1
    if first == size:
        return {first: 1}
    fitting = lengths[bisect_right(lengths, size - first) - 1::-1] if lengths[0] <= size - first else []
    reached = [1 << first]
    for length in fitting:
        bits = reached[-1]
        for _ in range(min(counts[length] - (length == first), (size - first) // length)):
            more = bits | (bits << length) & full
            if more == bits:
                break
            bits = more
            if bits >> size:
                break
        reached.append(bits)
        if bits >> size:
            break
    if not reached[-1] >> size:
        return None
    left, taken = size, {first: 1}
    for k in range(len(reached) - 1, 0, -1):
        length = fitting[k - 1]
        while not reached[k - 1] >> left & 1:  # what the longer lengths can't reach, this one gives
            left -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Multisets that fill a sequence, with how often each is used, and the counts left over.

    A longest length that no multiset of the rest completes never will be
    completed later, when less is left: it is set aside.
    """
    counts, found, aside = {length: n for length, n in counts.items() if n}, [], {}
    lengths = sorted(counts)
    while lengths:
        taken = fill(lengths, counts, size)
        if taken is None:
            longest = lengths.pop()
            aside[longest] = counts.pop(longest)
            continue
        times = min(counts[length] // n for length, n in taken.items())
        found.append((taken, times))
        for length, n in taken.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
                lengths.remove(length)
    return found, aside


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences that a last stretch of ``total`` ids is cut into: powers of two, longest first."""
    out, at = [], 0
    for bit in reversed(range(size.bit_length())):
        if total >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def _pieces(docs: DataFrame, path: str, size: int) -> DataFrame:
    """Full sequences and remainders of every row; task_rank counts the pieces of a length within the task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, task, row = np.zeros(size + 1, np.int64), TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist(), path)):
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    out.append((doc_id, task << 40 | row, start, len(piece), checksum(piece), len(ids), task,
                                int(ranks[len(piece)])))
                    ranks[len(piece)] += 1
                row += 1
            columns = list(zip(*out))
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                  [c.split()[0] for c in PIECE.split(", ")])

    return texts(docs).mapInArrow(each, PIECE)


def pack(docs: DataFrame, path: str, size: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    with scope(spark) as keep:
        pieces = written(_pieces(docs, path, size), "pieces")
        in_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        shift = written(in_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shift")
        ranked = pieces.join(shift.hint("merge"), ["length", "task"]).withColumn("rank", F.col("task_rank") + F.col("before"))
        counts = {row[0]: row[1] for row in in_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
        found, rest = plan(counts, size)

        # Slots of a length in the order of the plan: [first, last) ranks, per use `times`, from sequence `sequence` on.
        used: dict[int, int] = {}
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for taken, times in found:
            offset = 0
            for length, n in sorted(taken.items(), reverse=True):
                slots.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
                used[length] = used.get(length, 0) + n * times
                offset += n * length
            sequence += times
        table = {length: np.array(rows, np.int64) for length, rows in slots.items()}
        tail: dict[int, int] = {}
        at = 0
        for length in sorted(rest, reverse=True):
            tail[length] = at
            at += length * rest[length]
        whole, ends = at // size, cuts(at % size, size)
        tail_from = sequence

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts_at = np.array([s for s, _ in ends], np.int64)
            for batch in batches:
                length = batch.column("length").to_numpy()
                rank = batch.column("rank").to_numpy()
                rows, part, count, where, offset = [], [], [], [], []
                for one in np.unique(length).tolist():
                    mine = np.flatnonzero(length == one)
                    r = rank[mine]
                    fits = r < used.get(one, 0)
                    if fits.any():
                        first, n, sequence_, offset_ = table[one][
                            np.searchsorted(table[one][:, 0], r[fits], side="right") - 1].T
                        k = r[fits] - first
                        rows.append(mine[fits]), part.append(np.zeros(len(k), np.int64))
                        count.append(np.full(len(k), one)), where.append(sequence_ + k // n)
                        offset.append(offset_ + k % n * one)
                    for i, begin in zip(mine[~fits].tolist(), (tail.get(one, 0) + (r[~fits] - used.get(one, 0)) * one).tolist()):
                        done = 0
                        while done < one:  # cut where sequences end
                            at_ = begin + done
                            if at_ // size < whole:
                                number, inside, room = at_ // size, at_ % size, size - at_ % size
                            else:
                                k = int(np.searchsorted(starts_at, at_ - whole * size, side="right")) - 1
                                inside = at_ - whole * size - ends[k][0]
                                number, room = whole + k, ends[k][1] - inside
                            taken_ = min(room, one - done)
                            rows.append([i]), part.append([done]), count.append([taken_])
                            where.append([tail_from + number]), offset.append([inside])
                            done += taken_
                take = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
                own = batch.take(pa.array(take))
                flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (part, count, where, offset)]
                start = own.column("start").to_numpy() + flat[0]
                cut = flat[1] != own.column("length").to_numpy()
                yield pa.record_batch(
                    [own.column("doc_id"), own.column("row_id"), pa.array(start), pa.array(flat[1]), own.column("ids_crc32"),
                     own.column("doc_tokens"), pa.array(flat[2]), pa.array(flat[3]), pa.array(cut)],
                    ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"])

        out = written(ranked.select("doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
            placed, "doc_id bigint, row_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                    "sequence_id bigint, offset bigint, cut boolean"), "placed")
        result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        done, again = out.filter(~F.col("cut")), out.filter("cut")
        if not again.isEmpty():
            again = _checked(docs, again, path)
            return keep(done.select(result).union(again.select(result)), "packed")
        return keep(done.select(result), "packed")


def _checked(docs: DataFrame, again: DataFrame, path: str) -> DataFrame:
    """The parts of cut remainders with their checksums; their texts are encoded once more.

    Rows that repeat an id may hold different texts: a part belongs to a text
    with as many ids, and equal numbers are told apart by the piece's checksum.
    """
    parts = written(again.groupBy("doc_id", "row_id").agg(
        F.max("doc_tokens").alias("doc_tokens"), F.max("ids_crc32").alias("whole"),
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts")), "cut")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "row_id", "doc_tokens", "whole", "parts")]
            for (doc_id, row_id, n, whole, parts_), ids in zip(zip(*columns), ids_of(batch.column("text").to_pylist(), path)):
                low = min(p["start"] for p in parts_)
                high = max(p["start"] + p["length"] for p in parts_)
                if len(ids) == n and checksum(ids[low:high]) == whole:
                    out += [(doc_id, row_id, p["start"], p["length"], checksum(ids[p["start"]:p["start"] + p["length"]]), n,
                             p["sequence_id"], p["offset"]) for p in parts_]
            names = ["doc_id", "row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    found = texts(docs).withColumnRenamed("doc_id", "own").join(
        parts, F.col("own").eqNullSafe(F.col("doc_id"))).select("doc_id", "row_id", "doc_tokens", "whole", "parts", "text")
    names = "doc_id bigint, row_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, " \
            "sequence_id bigint, offset bigint"
    return found.mapInArrow(each, names).dropDuplicates(["row_id", "start"])
