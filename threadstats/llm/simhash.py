"""SimHash near-duplicates by a generalised pigeonhole over bit partitions.

A text's fingerprint is the bitwise majority of the hashes of its word
shingles.  Texts link if their fingerprints differ in at most ``max_bits`` bits.

Equal fingerprints are one node, so copies never pair up.  The 64 bits are cut
into partitions that keep correlated bits together.  If partition i gets a
budget of e_i and the budgets sum to ``max_bits + 1``, two fingerprints within
``max_bits`` bits differ in at most e_i - 1 bits in some partition i (else they
would differ in max_bits + 1 bits in all).  Every fingerprint picks its own
budgets by dynamic programming over the candidates that each radius is
estimated to bring, looks up all variants of its partitions within the radius,
and is compared with what it finds.

Nulls and empty texts have the fingerprint zero and link like any other; a null
id takes part too but is never a component's name (a component of null ids only
has a null name).  Repeated rows stay repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.llm.components import components
from threadstats.llm.shared import LOWER, chunks, texts
from threadstats.storage import scope, written

SEED = 42
BITS = 64
#: Bits of a partition that the histogram of its values looks at: 2^16 counts at most.
HISTOGRAM_BITS = 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text, as a signed 64-bit number."""
    plain = b" ".join(text.translate(LOWER).split())
    if not plain:
        return 0
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.append(spaces, len(plain))
    n = max(1, len(starts) - width + 1)
    starts, ends = (starts[:n], ends[width - 1:]) if len(starts) >= width else (starts[:1], ends[-1:])
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, n, 65536):  # memory for the bits of so many shingles
        spans = zip(starts[low:low + 65536].tolist(), ends[low:low + 65536].tolist())
        hashes = np.array([digest(plain[i:j], SEED) for i, j in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [fingerprint(text, width) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(each, "doc_id bigint, fp bigint")


# -- how the bits are cut up -------------------------------------------------------------------

def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set: 64 x 64 counts over all rows, summed by task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float64)
            total += bits.T @ bits
        yield pa.record_batch([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel())], ["place", "n"])

    rows = fps.select("fp").mapInArrow(partial, "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for place, n in rows.collect():  # 4,096 rows at any size of the input
        out[place] = n
    return out.reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit i of each number in column i."""
    return ((values.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def partitions(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` equal groups; each takes the bit that correlates most with its members."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [max(left, key=lambda i: related[i, left].max())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda i: related[i, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def variants(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def choose_parts(n: int, max_bits: int) -> int:
    """The number of partitions with the least estimated work, for n fingerprints of even bits."""

    def work(parts: int) -> float:
        width = BITS // parts
        each = [(max_bits + 1) // parts + (i < (max_bits + 1) % parts) for i in range(parts)]
        looked = sum(variants(width, e - 1) for e in each if e)
        return looked * (1 + n / 2.0 ** width)

    return min(range(1, max_bits + 2), key=work)


def compositions(total: int, parts: int) -> list[tuple[int, ...]]:
    if parts == 1:
        return [(total,)]
    return [(e, *rest) for e in range(total + 1) for rest in compositions(total - e, parts - 1)]


def part_value(fp, bits: list[int]):
    """The partition's bits as one number: runs of neighbouring bits are moved together."""
    moved, place, i = [], 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        length = j - i + 1
        mask = (1 << length) - 1
        run = F.shiftrightunsigned(fp, bits[i]) if bits[i] else fp
        moved.append(F.shiftleft(run.bitwiseAND(F.lit(mask).cast("bigint")), place) if length < 64 else fp)
        place, i = place + length, j + 1
    return reduce(lambda a, b: a.bitwiseOR(b), moved)


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def ball_counts(histogram: np.ndarray, max_radius: int) -> np.ndarray:
    """For each radius and value: how many rows have a value within the radius."""
    exact = [histogram.astype(np.float64)] + [np.zeros(len(histogram)) for _ in range(max_radius)]
    places = np.arange(len(histogram))
    for bit in range(int(np.log2(len(histogram)))):
        flipped = places ^ (1 << bit)
        exact = [exact[r] + (exact[r - 1][flipped] if r else 0) for r in range(max_radius + 1)]
    return np.cumsum(exact, axis=0)


def budgets(values: list[np.ndarray], balls: list[np.ndarray], widths: list[int], total: int) -> np.ndarray:
    """Each row's budgets: the split of ``total`` among the partitions with the least estimated work.

    Dynamic programming over the partitions: best[t] is the least cost of the
    partitions so far if they share a budget of t.
    """
    n = len(values[0])
    best = np.full((total + 1, n), np.inf)
    best[0] = 0
    chosen = np.zeros((len(values), total + 1, n), np.int8)
    for k, (value, ball, width) in enumerate(zip(values, balls, widths)):
        seen = value & np.uint64((1 << min(width, HISTOGRAM_BITS)) - 1)
        cost = np.zeros((total + 1, n))
        for e in range(1, total + 1):
            share = variants(width, e - 1) / variants(min(width, HISTOGRAM_BITS), e - 1)
            cost[e] = variants(width, e - 1) + ball[e - 1][seen] * share / 2.0 ** max(0, width - HISTOGRAM_BITS)
        after = np.full((total + 1, n), np.inf)
        for t in range(total + 1):
            for e in range(t + 1):
                tried = best[t - e] + cost[e]
                better = tried < after[t]
                after[t][better] = tried[better]
                chosen[k, t][better] = e
        best = after
    out, left = np.zeros((len(values), n), np.int64), np.full(n, total)
    for k in reversed(range(len(values))):
        out[k] = np.take_along_axis(chosen[k], left[None, :], 0)[0]
        left = left - out[k]
    return out


def linked_pairs(nodes: DataFrame, max_bits: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b), a > b: pairs of different fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    ``nodes`` is a written table of distinct fingerprints.
    """
    spark, n = nodes.sparkSession, nodes.count()
    parts = parts or choose_parts(n, max_bits)
    groups = partitions(bit_counts(nodes), n, parts)
    widths, total = [len(g) for g in groups], max_bits + 1
    fp = F.col("fp")
    index = nodes.select("fp", F.posexplode(F.array(*[part_value(fp, g) for g in groups])).alias("part", "value"))
    seen = F.col("value") % (1 << HISTOGRAM_BITS)
    histograms = [np.zeros(1 << min(w, HISTOGRAM_BITS), np.int64) for w in widths]
    low = F.when(seen < 0, seen + (1 << HISTOGRAM_BITS)).otherwise(seen)
    for part, value, rows in index.groupBy("part", low.alias("v")).count().collect():  # at most parts x 2^16 rows
        histograms[part][value] = rows
    balls = [ball_counts(h, max_bits) for h in histograms]
    shared = spark.sparkContext.broadcast(balls)  # parts x (max_bits + 1) x 2^16 numbers at most

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [[np.array([sum(1 << b for b in c) for c in combinations(range(w), r)], np.uint64)
                  for r in range(total)] for w in widths]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column("fp").slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.uint64)
                values = [_values(fps, g) for g in groups]
                given = budgets(values, shared.value, widths, total)
                for k in range(parts):
                    for r in range(total):
                        rows = given[k] > r
                        if rows.any():
                            looked = (values[k][rows][:, None] ^ flips[k][r][None, :]).ravel()
                            yield pa.record_batch([
                                pa.array(np.repeat(fps[rows], len(flips[k][r])).view(np.int64)),
                                pa.array(np.full(len(looked), k, np.int32)), pa.array(looked.view(np.int64))],
                                ["q", "part", "value"])

    looked = nodes.select("fp").mapInArrow(probes, "q bigint, part int, value bigint")
    close = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= max_bits
    return (
        looked.join(index.hint("merge"), (looked["part"] == index["part"]) & (looked["value"] == index["value"])
                    & (F.col("q") > F.col("fp")) & close)
        .select(F.col("q").alias("a"), F.col("fp").alias("b"))
    )


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for every row of ``docs``.

    fingerprint: 16 hex digits; component_id: the smallest doc_id reachable
    by links; n_same: rows with exactly this fingerprint.
    """
    with scope(docs.sparkSession) as keep:
        fps = written(fingerprints(docs, width), "fingerprints")
        nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")), "nodes")
        labels = written(components(linked_pairs(nodes.select("fp"), max_bits)), "labels")
        named = written(
            nodes.join(labels.hint("merge"), nodes["fp"] == labels["node"], "left")
            .select("fp", "first", "n_same", F.coalesce("label", "fp").alias("label")), "named")
        names = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "names")
        nodes = written(named.join(names.hint("merge"), "label").select("fp", "n_same", "component_id"), "nodes")
        digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
        return keep(fps.join(nodes.hint("merge"), "fp").select(
            "doc_id", digits.alias("fingerprint"), "component_id", "n_same"), "simhash")


def one_per_group(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group, with all columns of ``docs``: the one whose id names the component.

    Of rows that repeat that id one stays.  Rows without an id can't be told
    apart by it and all stay.
    """
    with scope(docs.sparkSession) as keep:
        kept = written(simhash_groups(docs, width, max_bits).filter("doc_id = component_id")
                       .groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n")), "kept")
        found = docs.join(kept.hint("merge"), docs["doc_id"] == kept["kept_id"], "left_semi")
        if not kept.filter("n > 1").isEmpty():
            found = found.dropDuplicates(["doc_id"])
        return keep(found.union(docs.filter("doc_id is null")), "one_per_group")
