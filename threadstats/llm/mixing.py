"""Mixing sources to target weights by balanced sampling with the cube method.

Sources, in the order of their names, get shares of all words by repeating
weights; a target stops at ``most`` times its source's words and the excess is
shared again by weight.  A source's rate (target / words) gives every document a
whole number of copies and a fractional probability of one more.

The cube method moves these probabilities, within a source, along directions that
keep two totals, the words and the documents taken, until a probability reaches
0 or 1 (flight).  Documents are dealt to blocks of bounded size; a block's flight
leaves two of them open at most, and the open ones of all blocks meet in the next
round, so a source of any size needs a logarithmic number of rounds.  A ladder of
documents of falling size is kept out of the flight; with what the last flight
leaves open they are the landing problem: a few dozen documents at most, for
which the choice nearest to the source's target is found by meeting in the middle.
If whole documents leave a source further from its target than the tolerance (say, one
document holds most of its words), one document of the landing problem takes part of a copy.

Documents of a source with equal id and size are alike: they are counted, and the
probabilities within such a group are moved at once.  So results depend on the
rows alone, not on their order or partitions, and reruns agree.

Null texts and texts without words have size 0; their copies count as documents
only.  Null ids and repeated rows are returned as often as they come.  Null is a
source of its own, the last one.  If all sizes are 0 all targets are 0.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.operators.numbering import numbered
from threadstats.storage import broadcast_up_to, scope, written

WORD = r"[^\x20\x09-\x0D]+"
#: Open documents that one task moves, and rows of equal documents that one row stands for.
BLOCK, COPIES = 4096, 4096
#: Documents kept out of the flight, and open ones that the last flight may leave: the landing problem.
LADDER, OPEN = 18, 6
#: A probability this near to 0 or 1 has reached it.
REACHED = 1e-9
#: Sources whose rates are sent to every task; beyond it the join is shuffled.
MAX_BROADCAST_SOURCES = 1_000_000

#: A group of alike documents; ``taken_up`` of its ``n`` take a copy more for certain, and one with probability ``p``.
UNIT = "source_no bigint, doc_id bigint, size bigint, n bigint, taken_up bigint, p double, ladder int, slack double"
UNIT_COLUMNS = [column.split()[0] for column in UNIT.split(", ")]


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to the written table (source_no, source_size).

    Shares by weight; what a target has above ``most`` times its source's size is shared
    again among the others, until none is above.
    """
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("source_no") % len(weights)).cast("int")]
    cap = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # the level only rises, and ends when it stops no further source
        above = cap < weight * level
        row = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, weight)), F.lit(0))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], (whole - row[1]) / row[2]
    return sources.withColumn("target", F.least(cap.cast("double"), weight * F.lit(level)))


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, keep: int) -> np.ndarray:
    """Move probabilities so that their sum and the sum of probability times size stay.

    Documents enter a window in the given order.  Three open ones always have a direction
    that changes neither total; both its ends are tried with the chances that keep every
    probability's expectation.  Ends when ``keep`` documents, or fewer than three, are open.
    """
    p = p.tolist()
    sizes = sizes.tolist()
    chance = iter(rng.random(len(p) + 1).tolist())
    window: list[int] = []
    entering = iter(range(len(p)))
    open_left = sum(REACHED < x < 1 - REACHED for x in p)
    while open_left > max(keep, 2):
        while len(window) < 3:
            i = next(entering)
            if REACHED < p[i] < 1 - REACHED:
                window.append(i)
        i, j, k = window
        a, b, c = sizes[i], sizes[j], sizes[k]
        u = (b - c, c - a, a - b)
        if a == b == c:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for place, d in zip(window, u):
            if d > 0:
                up, down = min(up, (1 - p[place]) / d), min(down, p[place] / d)
            elif d < 0:
                up, down = min(up, p[place] / -d), min(down, (1 - p[place]) / -d)
        step = up if next(chance) * (up + down) < down else -down
        for place, d in zip(window, u):
            p[place] = min(max(p[place] + step * d, 0.0), 1.0)
        still = [x for x in window if REACHED < p[x] < 1 - REACHED]
        open_left -= len(window) - len(still)
        window = still
    return np.array(p)


def landing(sizes: np.ndarray, wanted_words: float, wanted_documents: float) -> np.ndarray:
    """Which documents to take: words nearest to the wanted ones, then documents; the first such choice.

    Sums of all choices of each half are sorted, and every choice of one half meets the nearest of the other.
    """
    half = len(sizes) // 2
    masks = [(np.arange(1 << len(part))[:, None] >> np.arange(len(part))) & 1 for part in (sizes[:half], sizes[half:])]
    left, right = masks[0] @ sizes[:half].astype(np.int64), masks[1] @ sizes[half:].astype(np.int64)
    order = np.lexsort((masks[1].sum(1), right))
    right, right_masks = right[order], masks[1][order]
    at = np.searchsorted(right, wanted_words - left)
    best = None
    for shift in (-1, 0):
        place = np.clip(at + shift, 0, len(right) - 1)
        # Of equal sums those with few documents come first; the last of them has the most.
        for side in ("left", "right"):
            same = np.searchsorted(right, right[place], side=side) - (side == "right")
            off = np.abs(left + right[same] - wanted_words)
            count = np.abs(masks[0].sum(1) + right_masks[same].sum(1) - wanted_documents)
            pick = np.lexsort((count, off))[0]
            found = (off[pick], count[pick], pick, same[pick])
            best = found if best is None or found < best else best
    return np.concatenate([masks[0][best[2]], right_masks[best[3]]]).astype(float)


def cut(sizes: np.ndarray, taken: np.ndarray, gap: float) -> np.ndarray:
    """Close the gap left by the nearest choice: the smallest document that can takes part of a copy more, or less."""
    fits = np.flatnonzero((sizes >= abs(gap)) & (taken == (gap < 0)))
    taken = taken.copy()
    if len(fits):
        one = fits[sizes[fits].argmin()]
        taken[one] += gap / sizes[one]
    return taken


def _seed(frame: pd.DataFrame, seed: int) -> np.random.Generator:
    first = frame.iloc[0]
    return np.random.default_rng([seed, int(first["source_no"]), len(frame), int(frame["size"].sum())])


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    """Largest first, so that large documents settle while others can make up for them; equal rows are alike."""
    return frame.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], na_position="last", kind="stable")


def fly(units: DataFrame, blocks: Column, number: int, seed: int) -> DataFrame:
    """One round: the flight of each block of each source's open documents."""

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        moved = flight(frame["size"].to_numpy(), frame["p"].to_numpy(), _seed(frame, seed + number), 0)
        return frame.assign(p=moved)[UNIT_COLUMNS]

    block = F.pmod(F.xxhash64("doc_id", "size", F.lit(number)), blocks)
    dealt = units.withColumn("block", block)
    return dealt.groupBy("source_no", "block").applyInPandas(move, UNIT)


def land(units: DataFrame, seed: int) -> DataFrame:
    """The last flight of each source and its landing problem, whose documents become 0 or 1 but for one that may be cut."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        sizes, p = frame["size"].to_numpy(), frame["p"].to_numpy().copy()
        ladder = frame["ladder"].to_numpy() == 1
        words, documents = float(sizes @ p), float(p.sum())
        rest = np.flatnonzero(~ladder)
        p[rest] = flight(sizes[rest], p[rest], _seed(frame, seed), max(2, LADDER + OPEN - int(ladder.sum())))
        p = np.where(p <= REACHED, 0.0, np.where(p >= 1 - REACHED, 1.0, p))
        free = np.flatnonzero(ladder | ((p > 0) & (p < 1)))
        done = np.ones(len(p), bool)
        done[free] = False
        words -= float(sizes[done] @ p[done])
        p[free] = landing(sizes[free], words, documents - float(p[done].sum()))
        gap = words - float(sizes[free] @ p[free])
        if abs(gap) > max(0.5, frame["slack"].iloc[0]):
            p[free] = cut(sizes[free], p[free], gap)
        return frame.assign(p=p)[UNIT_COLUMNS]

    return units.groupBy("source_no").applyInPandas(settle, UNIT)


def ladders(units: DataFrame) -> DataFrame:
    """Mark, per source, a few open documents of falling size: for each power of two the first by hash."""
    step = F.least(F.floor(F.log2(F.greatest("size", F.lit(1)))), F.lit(LADDER - 1)).cast("int")
    open_units = units.filter("p > 0").withColumn("step", step)
    key = F.struct(F.xxhash64("doc_id", "size"), "doc_id", "size")
    chosen = open_units.groupBy("source_no", "step").agg(F.min(key).alias("k")).select(
        "source_no", F.col("k.doc_id").alias("chosen_id"), F.col("k.size").alias("chosen_size"), F.lit(1).alias("mark"))
    chosen = broadcast_up_to(
        written(chosen.withColumnRenamed("source_no", "chosen_no"), "ladder"), MAX_BROADCAST_SOURCES)
    same = ((F.col("source_no") == F.col("chosen_no")) & F.col("doc_id").eqNullSafe(F.col("chosen_id"))
            & (F.col("size") == F.col("chosen_size")))
    return units.join(chosen, same, "left").select(
        *units.columns, F.coalesce("mark", F.lit(0)).alias("ladder")).select(*UNIT_COLUMNS)


def sampled(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """Move the probabilities ``p`` of the written table of units (see ``UNIT``) to 0 or 1, but for one cut document a source."""
    spark = units.sparkSession
    is_open = (F.col("p") > REACHED) & (F.col("p") < 1 - REACHED)
    flying = is_open & (F.col("ladder") == 0)
    settled = [units.filter(~is_open)]
    ladder = units.filter(is_open & (F.col("ladder") == 1))
    waiting = units.filter(flying)
    number = 0
    while True:
        counts = written(waiting.groupBy("source_no").agg(F.count(F.lit(1)).alias("open_units")), "open")
        largest = counts.agg(F.max("open_units")).first()[0] or 0
        if largest <= block:
            break
        number += 1
        small = broadcast_up_to(counts, MAX_BROADCAST_SOURCES)
        counted = waiting.join(small, "source_no")
        state = written(fly(counted, F.ceil(F.col("open_units") / block), number, seed), "flight")
        settled.append(state.filter(~is_open))
        waiting = state.filter(is_open)
    settled.append(written(land(waiting.unionByName(ladder), seed), "landing"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, tolerance: float = 0.001, seed: int = 11,
        block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row; ``tolerance`` is a share of a target."""
    with scope(docs.sparkSession) as keep:
        rows = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("bigint").alias("doc_id"),
                           word_count(F.col(text).cast("string")).alias("size"))
        alike = written(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "alike")
        totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
        placed = written(numbered(totals, [F.col("source").asc_nulls_last()], "source_no"), "sources")
        rated = written(targets(placed, weights, most), "targets")
        named = broadcast_up_to(rated.withColumnRenamed("source", "named"), MAX_BROADCAST_SOURCES)
        rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
        joined = alike.join(named, F.col("source").eqNullSafe(F.col("named"))).withColumn("rate", rate)
        # Alike documents: as many as their probabilities sum to take one copy more; one stays open.
        more = F.col("n") * (F.col("rate") - F.floor("rate"))
        units = joined.select(
            "source_no", "doc_id", "size", "n", F.floor(more).cast("bigint").alias("taken_up"),
            (more - F.floor(more)).alias("p"), (F.col("target") * tolerance).alias("slack"))
        units = written(ladders(written(units, "units")), "laddered")
        done = written(sampled(units, seed, block), "sampled")
        flat = done.select("source_no", "doc_id", "size", "n", "taken_up", "p").join(
            broadcast_up_to(rated.drop("source"), MAX_BROADCAST_SOURCES), "source_no")
        least = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("bigint")
        part = F.when((F.col("p") > REACHED) & (F.col("p") < 1 - REACHED), F.col("p")).otherwise(F.round("p"))
        flat = flat.select("doc_id", "size", "source_size", "target", "n", "taken_up", part.alias("p"), least.alias("least"))
        few = flat.filter(F.col("n") <= COPIES).withColumn("first", F.lit(0).cast("bigint"))
        many = flat.filter(F.col("n") > COPIES).withColumn(
            "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
        chunks = few.unionByName(many.repartition("doc_id", "size", "first"))
        last = F.least(F.col("n"), F.col("first") + COPIES) - 1
        each = chunks.withColumn("place", F.explode(F.sequence(F.col("first"), last)))
        more = F.when(F.col("place") < F.col("taken_up"), 1.0).when(F.col("place") == F.col("taken_up"), F.col("p"))
        more = F.coalesce(more, F.lit(0.0))
        taken = F.col("size") * F.col("least") + F.round(F.col("size") * more).cast("bigint")
        return keep(each.select("doc_id", "size", "source_size", "target", taken.alias("taken"),
                                (F.col("least") + more).alias("copies")), "mix")
