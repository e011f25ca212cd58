"""The reply forest: parents, subtree totals, positions, paths.

An entry points at its parent; submissions have none.  All recursive results
come from pointer doubling: in round k every entry knows its ancestor 2^k
steps up, so log2(depth) rounds suffice, each over at most one row per entry.
Pairs of an entry with each of its ancestors are never listed for sums.

Entry ids must be unique.  An entry whose parent is its own submission is
known to sit right below the root, so the keys of huge threads' roots stay out
of the joins; skew at deeper entries is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.functions.columns import STANCE_SUFFIX
from threadstats.storage import Rounds, small_side, written

# 2^24 steps from an entry to its root; more means that parents form a cycle.
MAX_ROUNDS = 24

DIRECT = {stance: f"rd_{s}" for stance, s in STANCE_SUFFIX.items()}
ALL = {stance: f"r_{s}" for stance, s in STANCE_SUFFIX.items()}


class CyclicForest(ValueError):
    """Some entries never reach a root by following their parents."""

    def __init__(self) -> None:
        super().__init__(f"parents form a cycle or a path longer than 2^{MAX_ROUNDS}")


def repair_orphans(entries: DataFrame) -> DataFrame:
    """Hang comments whose parent is missing on their submission.

    Comments that answer the submission itself need no lookup: a repair would
    give the same parent.  They bypass the join and its shuffle.
    """
    asks = F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("submission_id"))
    known = small_side(entries.select(F.col("entry_id").alias("known_id")).distinct(), "known-entries")
    looked_up = entries.filter(asks).join(
        known, F.col("parent_id") == F.col("known_id"), "left"
    )
    repaired = looked_up.withColumn(
        "parent_id",
        F.when(F.col("known_id").isNull(), F.col("submission_id")).otherwise(F.col("parent_id")),
    ).drop("known_id")
    return entries.filter(~F.coalesce(asks, F.lit(False))).unionByName(repaired)


def replies_with_parent(entries: DataFrame) -> DataFrame:
    """Replies counted by (parent, author, period, stance), with the parent's
    author and stance; both NULL if the parent is not among the entries."""
    replies = (
        entries.filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id", "author", "period", "stance")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parents = entries.select(
        F.col("entry_id").alias("parent_id"),
        F.col("author").alias("parent_author"),
        F.col("stance").alias("parent_stance"),
    )
    return replies.join(parents, "parent_id", "left")


def parent_stance_counts(replies: DataFrame) -> DataFrame:
    """Per author and period, the number of comments on entries of each stance."""
    return replies.groupBy("author", "period").agg(*[
        F.sum(F.when(F.col("parent_stance") == stance, F.col("n")).otherwise(F.lit(0))).alias(f"cs{suffix}")
        for stance, suffix in STANCE_SUFFIX.items()
    ])


def direct_reply_counts(entries: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Direct replies by others to each entry, split by the replier's stance."""
    replies = replies_with_parent(entries) if replies is None else replies
    zero = F.lit(0).cast("bigint")
    others = replies.filter(F.col("author") != F.col("parent_author")).select(
        F.col("parent_id").alias("entry_id"),
        *[F.when(F.col("stance") == s, F.col("n")).otherwise(zero).alias(c) for s, c in DIRECT.items()],
    )
    none = entries.select("entry_id", *[zero.alias(c) for c in DIRECT.values()])
    return others.unionByName(none).groupBy("entry_id").agg(*[F.sum(c).alias(c) for c in DIRECT.values()])


def _doubled(state: DataFrame, measures: list[str]) -> DataFrame:
    """One round: pass totals to the ancestor pointed at, move the pointer on."""
    zero = [F.lit(0).cast("bigint").alias(m) for m in measures]
    nothing = F.lit(None).cast("string")
    active = state.filter(F.col("ancestor_id").isNotNull())
    kept = state.select("entry_id", nothing.alias("ancestor_id"), "root_id", *measures)
    passed = active.select(
        F.col("ancestor_id").alias("entry_id"), nothing.alias("ancestor_id"),
        nothing.alias("root_id"), *measures,
    )
    further = active.select(
        F.col("entry_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id")
    )
    moved = (
        active.filter(F.col("ancestor_id") != F.col("root_id"))
        .select("entry_id", "ancestor_id")
        .join(further, "ancestor_id")
        .select("entry_id", F.col("next_id").alias("ancestor_id"), nothing.alias("root_id"), *zero)
    )
    return (
        kept.unionByName(passed).unionByName(moved)
        .groupBy("entry_id")
        .agg(
            F.max("ancestor_id").alias("ancestor_id"),
            F.max("root_id").alias("root_id"),
            *[F.sum(m).alias(m) for m in measures],
        )
    )


def subtree_totals(entries: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Sum each measure over the entry itself and all its descendants.

    After round k a row holds the total over descendants less than 2^k steps
    away; adding the totals of those exactly 2^k away doubles the reach.
    """
    names = list(measures)
    rounds = Rounds(entries.sparkSession, "subtree")
    state = rounds.write(
        entries.select(
            "entry_id",
            F.col("parent_id").alias("ancestor_id"),
            F.coalesce("submission_id", "entry_id").alias("root_id"),
            *[c.cast("bigint").alias(name) for name, c in measures.items()],
        )
    )
    for _ in range(MAX_ROUNDS + 1):
        if state.filter(F.col("ancestor_id").isNotNull()).isEmpty():
            # Rows without a root belong to parents that are no entries.
            return state.filter(F.col("root_id").isNotNull()).select("entry_id", *names)
        state = rounds.write(_doubled(state, names))
    raise CyclicForest


def subtree_size(entries: DataFrame) -> DataFrame:
    """Number of entries in the subtree of each entry, itself included."""
    return subtree_totals(entries, {"n_entries": F.lit(1)})


def _is(stance: int) -> Column:
    return (F.col("stance") == stance).cast("bigint")


def reply_counts(entries: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Replies to each entry, split by the stance of the replier.

    ``rd_*`` count direct replies by others; ``r_*`` count all descendants
    except direct replies by the entry's own author.  Columns ``author``,
    ``period``, ``stance`` and ``is_comment`` describe the entry itself.  All
    parts are stacked and summed by entry, so one shuffle joins them.
    """
    replies = replies_with_parent(entries) if replies is None else replies
    totals = subtree_totals(entries, {ALL[s]: _is(s) for s in ALL})
    zero = F.lit(0).cast("bigint")
    counts = [*DIRECT.values(), *ALL.values()]
    about = {
        "author": F.lit(None).cast("string"), "period": F.lit(None).cast("int"),
        "stance": F.lit(None).cast("int"), "is_comment": F.lit(None).cast("boolean"),
    }

    def part(df: DataFrame, entry: str, columns: Mapping[str, Column]) -> DataFrame:
        return df.select(
            F.col(entry).alias("entry_id"),
            *[columns.get(name, default).alias(name) for name, default in about.items()],
            *[columns.get(name, zero).alias(name) for name in counts],
        )

    own = F.col("author") == F.col("parent_author")
    direct = part(
        replies.filter(F.col("parent_author").isNotNull()), "parent_id",
        {DIRECT[s]: F.when(~own & (F.col("stance") == s), F.col("n")).otherwise(zero) for s in DIRECT}
        | {ALL[s]: F.when(own & (F.col("stance") == s), -F.col("n")).otherwise(zero) for s in ALL},
    )
    below = part(totals, "entry_id", {ALL[s]: F.col(ALL[s]) for s in ALL})
    itself = part(
        entries, "entry_id",
        {ALL[s]: -_is(s) for s in ALL}
        | {c: F.col(c) for c in ("author", "period", "stance")}
        | {"is_comment": F.col("comment_id").isNotNull()},
    )
    return (
        direct.unionByName(below).unionByName(itself)
        .groupBy("entry_id")
        .agg(*[F.max(c).alias(c) for c in about], *[F.sum(c).alias(c) for c in counts])
    )


def thread_positions(entries: DataFrame) -> DataFrame:
    """Root and depth of every entry; a missing submission still is a root."""
    start = entries.select(
        "entry_id",
        F.coalesce("parent_id", "entry_id").alias("root_id"),
        F.col("parent_id").isNotNull().cast("int").alias("depth"),
        (F.col("parent_id").isNull() | (F.col("parent_id") == F.col("submission_id"))).alias("settled"),
    )
    state = written(start, "positions-0")
    settled = state.filter("settled")
    open_rows = state.filter("not settled")
    for round_number in range(1, MAX_ROUNDS + 2):
        if open_rows.isEmpty():
            return settled.drop("settled")
        above = settled.unionByName(open_rows).select(
            F.col("entry_id").alias("root_id"), F.col("root_id").alias("next_id"),
            F.col("depth").alias("more"), F.col("settled").alias("next_settled"),
        )
        moved = written(
            open_rows.join(above, "root_id", "left").select(
                "entry_id",
                F.coalesce("next_id", "root_id").alias("root_id"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.coalesce("next_settled", F.lit(True)).alias("settled"),
            ),
            f"positions-{round_number}",
        )
        settled = settled.unionByName(moved.filter("settled"))
        open_rows = moved.filter("not settled")
    raise CyclicForest


def thread_depth(entries: DataFrame) -> DataFrame:
    """Per thread: entries, greatest depth and direct replies to the root."""
    return thread_positions(entries).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.max("depth").alias("max_depth"),
        F.count_if(F.col("depth") == 1).alias("n_children"),
    )


def _ancestor_tables(entries: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Tables (entry_id, ancestor_id) for distances 1, 2, 4, ...

    Each must be used up before the next is asked for.
    """
    rounds = Rounds(entries.sparkSession, "ancestors")
    hop = rounds.write(
        entries.filter(F.col("parent_id").isNotNull()).select(
            "entry_id", F.col("parent_id").alias("ancestor_id")
        )
    )
    for k in range(MAX_ROUNDS + 1):
        if hop.isEmpty():
            return
        yield 2**k, hop
        further = hop.select(
            F.col("entry_id").alias("ancestor_id"), F.col("ancestor_id").alias("far_id")
        )
        hop = rounds.write(
            hop.join(further, "ancestor_id").select("entry_id", F.col("far_id").alias("ancestor_id"))
        )
    raise CyclicForest


def descendants(entries: DataFrame, of: DataFrame) -> DataFrame:
    """All descendants of the entries asked for: (of_id, entry_id, depth).

    ``of`` has a column ``entry_id`` and may name submissions that are not
    among the entries.  The result is as large as the subtrees asked for: for
    all submissions it has one row per comment.
    """
    found = of.select(
        F.col("entry_id").alias("of_id"), F.col("entry_id").alias("at_id"), F.lit(0).alias("depth")
    )
    rounds = Rounds(entries.sparkSession, "descendants")
    for distance, hop in _ancestor_tables(entries):
        new = found.join(hop, F.col("at_id") == F.col("ancestor_id")).select(
            "of_id", F.col("entry_id").alias("at_id"), (F.col("depth") + distance).alias("depth")
        )
        found = rounds.write(found.unionByName(new))
    return found.filter(F.col("depth") > 0).withColumnRenamed("at_id", "entry_id")


def path_to_root(entries: DataFrame, of: DataFrame) -> DataFrame:
    """The ancestors of the entries asked for: (of_id, entry_id, distance)."""
    found = of.select(
        F.col("entry_id").alias("of_id"), F.col("entry_id").alias("at_id"), F.lit(0).alias("distance")
    )
    rounds = Rounds(entries.sparkSession, "paths")
    for distance, hop in _ancestor_tables(entries):
        new = found.join(hop, F.col("at_id") == F.col("entry_id")).select(
            "of_id", F.col("ancestor_id").alias("at_id"),
            (F.col("distance") + distance).alias("distance"),
        )
        found = rounds.write(found.unionByName(new))
    return found.withColumnRenamed("at_id", "entry_id")


def deepest_entries(entries: DataFrame) -> DataFrame:
    """The deepest entry of each thread; the smallest id if several are."""
    return (
        thread_positions(entries)
        .groupBy("root_id")
        .agg(F.min_by("entry_id", F.struct(-F.col("depth"), "entry_id")).alias("entry_id"))
        .select("entry_id")
    )
