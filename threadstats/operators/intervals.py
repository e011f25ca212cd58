"""Interval labels of the reply forest: "below" as a test of ranges.

The entries are numbered in the order of a walk that visits an entry before its
replies, replies in the order of their ids, roots likewise.  The subtree of an
entry then is a range of numbers, ``start`` to ``stop``: descendants are found by
comparing numbers, and sums over a subtree are differences of running sums.

The walk is never made.  Subtree sizes come from pointer doubling; running sums
of the sizes in the order (parent, entry) say how far an entry lies behind its
parent; and a second doubling adds these steps up along the path to the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.operators.forest import MAX_ROUNDS, CyclicForest, subtree_totals
from threadstats.operators.numbering import running_sum
from threadstats.storage import written


def _with_missing_roots(entries: DataFrame) -> DataFrame:
    """(entry_id, parent_id, submission_id, known): the entries and the submissions that only their replies name."""
    own = entries.select("entry_id", "parent_id", F.coalesce("submission_id", "entry_id").alias("submission_id"),
                         F.lit(1).alias("known"))
    named = entries.filter(F.col("parent_id") == F.col("submission_id")).select(F.col("parent_id").alias("entry_id")).distinct()
    missing = written(named.join(entries.select("entry_id"), "entry_id", "left_anti"), "missing-roots")
    return own.unionByName(missing.select(
        "entry_id", F.lit(None).cast("string").alias("parent_id"), F.col("entry_id").alias("submission_id"),
        F.lit(0).alias("known")))


def _along_path(nodes: DataFrame) -> DataFrame:
    """(entry_id, root_id, depth, walked): the steps from the root to the entry, and their sum.

    ``nodes`` has entry_id, parent_id, submission_id and ``step``.  Entries right below their
    root are settled from the start, so the names of huge threads' roots stay out of the joins.
    """
    top = F.col("parent_id").isNull()
    state = written(nodes.select(
        "entry_id", F.coalesce("parent_id", "entry_id").alias("root_id"), (~top).cast("int").alias("depth"),
        F.when(top, 0).otherwise(F.col("step")).alias("walked"),
        (top | (F.col("parent_id") == F.col("submission_id"))).alias("settled")), "paths-0")
    settled, moving = state.filter("settled"), state.filter("not settled")
    for number in range(1, MAX_ROUNDS + 2):
        if moving.isEmpty():
            return settled.drop("settled")
        above = settled.unionByName(moving).select(
            F.col("entry_id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("depth").alias("more"),
            F.col("walked").alias("further"), F.col("settled").alias("next_settled"))
        moved = written(moving.join(above, "root_id").select(
            "entry_id", F.col("next_id").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("walked") + F.col("further")).alias("walked"), F.col("next_settled").alias("settled")), f"paths-{number}")
        settled, moving = settled.unionByName(moved.filter("settled")), moved.filter("not settled")
    raise CyclicForest


def interval_labels(entries: DataFrame) -> DataFrame:
    """(entry_id, root_id, start, stop, depth, is_entry) of every entry; a written table.

    ``entries`` has unique entry ids and repaired parents.  A submission that only its replies
    name has a number and a row too, with ``is_entry`` false.
    """
    nodes = written(_with_missing_roots(entries), "forest-nodes")
    sizes = written(subtree_totals(nodes, {"size": F.lit(1)}), "subtree-sizes")
    sized = nodes.join(sizes, "entry_id")
    # Everything before an entry in the order (parent, entry), less everything before its first sibling.
    running = written(running_sum(sized, ["parent_id", "entry_id"], "size", "running"), "sibling-sums")
    before = F.col("running") - F.col("size")
    first = written(running.filter("parent_id is not null").groupBy(F.col("parent_id").alias("of_id")).agg(
        F.min(before).alias("first")), "first-siblings")
    below = running.filter("parent_id is not null").join(first, F.col("parent_id") == F.col("of_id"))
    steps = below.select(*running.columns, (before - F.col("first") + 1).alias("step")).unionByName(
        running.filter("parent_id is null").withColumn("step", before))  # no parent sorts first: roots start at 0
    steps = written(steps, "steps")
    paths = written(_along_path(steps), "walked-paths")
    roots = written(steps.filter("parent_id is null").select(F.col("entry_id").alias("root_id"), F.col("step").alias("offset")), "root-offsets")
    start = F.col("offset") + F.col("walked")
    labelled = paths.join(roots, "root_id").join(steps.select("entry_id", "size", "known"), "entry_id")
    return written(labelled.select("entry_id", "root_id", start.alias("start"), (start + F.col("size") - 1).alias("stop"),
                                   "depth", (F.col("known") == 1).alias("is_entry")), "intervals")


def descendants_by_range(labels: DataFrame, of: DataFrame) -> DataFrame:
    """All descendants of the entries asked for: (of_id, entry_id, depth), by ranges within their thread.

    ``of`` has a column ``entry_id``.
    """
    asked = labels.join(of.select("entry_id").distinct(), "entry_id", "left_semi").select(
        F.col("entry_id").alias("of_id"), "root_id", F.col("start").alias("low"), F.col("stop").alias("high"),
        F.col("depth").alias("of_depth"))
    inside = (F.col("start") > F.col("low")) & (F.col("start") <= F.col("high"))
    return labels.filter("is_entry").join(asked, "root_id").filter(inside).select(
        "of_id", "entry_id", (F.col("depth") - F.col("of_depth")).alias("depth"))


def range_sums(labels: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(entry_id, total): the sum of an integer column of (entry_id, value) over every subtree, the entry included."""
    placed = labels.filter("is_entry").join(values.select("entry_id", F.col(value).cast("bigint").alias("own")), "entry_id")
    summed = written(running_sum(placed, ["start"], "own", "running"), "running-sums")
    last = summed.select(F.col("start").alias("stop"), F.col("running").alias("until"))
    return summed.join(last, "stop").select("entry_id", (F.col("until") - F.col("running") + F.col("own")).alias("total"))
