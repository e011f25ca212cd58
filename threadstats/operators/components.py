"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.storage import Rounds

# Every round at least halves the labels that still touch others.
MAX_ROUNDS = 60


def lowest_labels(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Label every node with the smallest node it is connected with: (by..., node, label).

    ``nodes`` has (by..., node), ``edges`` (by..., a, b) without direction; groups
    named by the ``by`` columns have components of their own.  In a round every end
    of an edge offers its label to the other end and to that end's label, and then
    labels are followed once.  Rounds are written tables.
    """
    spark, by = nodes.sparkSession, list(by)
    hooks, lows, rounds = (Rounds(spark, f"component-{name}") for name in ("hooks", "lows", "labels"))
    labels = rounds.write(nodes.select(*by, "node", F.col("node").alias("label")))
    edges = edges.select(*by, "a", "b")
    for _ in range(MAX_ROUNDS):
        def labelled(end: str) -> DataFrame:
            return labels.select(*by, F.col("node").alias(end), F.col("label").alias(f"label_{end}"))

        met = edges.join(labelled("a"), [*by, "a"]).join(labelled("b"), [*by, "b"])
        apart = hooks.write(met.filter(F.col("label_a") != F.col("label_b")).select(
            *by, F.greatest("label_a", "label_b").alias("node"), F.least("label_a", "label_b").alias("label")).distinct())
        if apart.isEmpty():
            return labels
        # Only labels are offered something smaller: they are roots, and all that hangs on them follows.
        lowest = lows.write(labels.union(apart).groupBy(*by, "node").agg(F.min("label").alias("label")))
        via = lowest.select(*by, F.col("node").alias("label"), F.col("label").alias("lower"))
        labels = rounds.write(lowest.join(via, [*by, "label"]).select(*by, "node", F.col("lower").alias("label")))
    raise ValueError(f"components not settled after {MAX_ROUNDS} rounds")
