"""Connected components of a large graph by alternating large and small stars.

Every round is a written table: nothing is collected, and lost executors cost
only the running stage.  Minima of written tables are joined back, so that both
sides of each join are plain exchanges and adaptive execution can split a hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.storage import written


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges that each task holds by a forest of the same components."""

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 200_000:  # hand on what is known; the next batches start anew
                yield _star(parent, root)
                parent.clear()
        yield _star(parent, root)

    return edges.select("a", "b").mapInPandas(forest, "a bigint, b bigint")


def _star(parent: dict[int, int], root) -> pd.DataFrame:
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [(x, y) for x, y in pairs if x != y]
    return pd.DataFrame({"a": pd.Series([x for x, _ in pairs], dtype="int64"),
                         "b": pd.Series([y for _, y in pairs], dtype="int64")})


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of the edges (a, b): label is the smallest node reachable.

    Edges may repeat and point either way; null ends and loops are left out.
    An empty table of edges gives an empty result.
    """
    real = edges.filter("a is not null and b is not null and a <> b")
    found = written(contract(real).distinct(), "edges")
    before = _state(found)
    while before[0]:
        both = written(found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        star = large.join(least, "a")
        small = star.select("a", F.col("m").alias("b")).union(
            star.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        found = written(small.distinct(), "edges")
        after = _state(found)
        if after == before:
            break
        before = after
    return found.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
