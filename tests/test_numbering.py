"""Positions in a global order."""

from pyspark.sql import functions as F

from threadstats.operators.numbering import numbered


def test_positions_have_no_gaps_and_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("other"))
    got = numbered(rows.repartition(7), ["k"]).collect()
    assert [r["position"] for r in sorted(got, key=lambda r: r["k"])] == list(range(5000))
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_nulls_can_come_last(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",), ("é",)], "s string")
    got = numbered(rows, [F.col("s").asc_nulls_last()], "n").collect()
    assert {r["s"]: r["n"] for r in got} == {"a": 0, "b": 1, "é": 2, None: 3}


def test_no_task_holds_all_rows(spark):
    plan = numbered(spark.range(100), ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
