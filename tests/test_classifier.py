"""The split by author, and streams that keep the latest record as state."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures, queries
from threadstats.operators import classifier as B
from threadstats.operators import descriptors, forest
from threadstats.streaming import ingest as R


@pytest.fixture(scope="module")
def described(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("a"), (F.col("id") % 300).cast("string")).alias("author"), (F.floor(F.col("id") / 300) + 1).cast("int").alias("period"),
        (F.col("id") * 7919 % 17).alias("x"), (F.col("id") * 104729 % 13).alias("y"))
    # The next label follows from this period's x.
    return rows.withColumn("current_label", F.lit(0)).withColumn("x", F.col("x").cast("double"))


def test_no_author_on_both_sides(described):
    training, test = B.split_by_author(described)
    a, b = ({r[0] for r in side.select("author").distinct().collect()} for side in (training, test))
    assert a and b and not a & b and len(a | b) == 300


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_a_rule_is_learnt(described, kind):
    labelled = described.withColumn("next_label", (F.col("x") > 8).cast("int"))
    training, test = B.split_by_author(labelled)
    model = B.fit(training, ["x", "y", "current_label"], kind)
    counts = {(r["label"], r["prediction"]): r["n"] for r in B.confusion(model, test).collect()}
    right = sum(n for (l, p), n in counts.items() if l == p)
    assert right / sum(counts.values()) > 0.9


def test_measures(spark, described):
    labelled = described.withColumn("current_label", (F.col("period") % 2).cast("int"))
    row = B.evaluate(labelled, "made up").first()
    assert row["n_train"] + row["n_test"] == 2700 and row["accuracy"] > 0.99 and 0.4 < row["commonest_share"] < 0.6
    with pytest.raises(ValueError):
        B.evaluate(described.limit(0), "none")


def test_state_survives_a_restart(spark, tmp_path):
    schema = "id string, ts timestamp, n bigint, text string"
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def arrive(rows):
        data = [(i, t, n, x) for i, t, n, x in rows]
        spark.createDataFrame(data, "id string, t string, n bigint, text string").select(
            "id", F.col("t").cast("timestamp").alias("ts"), "n", "text").coalesce(1).write.mode("append").parquet(folder)
        stream = R.read_stream(spark, folder, spark.createDataFrame([], schema).schema, "parquet")
        with R.rocksdb_state(spark):
            R.append_changes(R.latest_changes(stream, ["id"], "ts", "n", "2 days"), target, checkpoint).awaitTermination()
        return sorted((r["id"], r["text"]) for r in R.latest_records(spark, target, ["id"], ["ts", "n"]).collect())

    assert arrive([("a", "2024-01-01 10:00:00", 1, "first"), ("a", "2024-01-01 12:00:00", 2, "second"),
                   ("b", "2024-01-01 09:00:00", 3, "only")]) == [("a", "second"), ("b", "only")]
    before = spark.read.parquet(target).count()
    # Older than what is known: no change comes out.  Equal times: the greater n wins.
    assert arrive([("a", "2024-01-01 11:00:00", 9, "late"), ("b", "2024-01-01 09:00:00", 4, "tie")]) == [("a", "second"), ("b", "tie")]
    assert spark.read.parquet(target).count() == before + 1
    assert arrive([("a", "2024-01-09 10:00:00", 5, "new"), ("c", "2024-01-09 10:00:00", 6, "c")]) == [("a", "new"), ("b", "tie"), ("c", "c")]


def test_descriptor_sets_share_one_count_of_replies(spark, tmp_path, monkeypatch):
    spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 28 as int))").alias("ts"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(50).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    alone = {n: f(fixtures.entries(spark, str(tmp_path))) for n, f in (("f1", descriptors.f1_descriptors), ("f2", descriptors.f2_descriptors))}
    wanted = {n: sorted(map(tuple, df.collect())) for n, df in alone.items()}
    times, totals = [], forest.subtree_totals
    monkeypatch.setattr(forest, "subtree_totals", lambda *args, **more: (times.append(1), totals(*args, **more))[1])
    described = queries._described(spark, str(tmp_path))
    assert {n: sorted(map(tuple, described[n].collect())) for n in wanted} == wanted
    assert len(times) == 1
