"""What the physical plans must look like, whatever the size of the tables."""

import re

import pytest

from pyspark.sql import functions as F

from threadstats.operators import descriptors as D
from threadstats.operators import entries as E
from threadstats.operators import forest as G
from threadstats.operators import stance as S
from threadstats.operators import terms as W
from threadstats.plans import datasets as Z
from threadstats.storage import broadcast_up_to, written

SCHEMA = "entry_id string, parent_id string, submission_id string, comment_id string, author string, period int, stance int"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("s", None, "s", None, "a", 1, 0), ("c", "s", "s", "c", "b", 1, 1), ("d", "c", "s", "d", "a", 2, 0)]
    return written(spark.createDataFrame(rows, SCHEMA), "plan-entries")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan, *columns):
    pattern = r"Exchange hashpartitioning\(" + ", ".join(rf"{c}#\d+L?" for c in columns) + r", \d+\)"
    return re.findall(pattern, plan)


def test_descriptors_shuffle_once_per_side_on_author_and_period(entries):
    f1 = plan_of(D.f1_descriptors(entries))
    assert len(exchanges(f1, "author", "period")) == 1
    f2 = plan_of(D.f2_descriptors(entries))
    # the received and the given side, then joined in place
    assert len(exchanges(f2, "author", "period")) == 2


def test_training_sets_have_no_cartesian_product(entries):
    for df in (Z.f1_training(entries), Z.f2_training(entries), Z.f3_training(entries), Z.f3_training(entries, True)):
        plan = plan_of(df)
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scans_read_only_what_is_needed(entries):
    plan = plan_of(D.thread_mix(entries))
    assert re.search(r"ReadSchema: struct<submission_id:string,stance:int>", plan)
    assert "PushedFilters: [IsNotNull(period), EqualTo(period,1)]" in plan_of(entries.filter("period = 1").select("author"))


def test_broadcast_only_below_the_bound(spark):
    small = written(spark.range(10).withColumnRenamed("id", "k"), "small")
    big = spark.range(1000).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(big.join(broadcast_up_to(small, 10), "k"))
        assert "SortMergeJoin" in plan_of(big.join(broadcast_up_to(small, 9), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_results_do_not_depend_on_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a", "ships sail ships"), (1, "b", "cats purr purring")], "label int, author string, content string")
    model, prior = S.train(docs)
    model = written(model, "model")

    def scores():
        return sorted(map(tuple, S.score(docs, model, prior, ["author"], min_total=1).collect()))

    broadcast = scores()
    monkeypatch.setattr(W, "STEM_MAP_BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "STEM_MAP_BROADCAST_ROWS", 0)
    assert [a for a, _ in scores()] == [a for a, _ in broadcast]
    assert [p for _, p in scores()] == pytest.approx([p for _, p in broadcast])


def test_stop_words_need_no_join(spark):
    terms = spark.createDataFrame([("the",), ("ship",)], "term string")
    kept = W.remove_stop_words(terms, ["the"])
    assert "Join" not in plan_of(kept) and [r.term for r in kept.collect()] == ["ship"]


@pytest.fixture
def without_broadcast(spark, monkeypatch):
    """Large tables in small: nothing is broadcast, and a partition above a few kilobytes is large."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    monkeypatch.setattr("threadstats.storage.broadcast_up_to", lambda table, rows: table)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, without_broadcast):
    n = 60_000
    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    rows = written(spark.range(n).repartition(8).select(
        F.col("id").cast("string").alias("entry_id"), hot.alias("author"), hot.alias("parent_id"), hot.alias("term"),
        F.lit("s").alias("submission_id"), F.lit(1).alias("period"), (F.col("id") % 50).alias("doc"), F.lit(1).cast("bigint").alias("n")), "hot")
    stance = rows.groupBy("author", "period").agg(F.max("n").alias("stance"))
    assert _split(E.attach_stance(rows, stance))
    assert _split(E.attach_author_class(rows, rows.groupBy("author").agg(F.lit(0.5).alias("leave_probability"))))
    assert _split(G.repair_orphans(rows))
    one = rows.withColumn("doc", F.col("entry_id"))  # a row per document and term
    assert _split(W.remove_sparse_terms(one, one, ["doc"], 0.9999))
    assert _split(W.tf_idf(one, one, ["doc"]))
