import lzma

from pyspark.sql import functions as F

from threadstats import schemas
from threadstats.functions import columns as C
from threadstats.operators import entries as E
from threadstats.operators import periods as P
from threadstats.plans.datasets import base_entries
from threadstats.sources import dumps as I
from threadstats.storage import materialize
from threadstats.streaming import ingest as R

SUBMISSIONS = [
    ("s1", "Title", "u", "ann", "3", "3/4/2016 9:05", "7", "p", "NaN", 'body, with "quotes"\nand lines'),
    ("s2", "Bare", "u", "bob", "1", "11/16/2015 00:00", "0", "p", "f", "NaN"),
    ("s3", "No author", "u", "NaN", "1", "3/4/2016 9:05", "0", "p", "f", "x"),
    ("s4", "No date", "u", "cat", "1", "soon", "0", "p", "f", "x"),
]
COMMENTS = [
    ("c1", "bob", "a &gt; q1\nmid\nb &gt; tail", "1", "3/5/2016 10:00", "p", "t3_s1", "t1_gone"),
    ("c2", "[deleted]", "plain", "1", "4/6/2019 00:00", "p", "t3_s1", "t3_s1"),
    ("c3", "dan", "NA", "1", "3/5/2016 10:00", "p", "t3_s1", "t3_s1"),
]


def frames(spark):
    return (
        spark.createDataFrame(SUBMISSIONS, schemas.SUBMISSIONS_CSV),
        spark.createDataFrame(COMMENTS, schemas.COMMENTS_CSV),
    )


def test_csv_round_trip_keeps_quotes_and_lines(spark, tmp_path):
    submissions, comments = frames(spark)
    I.write_csv(submissions, str(tmp_path / "s"))
    I.write_csv(comments, str(tmp_path / "c"))
    got = {r.submission_id: r for r in I.read_submissions(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {"s1", "s2"}
    assert got["s1"].content == 'Title body, with "quotes"\nand lines'
    assert got["s2"].content == "Bare  "
    assert str(got["s1"].ts) == "2016-03-04 09:05:00"
    read = {r.comment_id: r for r in I.read_comments(spark, str(tmp_path / "c")).collect()}
    assert set(read) == {"c1", "c2"}
    assert (read["c1"].submission_id, read["c1"].parent_id) == ("s1", "gone")


def test_xz_files_land_as_the_same_rows(spark, tmp_path):
    submissions, _ = frames(spark)
    text = submissions.toPandas().to_csv(index=False)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dump.csv.xz").write_bytes(lzma.compress(text.encode()))
    landed = I.land_xz(spark, str(tmp_path / "in"), schemas.SUBMISSIONS_CSV)
    assert sorted(landed.collect()) == sorted(submissions.collect())


def test_base_entries_cut_periods_and_quotes(spark):
    submissions, comments = frames(spark)
    base = base_entries(E.clean_submissions(submissions), E.clean_comments(comments))
    got = {r.entry_id: (r.period, r.content) for r in base.collect()}
    # 2015-11-16 is the first day of period 1; 2019-04-06 is outside
    assert set(got) == {"s1", "s2", "c1"}
    assert got["s2"][0] == 1
    assert got["c1"] == (1, "a midb &gt; tail")
    again = base.select("entry_id", C.strip_quotes(F.col("content")).alias("content"))
    assert {r.entry_id: r.content for r in again.collect()} == {k: v[1] for k, v in got.items()}
    without = base_entries(E.clean_submissions(submissions), E.clean_comments(comments), cuts=None, drop_authors=["[deleted]"])
    assert {r.entry_id for r in without.collect()} == {"s1", "s2", "c1"}


def test_period_cuts(spark):
    days = ["2016-05-02", "2016-05-03", "2016-06-20", "2016-06-29", "2016-06-30"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("date"))
    cut = P.assign_period(df, 3).withColumn("label", P.period_label(F.col("period"), 3))
    assert [(str(r.date), r.period, r.label) for r in cut.orderBy("date").collect()] == [
        ("2016-05-03", 1, "T4"), ("2016-06-20", 2, "T5"), ("2016-06-29", 3, "T6")]
    equal = P.assign_equal_periods(df, 2)
    assert [r.period for r in equal.orderBy("date").collect()] == [1, 1, 2, 2, 2]
    same = P.assign_equal_periods(df.filter("date = '2016-05-03'"), 5)
    assert [r.period for r in same.collect()] == [3]
    assert {n: len(c) - 1 for n, c in P.PERIOD_CUTS.items()} == {3: 3, 7: 7, 15: 15, 16: 16}


def test_latest_record_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "id string, at int, v string")
    assert sorted(map(tuple, E.latest_by_id(df, ["id"], ["at"]).collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_json_records_get_nan_for_absent_fields(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"id":"x","title":"t","url":"u","author":"a","score":1,"created_utc":1520561700,"num_comments":2,"permalink":"p"}\n')
    row = I.read_json_submissions(spark, str(tmp_path)).first()
    assert (row["Flair"], row["Selftext"], str(row["Publish Date"])) == ("NaN", "NaN", "2018-03-09 02:15:00")


def test_feature_tables_and_materialize(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "period int, w1 double")
    I.write_features(df, str(tmp_path / "p"), partition_by=["period"])
    I.write_features(df, str(tmp_path / "c"), csv=True)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("period", "w1").collect())) == [(1, 0.5), (2, 1.5)]
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    calls = []

    def build():
        calls.append(1)
        return df

    for _ in range(2):
        assert materialize(spark, str(tmp_path / "m"), build).count() == 2
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(f"r{i % 6}", i, 1_500_000_000 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, v int, created_utc long").withColumn("ts", F.timestamp_seconds("created_utc"))
    df.repartition(3).write.json(str(folder))
    stream = R.read_stream(spark, str(folder), df.schema)
    first = R.run_now(spark, R.first_of_each(stream, ["id"], "ts", "1 hour"), R.append_to, "first")
    assert sorted(r.id for r in first.collect()) == [f"r{i}" for i in range(6)]
    target = str(tmp_path / "latest")
    one_file = R.read_stream(spark, str(folder), df.schema, maxFilesPerTrigger=1)
    R.keep_latest(one_file, ["id"], ["created_utc"], target, str(tmp_path / "ck")).awaitTermination()
    latest = R.latest_records(spark, target, ["id"], ["created_utc"])
    batch = E.latest_by_id(df, ["id"], ["created_utc"])
    key = lambda d: sorted(map(tuple, d.select("id", "v").collect()))
    assert key(latest) == key(batch) == [(f"r{i}", i + 6) for i in range(6)]
