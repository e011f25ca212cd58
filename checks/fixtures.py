"""Forum tables derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstats.functions.columns import stance_code
from threadstats.operators.forest import repair_orphans

# Two-day periods over the month that the events cover.
CUTS = [f"2024-01-{day:02d}" for day in range(1, 32, 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out evenly if the file has fewer splits than cores.

    Text work is bound by the processor, and one row group is one task.  A
    table with enough splits is read in place, without a shuffle.
    """
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def forest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the id of the event they answer (negative: an orphan)."""
    events = table(spark, sf_dir, "events")
    nt = events.agg(F.greatest((F.count(F.lit(1)) / 50).cast("bigint"), F.lit(1).cast("bigint"))).scalar()
    placed = events.withColumn("nt", nt).withColumn("sub", F.col("event_id") % F.col("nt")).withColumn(
        "pos", F.floor(F.col("event_id") / F.col("nt"))
    )
    back = 1 + (F.col("event_id") + 3 * F.col("user_id")) % F.greatest(F.least("pos", F.lit(4)), F.lit(1))
    answered = (
        F.when(F.col("pos") == 0, None)
        .when(F.col("event_id") % 97 == 5, -F.col("event_id"))
        .otherwise(F.col("event_id") - F.col("nt") * back)
    )
    return placed.withColumn("answers", answered).drop("nt")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with unrepaired parents and a probability, without stance."""
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    period = F.floor((F.day("ts") - 1) / 2) + 1
    return forest_events(spark, sf_dir).select(
        F.col("answers").cast("string").alias("parent_id"),
        F.col("event_id").cast("string").alias("entry_id"),
        F.col("sub").cast("string").alias("submission_id"),
        F.when(F.col("pos") > 0, F.col("event_id").cast("string")).alias("comment_id"),
        F.col("user_id").cast("string").alias("author"),
        F.to_date("ts").alias("date"),
        period.cast("int").alias("period"),
        (F.col("event_id") % n_docs).alias("doc_id"),
        (((F.col("user_id") * 7 + period * 13) % 101).cast("double") / 100).alias("leave_probability"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries fixture: repaired parents and a stance per entry."""
    return repair_orphans(raw_entries(spark, sf_dir)).withColumn(
        "stance", stance_code(F.col("leave_probability"))
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: author = source, content = the whole text."""
    return documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("author"), F.col("text").alias("content")
    )


def raw_dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Submissions and comments as the dump files hold them (all text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    posts = forest_events(spark, sf_dir).withColumn("doc_id", F.col("event_id") % n_docs).join(docs, "doc_id")
    event, sub = F.col("event_id").cast("string"), F.col("sub").cast("string")
    score = F.floor("value").cast("string")
    published = F.date_format("ts", "M/d/yyyy H:mm")
    submissions = posts.filter("pos = 0").select(
        event.alias("Post ID"),
        F.concat(F.lit("Thread "), sub).alias("Title"),
        F.concat(F.lit("https://example.org/"), sub).alias("Url"),
        F.when(F.col("user_id") % 37 == 3, F.lit("NaN")).otherwise(F.col("user_id").cast("string")).alias("Author"),
        score.alias("Score"),
        published.alias("Publish Date"),
        (F.col("user_id") % 50).cast("string").alias("Total No. of Comments"),
        F.concat(F.lit("/r/"), sub).alias("Permalink"),
        F.lit("NaN").alias("Flair"),
        F.when(F.col("event_id") % 4 == 1, F.lit("NaN")).otherwise(F.col("text")).alias("Selftext"),
    )
    quoted = F.concat(F.lit("&gt; quoted words\n"), F.col("text"))
    answers = F.col("answers").cast("string")
    comments = posts.filter("pos > 0").select(
        event.alias("Comment ID"),
        F.col("user_id").cast("string").alias("Author"),
        F.when(F.col("event_id") % 5 == 0, quoted).otherwise(F.col("text")).alias("Body"),
        score.alias("Score"),
        F.when(F.col("event_id") % 211 == 7, F.lit("unknown")).otherwise(published).alias("Publish Date"),
        F.lit("NaN").alias("Permalink"),
        F.concat(F.lit("t3_"), sub).alias("Submission ID"),
        F.concat(F.when(answers == sub, F.lit("t3_")).otherwise(F.lit("t1_")), answers).alias("Parent ID"),
    )
    return submissions, comments


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class, to train the stance model on."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")).join(labels, "doc_id")
