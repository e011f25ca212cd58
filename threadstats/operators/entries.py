"""From the two dumps to one table of entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.functions import columns as C
from threadstats.storage import small_side


def _text(name: str) -> Column:
    """A text field as the files mean it: empty is empty, NA is missing."""
    return F.nullif(F.coalesce(F.col(name), F.lit("")), F.lit(C.NA_TEXT))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL in the given (default: all) columns."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def clean_submissions(raw: DataFrame, formats: Sequence[str] = C.DATE_FORMATS) -> DataFrame:
    """Submissions with one content column; incomplete rows are dropped."""
    selftext = C.sentinel_to_null(_text("Selftext"))
    title = F.coalesce(F.col("Title"), F.lit(""))
    return complete_cases(raw.select(
        _text("Post ID").alias("submission_id"),
        C.sentinel_to_null(_text("Author")).alias("author"),
        F.col("Score").try_cast("int").alias("score"),
        C.parse_timestamp(F.col("Publish Date"), formats).alias("ts"),
        F.col("`Total No. of Comments`").try_cast("int").alias("n_comments"),
        C.submission_content(title, selftext).alias("content"),
    ))


def clean_comments(raw: DataFrame, formats: Sequence[str] = C.DATE_FORMATS) -> DataFrame:
    """Comments with bare ids; incomplete rows are dropped."""
    return complete_cases(raw.select(
        _text("Comment ID").alias("comment_id"),
        _text("Author").alias("author"),
        _text("Body").alias("content"),
        F.col("Score").try_cast("int").alias("score"),
        C.parse_timestamp(F.col("Publish Date"), formats).alias("ts"),
        C.strip_type_prefix(_text("Submission ID")).alias("submission_id"),
        C.strip_type_prefix(_text("Parent ID")).alias("parent_id"),
    ))


def union_entries(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """All entries under one set of columns, with their date and entry id."""
    both = comments.unionByName(submissions, allowMissingColumns=True)
    return both.withColumn("date", F.to_date("ts")).withColumn(
        "entry_id", C.entry_id(F.col("comment_id"), F.col("submission_id"))
    )


def by_date(entries: DataFrame) -> DataFrame:
    """Entries in date order, comments before submissions within a day."""
    return entries.orderBy("date", F.col("comment_id").isNull(), "entry_id")


def pooled_text_size(entries: DataFrame) -> DataFrame:
    """Posts per author and the length of their texts joined by blanks.

    The joined text itself is never built: its only use is to count words,
    and those are counted post by post and summed.
    """
    return entries.groupBy("author").agg(
        F.count(F.lit(1)).alias("n_posts"),
        (F.sum(F.length("content")) + F.count(F.lit(1)) - 1).alias("pooled_length"),
    )


def attach_stance(entries: DataFrame, stance: DataFrame) -> DataFrame:
    """Give every entry its author's stance in the entry's period."""
    return entries.join(small_side(stance, "stances"), ["author", "period"])


def attach_author_class(posts: DataFrame, author_probability: DataFrame) -> DataFrame:
    """Give every post the class of its author; the probability is dropped."""
    classes = author_probability.select(
        "author", C.stance_code(F.col("leave_probability")).alias("prediction")
    )
    return posts.join(small_side(classes, "author-classes"), "author")


def latest_by_id(records: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per id: the last in the given order wins.

    An aggregate rather than a window: each task keeps one record per id
    before the shuffle, so an id with very many copies is no hot spot.
    """
    rest = [c for c in records.columns if c not in ids]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return records.groupBy(*ids).agg(last).select(*ids, "last.*").select(*records.columns)


def incremental_slice(
    records: DataFrame, after: Column, before: Column, created: str = "ts"
) -> DataFrame:
    """Records created strictly between the two marks."""
    return records.filter((F.col(created) > after) & (F.col(created) < before))


def high_water_mark(records: DataFrame, created: str = "ts") -> DataFrame:
    """The mark after which the next slice begins."""
    return records.agg(F.max(created).alias("high_water_mark"))


def log_histogram(df: DataFrame, value: str, n: int) -> DataFrame:
    """Counts in n bins of equal width in the logarithm of a positive value."""
    logs = df.select(F.log(value).alias("x"))
    span = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = span.select("lo").scalar()
    width = span.select(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("w")).scalar()
    position = F.floor(F.coalesce((F.col("x") - low) / width, F.lit(0.0)) * n)
    bins = logs.select((F.least(position, F.lit(n - 1)) + 1).cast("int").alias("bin"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
