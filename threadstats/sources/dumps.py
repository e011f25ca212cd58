"""Reading and writing the dump files."""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadstats import schemas
from threadstats.functions.columns import DATE_FORMATS, MISSING_TEXT
from threadstats.operators.entries import clean_comments, clean_submissions

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
XZ_ROWS = 20_000


def read_submissions(spark: SparkSession, path: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    raw = spark.read.schema(schemas.SUBMISSIONS_CSV).options(**CSV_OPTIONS).csv(path)
    return clean_submissions(raw, formats)


def read_comments(spark: SparkSession, path: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    raw = spark.read.schema(schemas.COMMENTS_CSV).options(**CSV_OPTIONS).csv(path)
    return clean_comments(raw, formats)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """CSV that the readers above give back unchanged; files with line breaks in fields can't be split, packed or not."""
    df.write.mode(mode).option("emptyValue", "").options(
        header=True, escape='"', encoding="UTF-8", compression=compression).csv(path)


def write_features(df: DataFrame, path: str, csv: bool = False, partition_by: Sequence[str] = ()) -> None:
    """A feature table as Parquet, or as CSV with a header."""
    if csv:
        write_csv(df, path, mode="overwrite")
    else:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def land_xz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``.csv.xz`` files as text columns.

    Spark has no xz codec and the format cannot be split, so each file is
    unpacked as a stream within one task.  Meant to be run once: write the
    result as Parquet and clean it from there.
    """
    names = schema.fieldNames()
    # Arrow batches travel under plain names; headers may hold dots and blanks.
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with lzma.open(io.BytesIO(content)) as unpacked:
                    for chunk in pd.read_csv(
                        unpacked, dtype=str, keep_default_na=False, chunksize=XZ_ROWS, usecols=names
                    ):
                        yield chunk[names].set_axis(plain.fieldNames(), axis=1)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, plain).toDF(*names)


def from_json(records: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return records.select(F.from_json(column, schema).alias("r")).select("r.*")


def _or_missing(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(MISSING_TEXT))


def submission_records(objects: DataFrame) -> DataFrame:
    """JSON objects of submissions as rows of the dump; absent text is "NaN"."""
    return objects.select(
        F.col("id").alias("Post ID"), F.col("title").alias("Title"), F.col("url").alias("Url"),
        F.col("author").alias("Author"), F.col("score").alias("Score"),
        F.timestamp_seconds("created_utc").alias("Publish Date"),
        F.col("num_comments").alias("Total No. of Comments"), F.col("permalink").alias("Permalink"),
        _or_missing("link_flair_text").alias("Flair"), _or_missing("selftext").alias("Selftext"),
    )


def comment_records(objects: DataFrame) -> DataFrame:
    """JSON objects of comments as rows of the dump; an absent link is "NaN"."""
    return objects.select(
        F.col("id").alias("Comment ID"), F.col("author").alias("Author"), F.col("body").alias("Body"),
        F.col("score").alias("Score"), F.timestamp_seconds("created_utc").alias("Publish Date"),
        _or_missing("permalink").alias("Permalink"), F.col("link_id").alias("Submission ID"),
        F.col("parent_id").alias("Parent ID"),
    )


def read_json_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Dumped submissions, one JSON object per line."""
    return submission_records(spark.read.schema(schemas.SUBMISSION_JSON).json(path))


def read_json_comments(spark: SparkSession, path: str) -> DataFrame:
    """Dumped comments, one JSON object per line."""
    return comment_records(spark.read.schema(schemas.COMMENT_JSON).json(path))
