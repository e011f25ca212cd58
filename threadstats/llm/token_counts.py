"""Token counts through a cache of digests.

A text's digest and the tokenizer's digest name its count.  Digests are joined
to the counts stored so far; of those that are missing, one text each is encoded,
and the new counts are appended to the cache, which later calls find.

For tokenizers that drop white space the content is normalised first: runs of
ASCII white space are one space, none at the ends; it changes no count.  Null
texts are empty and have no tokens.  Rows without an id and repeated rows are
counted like any other.  Extra columns are ignored; an empty table gives an
empty result.  Copies share one digest, and only the narrow join of digests
meets them; texts are shuffled by their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstats.llm import tokens
from threadstats.llm.shared import chunks
from threadstats.storage import scope, written

CACHE = "tokenizer string, digest binary, n_tokens bigint"


def content_digest(text: Column, normalised: bool) -> Column:
    """SHA-256 of the content."""
    plain = F.trim(F.regexp_replace(text, "[\\t-\\r ]+", " ")) if normalised else text
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The counts of one tokenizer version; none if the cache is not there yet."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    # Two calls at a time may both have stored a digest: the count is the same.
    return found.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``cache`` is a folder that all executors reach."""
    spark, tokenizer, normalised = docs.sparkSession, tokens.version(path), tokens.by_word(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = tokens.encoder(path).counts(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("digest"), pa.array(found)], ["digest", "n_tokens"])

    with scope(spark) as keep:
        text = F.coalesce(F.col("text"), F.lit(""))
        source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
        named = source.withColumn("digest", content_digest(F.col("text"), normalised))
        rows = written(named.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
        known = written(stored(spark, cache, tokenizer), "known")
        missing = written(
            rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
            .join(known.hint("merge"), "digest", "left_anti"), "missing")
        # By id, not by digest: one row each, however many copies a text has.
        chosen = named.withColumnRenamed("digest", "own").join(
            missing.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("own") == F.col("digest")))
        counted = written(chosen.select(F.col("text").cast("binary").alias("text"), "digest").mapInArrow(
            encode, "digest binary, n_tokens bigint").dropDuplicates(["digest"]), "counted")
        counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
        counts = written(known.union(counted), "counts")
        return keep(rows.join(counts.hint("merge"), "digest").select(
            "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token_counts")
