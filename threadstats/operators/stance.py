"""The stance model: multinomial Naive Bayes held as tables.

``model(term, logp_remain, logp_leave)`` and ``prior(class, logp)``, where
class 0 is "remain" and class 1 "leave".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstats.functions import columns as C
from threadstats.functions.cutting import different, letters, model_words
from threadstats.functions.text import is_model_token, model_text
from threadstats.operators.terms import STEM_MAP_BROADCAST_ROWS, group_counts, model_vocabulary, through
from threadstats.storage import mark_complete, small_side, written

REMAIN, LEAVE = 0, 1
#: Words that every task may hold to score texts where they are read, and batches told apart by a bit each.
MAX_HELD_WORDS, MAX_HELD_BATCHES = 8_000_000, 63


def train(
    docs: DataFrame,
    label: str = "label",
    content: str = "content",
    prior: str = "uniform",
    stem: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Term likelihoods with add-one smoothing, and the class prior.

    ``prior`` is "uniform" or "docfreq" (share of the documents).
    """
    words = written(_words(docs, [label], content).withColumnRenamed("word", "term"), "class-words")
    counts = through(words, model_vocabulary(words.filter(is_model_token(F.col("term"))), stem))
    sums = counts.groupBy("term").agg(
        F.sum(F.when(F.col(label) == REMAIN, F.col("n")).otherwise(0)).alias("remain"),
        F.sum(F.when(F.col(label) == LEAVE, F.col("n")).otherwise(0)).alias("leave"),
    )
    whole = sums.agg(
        F.sum("remain").alias("remain"), F.sum("leave").alias("leave"), F.count(F.lit(1)).alias("v")
    )

    def likelihood(name: str):
        total = whole.select((F.col(name) + F.col("v")).alias("t")).scalar()
        return F.log((F.col(name) + 1) / total).alias(f"logp_{name}")

    model = sums.select("term", likelihood("remain"), likelihood("leave"))
    classes = docs.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if prior == "uniform":
        share = F.lit(1.0) / classes.agg(F.count(F.lit(1)).alias("k")).scalar()
    elif prior == "docfreq":
        share = F.col("n") / classes.agg(F.sum("n").alias("n")).scalar()
    else:
        raise ValueError(f"unknown prior {prior!r}")
    return model, classes.select("class", F.log(share).alias("logp"))


def save(model: DataFrame, prior: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(f"{path}/model")
    prior.coalesce(1).write.mode("overwrite").parquet(f"{path}/prior")
    mark_complete(model.sparkSession, f"{path}/prior")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/model"), spark.read.parquet(f"{path}/prior")


def score(
    docs: DataFrame,
    model: DataFrame,
    prior: DataFrame,
    keys: Sequence[str],
    batch: Sequence[str] = (),
    content: str = "content",
    min_total: int = 3,
    stem: bool = True,
) -> DataFrame:
    """``leave_probability`` per document key.

    Texts with the same keys are pooled by adding their term counts.  Terms
    rarer than ``min_total`` within the batch are left out, as are terms that
    the model does not know; a document without any known term gets the prior.
    ``min_total=1`` scores with the fixed vocabulary, independent of the batch.
    """
    keys, batch = list(keys), list(batch)
    # The texts are read twice, for the totals and for the sums, so that their words are never written.
    totals = written(_words(docs, batch, content), "batch-words")
    # Everything about words is decided per batch and word.
    words = totals.filter(is_model_token(F.col("word")))
    vocabulary = model_vocabulary(words.withColumnRenamed("word", "term"), stem).join(model, "term").select(
        "word", "term", (F.col("logp_remain") - F.col("logp_leave")).alias("odds"))
    known = words.join(small_side(vocabulary, "vocabulary", STEM_MAP_BROADCAST_ROWS), "word")
    if min_total > 1:
        known = written(known, "known-words")
        frequent = known.groupBy(*batch, "term").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_total)
        known = known.join(small_side(frequent.drop("total"), "frequent-terms"), [*batch, "term"], "left_semi")
    kept = written(known.select(*batch, "word", "odds"), "scoring-words")
    odds = _summed_odds(docs, kept, keys, batch, content).groupBy(*keys).agg(F.sum("odds").alias("log_odds"))
    for key in keys:  # a document without a full name gets the prior
        odds = odds.withColumn("log_odds", F.when(F.col(key).isNotNull(), F.col("log_odds")))

    def prior_of(code: int):
        return F.coalesce(prior.filter(F.col("class") == code).select("logp").scalar(), F.lit(0.0))

    total = F.coalesce("log_odds", F.lit(0.0)) + (prior_of(REMAIN) - prior_of(LEAVE))
    # exp stays finite: beyond 700 the probability is 0 or 1 to the last digit.
    bounded = F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))
    return odds.select(*keys, (F.lit(1.0) / (F.exp(bounded) + 1)).alias("leave_probability"))


def _words(docs: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys..., word, n): how often the model's words, not yet stemmed, occur in a few large groups of texts."""
    return group_counts(docs, keys, model_text(F.col(content)), partial(model_words, letter=letters()))


def _summed_odds(docs: DataFrame, kept: DataFrame, keys: Sequence[str], batch: Sequence[str], content: str) -> DataFrame:
    """(keys..., odds): for every text the summed odds of the words ``kept`` (batch..., word, odds) in its batch.

    Tasks hold the kept words with one bit per batch and add up where a text is read.  If the words or
    batches are too many for that, words of texts are counted and joined.
    """
    batches = kept.select(*batch).distinct().limit(MAX_HELD_BATCHES + 1).collect() if batch else [()]
    if len(batches) <= MAX_HELD_BATCHES:
        numbers = docs.sparkSession.createDataFrame(
            [(*b, i, 1 << i) for i, b in enumerate(batches)],
            ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in batch), "__batch int, __bit bigint"]))
        numbers = F.broadcast(numbers)
        placed = kept.join(numbers, list(batch)) if batch else kept.crossJoin(numbers)
        held = written(placed.groupBy("word").agg(F.first("odds").alias("odds"), F.bit_or("__bit").alias("batches")), "held-words")
        if held.count() <= MAX_HELD_WORDS:
            rows = docs.join(numbers, list(batch), "left") if batch else docs.crossJoin(numbers)
            return _odds_by_row(rows, held.toArrow(), keys, content)
    counts = group_counts(docs, [*dict.fromkeys([*keys, *batch])], model_text(F.col(content)), partial(model_words, letter=letters()))
    counts = written(counts, "word-counts")
    sums = counts.join(kept, [*batch, "word"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("odds")).alias("odds"))
    return docs.select(*keys).distinct().withColumn("odds", F.lit(None).cast("double")).unionByName(sums)


def _odds_by_row(rows: DataFrame, held: pa.Table, keys: Sequence[str], content: str) -> DataFrame:
    held = held.combine_chunks()
    shared, letter = rows.sparkSession.sparkContext.broadcast(held), letters()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.column("word")
        odds, inside = (shared.value.column(c).to_numpy() for c in ("odds", "batches"))
        for batch in batches:
            tokens, n = model_words(batch.column("__text"), letter)
            names, code = different(tokens)
            at = pc.index_in(words, value_set=names)  # the few are indexed, the many looked up
            found = np.flatnonzero(at.is_valid().to_numpy())
            place = np.full(len(names), -1)
            place[at.drop_null().to_numpy()] = found
            place, own = place[code], np.repeat(np.arange(batch.num_rows), n)
            number = batch.column("__batch").fill_null(-1).to_numpy()[own]
            known = (place >= 0) & (number >= 0)
            place, own, number = place[known], own[known], number[known]
            counts = (inside[place] >> number) & 1 == 1
            sums = np.bincount(own[counts], odds[place[counts]], batch.num_rows).astype(np.float64)  # integers if none counts
            yield pa.record_batch([*(batch.column(k) for k in range(len(keys))), pa.array(sums)], [*keys, "odds"])

    rows = rows.select(*keys, "__batch", model_text(F.col(content)).alias("__text"))
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(summed, f"{kinds}odds double")


def with_stance(scored: DataFrame) -> DataFrame:
    return scored.withColumn("stance", C.stance_code(F.col("leave_probability")))


def author_stance(entries: DataFrame, model: DataFrame, prior: DataFrame, **options) -> DataFrame:
    """Stance of every author in every period, from the pooled texts."""
    return with_stance(score(entries, model, prior, ["author", "period"], ["period"], **options))


def mean_probability(post_scores: DataFrame) -> DataFrame:
    """Per author: posts, mean probability and mean polarisation of the posts."""
    p = F.col("leave_probability")
    return post_scores.groupBy("author").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg(p).alias("leave_probability"),
        F.avg(C.polarization(p)).alias("polarization"),
    )
