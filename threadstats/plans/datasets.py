"""The end-to-end tables: entries, annotated entries and training sets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.functions.columns import strip_quotes
from threadstats.operators import descriptors as D
from threadstats.operators.entries import attach_stance, union_entries
from threadstats.operators.forest import repair_orphans
from threadstats.operators.periods import DEFAULT_PERIODS, assign_period
from threadstats.operators.stance import author_stance
from threadstats.operators.terms import earliest_posts, leading_words
from threadstats.storage import written

ORDER = ["date", "kind", "entry_id"]


def base_entries(
    submissions: DataFrame,
    comments: DataFrame,
    cuts: Sequence[str | date] | int | None = DEFAULT_PERIODS,
    drop_authors: Sequence[str] = (),
) -> DataFrame:
    """All entries with cleaned content; with cuts, only those in a period."""
    entries = union_entries(submissions, comments)
    if drop_authors:
        entries = entries.filter(~F.col("author").isin(list(drop_authors)))
    if cuts is not None:
        entries = assign_period(entries, cuts)
    return entries.withColumn("content", strip_quotes(F.col("content")))


def annotated_entries(
    entries: DataFrame, model: DataFrame, prior: DataFrame, keep_content: bool = False, **options
) -> DataFrame:
    """Entries with their author's stance and a repaired parent.

    The stance join and the orphan repair move narrow rows only, which are
    written; texts are read where they lie, and if wanted, joined back once at
    the end.
    """
    stance = author_stance(entries, model, prior, **options)
    narrow = attach_stance(repair_orphans(written(entries.drop("content"), "narrow-entries")), stance)
    if keep_content:
        return narrow.join(entries.select("entry_id", "content"), "entry_id")
    return narrow


def f0_words(entries: DataFrame, n: int = D.F0_WORDS, posts: int | None = None) -> DataFrame:
    """The descriptor words: leading words of all posts, or of the ``posts`` earliest ones."""
    if posts is None:
        return leading_words(entries, n)
    ordered = entries.withColumn("kind", F.col("comment_id").isNull().cast("int"))
    return leading_words(earliest_posts(ordered, posts, ORDER), n)


def f0_labelled(entries: DataFrame, words: DataFrame, stance: DataFrame, n_words: int = D.F0_WORDS) -> DataFrame:
    labels = stance.select("author", "period", F.col("stance").alias("current_label"))
    return D.with_next_label(D.f0_descriptors(entries, words, labels, n_words))


def f0_training(
    entries: DataFrame, words: DataFrame, stance: DataFrame, n_words: int = D.F0_WORDS,
    digits: int | None = None,
) -> DataFrame:
    labelled = f0_labelled(entries, written(words, "words"), stance, n_words)
    columns = [f"w{i}" for i in range(1, n_words + 1)] + ["current_label"]
    return D.majority_collapse(labelled, columns, digits=digits)


def f1_training(entries: DataFrame, digits: int | None = None) -> DataFrame:
    labelled = D.with_next_label(D.f1_descriptors(entries))
    return D.majority_collapse(labelled, [*D.F1_COLUMNS, "current_label"], digits=digits)


def f2_training(entries: DataFrame, digits: int | None = None) -> DataFrame:
    labelled = D.with_next_label(D.f2_descriptors(entries))
    return D.majority_collapse(labelled, [*D.F2_COLUMNS, "current_label"], digits=digits)


def f3_training(entries: DataFrame, as_of_period: bool = False, digits: int | None = None) -> DataFrame:
    labelled = D.with_next_label(D.f3_descriptors(entries, as_of_period))
    return D.majority_collapse(labelled, [*D.F3_COLUMNS, "current_label"], digits=digits)
