"""Descriptors of authors per period, and their labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadstats.functions.columns import STANCE_SUFFIX, quartiles, spread
from threadstats.functions.cutting import descriptor_words as cut_descriptor_words
from threadstats.functions.cutting import different
from threadstats.functions.text import descriptor_stop_words
from threadstats.operators import forest
from threadstats.operators.terms import MAX_HELD_WORDS, descriptor_vocabulary, descriptor_words, group_counts, remove_stop_words, through
from threadstats.storage import small_side, written

GROUP = ["author", "period"]
F0_WORDS = 100
# The word table is joined by broadcast: one row per descriptor column.
F0_MAX_WORDS = 10_000
# Up to this many, counts are summed in a column per word.
F0_COLUMN_WORDS = 250
# Rows as wide as the words, one per period.
MAX_BROADCAST_PERIODS = 1_000


def _five(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, 6)]


F1_COLUMNS = ["total_entries", "cs", "id", *_five("rd"), *_five("r"), "rd_sum", "r_sum"]
F2_GROUPS = [f"{kind}{suffix}" for kind in ("rd", "r") for suffix in STANCE_SUFFIX.values()]
F2_COLUMNS = [f"cs{s}" for s in STANCE_SUFFIX.values()] + [
    name for group in F2_GROUPS for name in (*_five(group), f"{group}_sum")
]
F3_COLUMNS = [f"p{s}_q{q}" for s in STANCE_SUFFIX.values() for q in (0, 25, 50, 75, 100)]


def with_next_label(described: DataFrame) -> DataFrame:
    """Add the same author's label in the following period; drop rows without one.

    One row per author and period comes in, so a window holds no more rows
    than there are periods.
    """
    by_author = Window.partitionBy("author").orderBy("period")
    follows = F.lead("period").over(by_author) == F.col("period") + 1
    return described.withColumn(
        "next_label", F.when(follows, F.lead("current_label").over(by_author))
    ).filter(F.col("next_label").isNotNull())


def author_labels(entries: DataFrame) -> DataFrame:
    """One stance per author and period."""
    return entries.groupBy(*GROUP).agg(F.min("stance").alias("current_label"))


def next_stance(entries: DataFrame) -> DataFrame:
    return with_next_label(author_labels(entries))


def retained_authors(entries: DataFrame) -> DataFrame:
    """Authors active both in a period and in the next one."""
    return next_stance(entries).select(*GROUP)


def common_authors(entries: DataFrame, period: int, other: int) -> DataFrame:
    """Authors active in both of two periods."""
    both = entries.filter(F.col("period").isin(period, other))
    return both.groupBy("author").agg(
        F.min("period").alias("lo"), F.max("period").alias("hi")
    ).filter((F.col("lo") == min(period, other)) & (F.col("hi") == max(period, other))).select("author")


def f1_descriptors(entries: DataFrame, replies: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Own activity and replies received; ``counts``: the ``reply_counts`` of the entries, if they are at hand."""
    counts = forest.reply_counts(entries, replies) if counts is None else counts
    direct = sum((F.col(c) for c in forest.DIRECT.values()), F.lit(0))
    everything = sum((F.col(c) for c in forest.ALL.values()), F.lit(0))
    per_entry = counts.select(*GROUP, "stance", "is_comment", direct.alias("rd"), everything.alias("r"))
    described = per_entry.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if("is_comment").alias("cs"),
        F.count_if(~F.col("is_comment")).alias("id"),
        quartiles(F.col("rd")).alias("rd_q"),
        quartiles(F.col("r")).alias("r_q"),
        F.sum("rd").alias("rd_sum"),
        F.sum("r").alias("r_sum"),
        F.min("stance").alias("current_label"),
    )
    return described.select(
        *GROUP, "total_entries", "cs", "id",
        *spread(F.col("rd_q"), _five("rd")), *spread(F.col("r_q"), _five("r")),
        "rd_sum", "r_sum", "current_label",
    )


def f2_descriptors(entries: DataFrame, replies: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Replies given and received, split by the stance of the other party.

    Two aggregates read the replies, so their join is done and written once.
    ``counts``: the ``reply_counts`` of the entries, if they are at hand.
    """
    if replies is None:
        replies = written(forest.replies_with_parent(entries), "replies")
    counts = forest.reply_counts(entries, replies) if counts is None else counts
    source = dict(zip(F2_GROUPS, [*forest.DIRECT.values(), *forest.ALL.values()], strict=True))
    received = counts.groupBy(*GROUP).agg(
        F.min("stance").alias("current_label"),
        *[quartiles(F.col(c)).alias(f"{g}_q") for g, c in source.items()],
        *[F.sum(c).alias(f"{g}_sum") for g, c in source.items()],
    )
    given = forest.parent_stance_counts(replies)
    given_columns = [f"cs{s}" for s in STANCE_SUFFIX.values()]
    return received.join(given, GROUP, "left").select(
        *GROUP,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in given_columns],
        *[c for g in F2_GROUPS for c in (*spread(F.col(f"{g}_q"), _five(g)), F.col(f"{g}_sum"))],
        "current_label",
    )


def thread_mix(entries: DataFrame) -> DataFrame:
    """Stance shares of each thread's entries.

    Every chain of parents ends at the submission (orphans are repaired), so
    the thread is the group of its submission id.
    """
    counted = entries.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("tc"),
        *[F.count_if(F.col("stance") == s).alias(f"n_{x}") for s, x in STANCE_SUFFIX.items()],
    )
    return counted.select(
        "submission_id", "tc",
        *[(F.col(f"n_{x}") / F.col("tc")).alias(f"p{x}") for x in STANCE_SUFFIX.values()],
    )


def f3_descriptors(entries: DataFrame, as_of_period: bool = False) -> DataFrame:
    """Stance mix of the threads an author took part in.

    By default all of an author's threads count in each period, also those
    joined later; with ``as_of_period`` only those joined up to the period do.
    """
    shares = [f"p{x}" for x in STANCE_SUFFIX.values()]
    joined = entries.groupBy("author", "submission_id").agg(F.min("period").alias("since"))
    mixes = joined.join(small_side(thread_mix(entries), "thread-mixes"), "submission_id")
    labels = author_labels(entries)
    if as_of_period:
        keys = GROUP
        mixes = mixes.join(labels.select(*GROUP), "author").filter(F.col("since") <= F.col("period"))
    else:
        keys = ["author"]
    described = mixes.groupBy(*keys).agg(*[quartiles(F.col(p)).alias(p) for p in shares])
    columns = [
        c for p in shares
        for c in spread(F.col(p), [f"{p}_q{q}" for q in (0, 25, 50, 75, 100)])
    ]
    return described.join(labels, keys).select(*GROUP, *columns, "current_label")


def _slot_counts(entries: DataFrame, slots: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """(author, period, "0", "1" ...): how many words stand for each rank, and in "0" for any other term.

    Most words stand for other terms, so tasks hold only the words that don't, and count where a text
    is read.  If those are too many, words of texts are counted and joined.
    """
    seen = written(group_counts(entries, [], F.col("content"), cut_descriptor_words), "words")
    lower = seen.select("word", F.lower("word").alias("term"))
    stems = descriptor_vocabulary(remove_stop_words(lower, descriptor_stop_words())).select(F.col("word").alias("term"), F.col("term").alias("stem"))
    ranked = stems.join(slots.select("rank", F.col("term").alias("stem")), "stem", "left").select("term", F.coalesce("rank", F.lit(0)).alias("slot"))
    place = lower.join(ranked, "term", "left").select("word", F.coalesce("slot", F.lit(-1)).cast("int").alias("slot"))
    held = written(place.filter("slot <> 0"), "held-words")
    columns = [str(i) for i in ranks]
    if len(ranks) > F0_COLUMN_WORDS + 1 or held.count() > MAX_HELD_WORDS:
        counts = written(descriptor_words(entries, GROUP), "word-counts")
        vocabulary = descriptor_vocabulary(counts).join(slots, "term", "left").select("word", F.coalesce("rank", F.lit(0)).alias("slot"))
        filled = through(counts, vocabulary).select(*GROUP, "slot", "n")
        empty = entries.select(*GROUP).distinct().select(*GROUP, F.lit(0).alias("slot"), F.lit(0).cast("bigint").alias("n"))
        return filled.unionByName(empty).groupBy(*GROUP).pivot("slot", list(ranks)).agg(F.sum("n")).na.fill(0, columns)
    shared = entries.sparkSession.sparkContext.broadcast(held.toArrow().combine_chunks())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, slot_of = shared.value.column("word").combine_chunks(), shared.value.column("slot").to_numpy()
        for batch in batches:
            rows = batch.num_rows
            tokens, n = cut_descriptor_words(batch.column("content"))
            names, code = different(tokens)
            at = pc.index_in(names, value_set=special)
            slot = np.zeros(len(names), np.int64)
            slot[at.is_valid().to_numpy(zero_copy_only=False)] = slot_of[at.drop_null().to_numpy()]
            slot, own = slot[code], np.repeat(np.arange(rows), n)
            counts = np.bincount((slot * rows + own)[slot >= 0], minlength=rows * len(ranks)).reshape(len(ranks), rows)
            yield pa.record_batch([*(batch.column(k) for k in GROUP), *map(pa.array, counts.astype(np.int64))], [*GROUP, *columns])

    texts = entries.select(*GROUP, "content")
    kinds = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in GROUP), *(f"`{c}` bigint" for c in columns)])
    return texts.mapInArrow(counted, kinds).groupBy(*GROUP).agg(*[F.sum(f"`{c}`").alias(c) for c in columns])


def f0_descriptors(
    entries: DataFrame, words: DataFrame, labels: DataFrame, n_words: int = F0_WORDS
) -> DataFrame:
    """TF-IDF of the leading words, within each period.

    ``words`` holds (rank, term).  Terms outside it only add to the length of
    the document, so they are summed into slot 0 before the table is widened.
    """
    if n_words > F0_MAX_WORDS:
        raise ValueError(f"at most {F0_MAX_WORDS} descriptor words")
    # One row per rank, and there are at most F0_MAX_WORDS ranks.
    slots = F.broadcast(words.filter(F.col("rank") <= n_words).select("rank", "term"))
    ranks = list(range(n_words + 1))
    wide = written(_slot_counts(entries, slots, ranks), "word-counts-wide")
    per_period = wide.groupBy(F.col("period").alias("in_period")).agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.count_if(F.col(f"`{i}`") > 0).alias(f"df{i}") for i in ranks[1:]],
    )
    length = sum((F.col(f"`{i}`") for i in ranks[1:]), F.col("`0`"))
    per_period = small_side(per_period, "period-frequencies", MAX_BROADCAST_PERIODS)
    joined = wide.join(per_period, F.col("period") == F.col("in_period")).withColumn("doc_terms", length)

    def weight(i: int) -> Column:
        present = F.col(f"`{i}`") > 0
        value = F.col(f"`{i}`") / F.col("doc_terms") * F.log2(F.col("docs") / F.col(f"df{i}"))
        return F.when(present, value).otherwise(0.0).alias(f"w{i}")

    return joined.select(*GROUP, *[weight(i) for i in ranks[1:]]).join(labels, GROUP)


def majority_collapse(
    labelled: DataFrame, features: Sequence[str], label: str = "next_label", digits: int | None = None
) -> DataFrame:
    """Equal descriptors become one row with their most frequent label.

    Ties go to the smallest label; rows without a label do not vote.
    ``digits`` rounds fractions before comparing.
    """
    fractions = {f.name for f in labelled.schema if isinstance(f.dataType, T.DoubleType)}
    keys = [
        (F.round(c, digits) if digits is not None and c in fractions else F.col(c)).alias(c)
        for c in features
    ]
    counted = labelled.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*features).agg(F.min_by(label, F.struct(-F.col("__n"), label)).alias(label))
