"""Terms of documents: counting, stemming, weighting, ranking.

A document is named by one or more key columns; the long table
``(keys..., term, n)`` takes the place of a document-term matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstats.functions import text as X
from threadstats.functions.cutting import Words, counted
from threadstats.functions.stem import with_stem
from threadstats.functions.words import ENGLISH_STOP_WORDS, NEVER_LEADING
from threadstats.operators.numbering import first_rows
from threadstats.storage import broadcast_up_to, small_side, written

# A stem map of this many rows (two short strings each) stays near 200 MB.
STEM_MAP_BROADCAST_ROWS = 2_000_000
# Keys of several rows that may be broadcast.
MAX_REPEATED_KEYS = 500_000
# Words that every task may hold to tell what a word of a text stands for.
MAX_HELD_WORDS = 8_000_000
# Words whose terms every task may hold to count terms row by row.
MAX_ROW_VOCABULARY = 500_000


def remove_stop_words(terms: DataFrame, words: Sequence[str], column: str = "term") -> DataFrame:
    """Drop the listed words; a constant set, so no join is needed."""
    return terms.filter(~F.col(column).isin(list(words)))


def clean_texts(docs: DataFrame, content: str, target: str, topic_words: bool = True) -> DataFrame:
    """The text of each document after cleaning and stop-word removal (unstemmed)."""
    stop = X.descriptor_stop_words(topic_words)
    kept = F.filter(
        X.descriptor_tokens(F.col(content)), lambda w: (w != "") & ~w.isin(stop)
    )
    return docs.withColumn(target, F.array_join(kept, " "))


def _row_counts(docs: DataFrame, keys: Sequence[str], tokens: Column, terms: pa.Table | None = None) -> DataFrame:
    """(keys..., term, n): the tokens of every row, counted within the row, so nothing is moved.

    With ``terms`` (word, term) the terms that the words stand for are counted; other words are left out.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__tokens")
            words = lists.flatten().dictionary_encode()
            names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            if terms is not None:
                place = pc.index_in(names, value_set=terms.column("word"))
                names = terms.column("term").take(place).combine_chunks().dictionary_encode()
                to = names.indices.fill_null(-1).to_numpy().astype(np.int64)
                names, code = names.dictionary, to[code]
                owner, code = owner[code >= 0], code[code >= 0]
            pairs, n = np.unique(owner * max(len(names), 1) + code, return_counts=True)
            own, code = np.divmod(pairs, max(len(names), 1))
            yield pa.record_batch([*(batch.column(k).take(pa.array(own)) for k in range(len(keys))),
                                   names.take(pa.array(code)), pa.array(n.astype(np.int64))], [*keys, "term", "n"])

    rows = docs.select(*keys, tokens.alias("__tokens"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(counted, f"{kinds}, term string, n bigint")


def group_counts(docs: DataFrame, keys: Sequence[str], text: Column, cut: Callable[[pa.Array], Words]) -> DataFrame:
    """(keys..., word, n): how often each word occurs in the texts of a few large groups, as ``cut`` finds them.

    The words of a batch are counted where it is read, so what is moved are counts, not occurrences.
    """
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.Table.from_batches([batch.select(range(len(keys)))])
            group, first = np.zeros(batch.num_rows, np.int64), np.zeros(1, np.int64)
            for k in range(len(keys)):
                code = named.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
                _, first, group = np.unique(group * (batch.num_rows + 1) + code, return_index=True, return_inverse=True)
            own, words, n = counted(*cut(batch.column("__text")), group)
            at = pa.array(first[own])
            yield pa.record_batch([*(batch.column(k).take(at) for k in range(len(keys))), words, pa.array(n)], [*keys, "word", "n"])

    rows = docs.select(*keys, text.alias("__text"))
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(counts, f"{kinds}word string, n bigint").groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def _shared_keys(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys (under __names) that several rows have; a written table."""
    rows = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return written(rows.select(*[F.col(k).alias(f"__{k}") for k in keys]), "shared-keys")


def _counted(
    docs: DataFrame, keys: Sequence[str], tokens: Column, terms: pa.Table | None = None
) -> DataFrame:
    """(keys..., term, n): only the counts of keys that several rows share are moved and summed."""
    shared = _shared_keys(docs, keys)
    n_shared = shared.count()
    if not n_shared:
        return _row_counts(docs, keys, tokens, terms)
    if n_shared > MAX_REPEATED_KEYS:
        return _summed(_row_counts(docs, keys, tokens, terms), keys)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    own, pooled = (docs.join(F.broadcast(shared), same, kind) for kind in ("left_anti", "left_semi"))
    return _row_counts(own, keys, tokens, terms).unionByName(_summed(_row_counts(pooled, keys, tokens, terms), keys))


def _counted_terms(
    docs: DataFrame, keys: Sequence[str], tokens: Column, vocabulary: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(keys..., term, n): counts of the terms that words stand for.

    ``vocabulary`` maps a table of different words (term) to (word, term).  A small one is held by the
    tasks, which read the texts again and count terms at once; a larger one is joined to word counts.
    """
    different = docs.select(F.explode(tokens).alias("term")).distinct()
    table = written(vocabulary(written(different, "words")), "vocabulary")
    if table.count() <= MAX_ROW_VOCABULARY:
        return _counted(docs, keys, tokens, table.toArrow())
    counts = through(written(_counted(docs, keys, tokens), "word-counts"), table)
    if _shared_keys(docs, keys).isEmpty():  # many small keys: moved once, and summed where they arrive
        counts = counts.repartition(*keys)
    return _summed(counts, keys)


def _summed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def stem_map(words: DataFrame, column: str = "term") -> DataFrame:
    """Distinct words with their stems; the vocabulary-level stemming job."""
    vocabulary = words.select(F.col(column).alias("word")).distinct()
    return with_stem(vocabulary, "word", "stem")


def through(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Join word counts ``(keys..., term, n)`` with a table keyed by ``word``.

    The vocabulary is written and broadcast if it is small enough.  The word
    itself is dropped: the vocabulary says what stands for it.
    """
    table = broadcast_up_to(written(vocabulary, "vocabulary"), STEM_MAP_BROADCAST_ROWS)
    words = counts.withColumnRenamed("term", "word")
    return words.join(table, "word").drop("word")


def descriptor_words(
    docs: DataFrame, keys: Sequence[str], content: str = "content", topic_words: bool = True
) -> DataFrame:
    """Counts of the unstemmed words of cleaning chain A, stop words removed."""
    counts = _counted(docs, keys, X.descriptor_tokens(F.col(content)))
    return remove_stop_words(counts.filter(F.col("term") != ""), X.descriptor_stop_words(topic_words))


def descriptor_vocabulary(counts: DataFrame) -> DataFrame:
    """Words with the term each stands for; words without a valid term are left out."""
    stems = stem_map(counts).select("word", F.col("stem").alias("term"))
    return remove_stop_words(stems, ENGLISH_STOP_WORDS).filter(F.length("term") >= X.MIN_LENGTH)


def descriptor_counts(
    docs: DataFrame,
    keys: Sequence[str],
    content: str = "content",
    topic_words: bool = True,
    stem: bool = True,
) -> DataFrame:
    """Term counts of the descriptor vocabulary (cleaning chain A)."""
    if not stem:
        return descriptor_words(docs, keys, content, topic_words).filter(F.length("term") >= X.MIN_LENGTH)

    def vocabulary(words: DataFrame) -> DataFrame:
        return descriptor_vocabulary(
            remove_stop_words(words.filter(F.col("term") != ""), X.descriptor_stop_words(topic_words)))

    return _counted_terms(docs, keys, X.descriptor_tokens(F.col(content)), vocabulary)


def model_words(docs: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Counts of the unstemmed words of cleaning chain B, stop words removed."""
    return _counted(docs, keys, X.model_tokens(F.col(content))).filter(X.is_model_token(F.col("term")))


def model_vocabulary(counts: DataFrame, stem: bool = True) -> DataFrame:
    """Words with the model term each stands for; too short terms are left out."""
    if stem:
        terms = stem_map(counts).select("word", F.col("stem").alias("term"))
    else:
        terms = counts.select(F.col("term").alias("word"), "term").distinct()
    return terms.filter(F.length("term") >= X.MIN_LENGTH)


def model_counts(
    docs: DataFrame, keys: Sequence[str], content: str = "content", stem: bool = True
) -> DataFrame:
    """Term counts of the stance model's vocabulary (cleaning chain B)."""
    if not stem:
        return model_words(docs, keys, content).filter(F.length("term") >= X.MIN_LENGTH)
    return _counted_terms(docs, keys, X.model_tokens(F.col(content)),
                          lambda words: model_vocabulary(words.filter(X.is_model_token(F.col("term")))))


def matrix_counts(
    docs: DataFrame, keys: Sequence[str], content: str = "content", stem: bool = True
) -> DataFrame:
    """Term counts of the clustering matrix (tokeniser C)."""
    tokens = X.matrix_tokens(F.col(content))

    def kept(words: DataFrame) -> DataFrame:
        return remove_stop_words(words.filter(F.col("term") != ""), ENGLISH_STOP_WORDS)

    if stem:
        counts = _counted_terms(
            docs, keys, tokens, lambda words: stem_map(kept(words)).select("word", F.col("stem").alias("term")))
    else:
        counts = kept(_counted(docs, keys, tokens))
    return counts.filter(
        F.length("term").between(X.MATRIX_MIN_LENGTH, X.MATRIX_MAX_LENGTH)
    )


def tf_idf(
    counts: DataFrame,
    docs: DataFrame,
    keys: Sequence[str],
    batch: Sequence[str] = (),
) -> DataFrame:
    """Weight of each term: share of the document's terms times log2(docs / docs with it).

    ``docs`` names all documents (also those without any term); ``batch`` are
    the key columns within which document frequencies are taken.
    """
    batch = list(batch)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("doc_terms"))
    with_term = counts.groupBy(*batch, "term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = docs.select(*keys).distinct().groupBy(*batch).agg(F.count(F.lit(1)).alias("n_docs"))
    totals, with_term = small_side(totals, "document-totals"), small_side(with_term, "document-frequencies")
    # Terms first: a common one is then split right where the counts are read.
    weighted = counts.join(with_term, [*batch, "term"]).join(totals, list(keys))
    if batch:
        weighted = weighted.join(small_side(n_docs, "documents"), batch)
        all_docs = F.col("n_docs")
    else:
        all_docs = n_docs.scalar()
    weight = F.col("n") / F.col("doc_terms") * F.log2(all_docs / F.col("df"))
    return weighted.select(*keys, "term", "n", weight.alias("weight"))


def term_totals(weights: DataFrame, value: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Column sums of the term table, overall or per group."""
    return weights.groupBy(*by, "term").agg(F.sum(value).alias("total"))


def trim_vocabulary(
    counts: DataFrame, min_total: int = 3, min_length: int = X.MIN_LENGTH, by: Sequence[str] = ()
) -> DataFrame:
    """Terms (with totals) that are long and frequent enough within their batch."""
    return term_totals(counts.filter(F.length("term") >= min_length), by=by).filter(
        F.col("total") >= min_total
    )


def remove_sparse_terms(
    counts: DataFrame, docs: DataFrame, keys: Sequence[str], sparsity: float
) -> DataFrame:
    """Keep terms found in more than the share ``1 - sparsity`` of the documents."""
    n_docs = docs.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_docs")).scalar()
    frequent = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") > n_docs * F.lit(1.0 - sparsity))
        .select("term")
    )
    return counts.join(small_side(frequent, "frequent-terms"), "term", "left_semi")


def top_terms(
    weights: DataFrame, n: int, by: Sequence[str], value: str = "weight"
) -> DataFrame:
    """The n heaviest terms per group, ties (to nine digits) broken by the term.

    Spark cuts each task's rows to n per group before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(value, 9)), "term")
    ranked = weights.filter(F.col("term") != NEVER_LEADING).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= n)


def top_terms_with_ties(
    weights: DataFrame, n: int, by: Sequence[str], value: str = "beta"
) -> DataFrame:
    """The n heaviest terms per group; terms tied with the last one stay."""
    order = Window.partitionBy(*by).orderBy(F.desc(value))
    return weights.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= n)


def term_vectors(weights: DataFrame, keys: Sequence[str], value: str = "weight") -> DataFrame:
    """One row per document with its non-zero vector as a sorted array.

    Equal vectors are equal arrays, so they can be grouped.  A vector has at
    most one element per vocabulary term.
    """
    return (
        weights.filter(F.col(value) != 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("term", F.col(value).alias("weight")))).alias("vector"))
    )


def earliest_posts(entries: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n posts in date order: found by counts per day, so only one day's posts are put in order."""
    return first_rows(entries, n, order)


def leading_words(posts: DataFrame, n: int, author: str = "author", stem: bool = True) -> DataFrame:
    """The n words with the largest summed weight over distinct author vectors.

    Returns ``(rank, term, total)``; authors with equal vectors count once.
    """
    counts = written(descriptor_counts(posts, [author], stem=stem), "author-terms")
    weights = tf_idf(counts, posts, [author])
    unique = term_vectors(weights, [author]).select("vector").distinct()
    totals = (
        unique.select(F.explode("vector").alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.sum("t.weight").alias("total"))
        .filter(F.col("term") != NEVER_LEADING)
    )
    heaviest = [F.desc(F.round("total", 9)), F.col("term")]
    top = totals.orderBy(*heaviest).limit(n)
    order = Window.orderBy(*heaviest)  # over the n rows left
    return top.select(F.row_number().over(order).alias("rank"), "term", "total")
