"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstats.llm import (
    cross_polytope, embed_dedup, hard_negatives, lm_scoring, mixing, packing, piece_scan, quality, simhash, token_counts,
    toxicity, url_filter, whitening,
)
from threadstats.llm.shared import table
from threadstats.storage import scope, scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: number and checksum of the ids, and of the bytes that decoding gives back."""
    with scope(spark) as keep:
        encoded = piece_scan.encode(table(spark, sf_dir, "documents"), PIECES)
        return keep(piece_scan.digests(encoded, PIECES), "sentencepiece")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every text is missing at first."""
    with scope(spark) as keep:
        counted = token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE, scratch_path(spark, "cache"))
        return keep(counted, "token_counts")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, size=4096)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as the 64-bit integer it is at these sizes (a larger one raises)."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), count=8, scale=1024, shift=100_000)
    return white.withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_dedup, op2_toxicity, op3_url_filter, op4_sentencepiece, op5_nearest, op6_lm_scoring, op7_token_counts,
    op8_packing, op9_quality, op10_embedding_dedup, op11_whitening, op12_mixing, op13_hard_negatives)}

#: Exact comparisons of vectors can be said in SQL; the others are tested against brute-force versions.
ORACLE_SQL = {
    "op10_embedding_dedup": """
with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
    where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.9),
reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reach r join links l on l.a = r.b)
select e.vec_id,
       (select count(*) from links l where l.a = e.vec_id) as n_links,
       (select min(b) from reach r where r.a = e.vec_id) as component_id,
       e.vec_id = (select min(b) from reach r where r.a = e.vec_id) as kept
from embeddings e
""",
    "op13_hard_negatives": """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as x
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
           cast(list_inner_product(a.x, b.x) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (
           partition by anchor_id, positive_id order by score desc, other_id) as int) as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
""",
}
