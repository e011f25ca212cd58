"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept.

``run`` writes each stage's result as Parquet in the session's shared folder and
reads it again as the next one's documents.  All stages but the last return the
columns of ``documents``.

Null and empty texts are judged like other texts (as empty ones).  Rows without an id
are kept or dropped by their text alone and are packed; repeated rows are judged
alike, and near-duplicates of each other, so one of them stays.  Extra columns pass
through all stages but the last.  An empty table gives an empty result; without
labels nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadstats.llm import packing, quality, simhash, toxicity
from threadstats.llm.shared import table
from threadstats.storage import scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs, width=3, max_bits=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash", simhash_stage), ("packing", packing_stage),
]

#: SQL expresses none of the learned stages; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    with scope(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = keep(stage(spark, docs, sf_dir), name)
        return docs
