"""Predicting the next stance from an author's descriptors, judged on authors the model has not seen.

Rows keep their author until they are split: all periods of an author fall on the
same side, which a split after the collapse of equal descriptors could not promise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstats.operators.descriptors import GROUP, majority_collapse, with_next_label
from threadstats.storage import written

LABEL = "next_label"


def split_by_author(labelled: DataFrame, folds: int = 5, held: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; an author's rows all lie on one side, chosen by a digest of the name."""
    fold = F.conv(F.substring(F.md5(F.col("author").cast("binary")), 1, 7), 16, 10).cast("bigint") % folds
    return labelled.filter(fold != held), labelled.filter(fold == held)


def features_of(labelled: DataFrame) -> list[str]:
    return [c for c in labelled.columns if c not in (*GROUP, LABEL)]


def fit(training: DataFrame, features: Sequence[str], kind: str = "logistic", seed: int = 1) -> PipelineModel:
    """A fitted pipeline from descriptor columns to ``prediction``; equal descriptors vote once, by majority."""
    collapsed = written(majority_collapse(training, features), "classifier-rows")
    gathered = VectorAssembler(inputCols=list(features), outputCol="gathered", handleInvalid="keep")
    scaled = StandardScaler(inputCol="gathered", outputCol="features", withMean=True, withStd=True)
    if kind == "logistic":
        model = LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=50, regParam=0.01)
    elif kind == "forest":
        model = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=30, maxDepth=6, seed=seed)
    else:
        raise ValueError("kind is logistic or forest")
    return Pipeline(stages=[gathered, scaled, model]).fit(collapsed.withColumn(LABEL, F.col(LABEL).cast("double")))


def confusion(model: PipelineModel, test: DataFrame) -> DataFrame:
    """(label, prediction, n) over the test rows."""
    judged = model.transform(test)
    return judged.groupBy(F.col(LABEL).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def evaluate(described: DataFrame, name: str, kind: str = "logistic") -> DataFrame:
    """One row of measures: rows on both sides, accuracy, mean recall of the labels, and the commonest label's share.

    ``described`` has author, period, current_label and descriptor columns.
    """
    labelled = written(with_next_label(described), "labelled")
    training, test = split_by_author(labelled)
    n_train = training.count()
    if not n_train:
        raise ValueError("no labelled rows to learn from")
    counted = written(confusion(fit(training, features_of(labelled), kind), test), "confusion")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_label = counted.groupBy("label").agg(F.sum("n").alias("n"), F.sum(hit).alias("right"))
    return by_label.agg(
        F.lit(name).alias("descriptors"), F.lit(kind).alias("kind"), F.lit(n_train).cast("bigint").alias("n_train"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_test"), (F.sum("right") / F.sum("n")).alias("accuracy"),
        F.avg(F.col("right") / F.col("n")).alias("mean_recall"), (F.max("n") / F.sum("n")).alias("commonest_share"))
