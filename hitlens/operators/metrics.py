"""Hold-out split, confusion matrix and classifier quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAIN_TENTHS = 8


def split_bucket(key: Sequence[str], seed: int) -> Column:
    """Bucket 0..9 from the row's own values, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10


def holdout_split(
    df: DataFrame, key: Sequence[str], seed: int = 123, train_tenths: int = TRAIN_TENTHS
) -> tuple[DataFrame, DataFrame]:
    bucket = split_bucket(key, seed)
    return df.filter(bucket < train_tenths), df.filter(bucket >= train_tenths)


def confusion_matrix(
    df: DataFrame, label: str = "domain_index", prediction: str = "prediction"
) -> DataFrame:
    """Counts and shares per (label, prediction); the window spans classes, not rows."""
    cells = df.groupBy(
        F.col(label).cast("int").alias("domain_index"),
        F.col(prediction).cast("int").alias("prediction"),
    ).count()
    total = F.sum("count").over(W.partitionBy())
    return cells.withColumn("percentage", F.col("count") / total)


def confusion_pivot(matrix: DataFrame, classes: Sequence[int], value: str = "count") -> DataFrame:
    """One row per label, one column per predicted class, missing cells 0."""
    return (
        matrix.groupBy("domain_index")
        .pivot("prediction", list(classes))
        .agg(F.sum(value))
        .na.fill(0)
    )


def classifier_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and label-weighted precision, recall and F1."""
    hit = F.when(F.col("domain_index") == F.col("prediction"), F.col("count")).otherwise(0)
    actual = matrix.select(
        F.col("domain_index").alias("class"),
        F.col("count").alias("actual"),
        F.lit(0).cast("bigint").alias("predicted"),
        hit.cast("bigint").alias("hits"),
    )
    predicted = matrix.select(
        F.col("prediction").alias("class"),
        F.lit(0).cast("bigint").alias("actual"),
        F.col("count").alias("predicted"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    per_class = (
        actual.union(predicted)
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
        .filter("actual > 0")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.col("hits") / F.col("actual")
    scored = per_class.select(
        "actual", "hits", precision.alias("precision"), recall.alias("recall")
    ).withColumn(
        "f1",
        F.when(
            F.col("precision") + F.col("recall") > 0,
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
        ).otherwise(0.0),
    )

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("actual")) / F.sum("actual")

    return scored.agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )
