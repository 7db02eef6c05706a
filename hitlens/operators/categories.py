"""Category indexes: labels numbered by falling frequency, ties by name."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitlens.session import land


def number_rows(df: DataFrame, *order, name: str) -> DataFrame:
    """Global row numbers from 0, without gathering the rows in one task.

    Rows are range-sorted and stored once; only one count per partition is
    summed up in a single task.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_offset", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = land(placed, "numbered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_offset")).alias(name)
    )


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Table ``(label, count, index)`` over all values of ``column``."""
    counted = df.groupBy(F.col(column).alias("label")).count().filter("label IS NOT NULL")
    return number_rows(counted, F.desc("count"), F.asc("label"), name="index")


def fit_indexer(
    df: DataFrame, column: str, max_labels: int | None = None
) -> StringIndexerModel:
    """Indexer model for a column of few distinct values.

    The labels are part of the model and so live on the driver; a column with very
    many belongs in ``category_index``, which stays a table. With ``max_labels``
    more labels are an error, found before they are read.
    """
    ranked = (
        df.groupBy(F.col(column).alias("label"))
        .count()
        .filter("label IS NOT NULL")
        .orderBy(F.desc("count"), F.asc("label"))
        .select("label")
    )
    ranked = (ranked if max_labels is None else ranked.limit(max_labels + 1)).collect()
    if max_labels is not None and len(ranked) > max_labels:
        raise ValueError(f"{column} has more than {max_labels} values; use category_index")
    return StringIndexerModel.from_labels(
        [row.label for row in ranked],
        inputCol=column,
        outputCol=f"{column}_index",
        handleInvalid="error",
    )


def fit_encoder(indexed: DataFrame, column: str) -> OneHotEncoderModel:
    """One-hot encoder, last category dropped; the size comes from column metadata."""
    encoder = OneHotEncoder(inputCols=[f"{column}_index"], outputCols=[f"{column}_onehot"])
    return encoder.fit(indexed)


def encode(
    df: DataFrame, indexer: StringIndexerModel, encoder: OneHotEncoderModel, unseen: str = "error"
) -> DataFrame:
    """Index and one-hot columns; ``unseen="skip"`` leaves out rows of unknown category."""
    return encoder.transform(indexer.copy().setHandleInvalid(unseen).transform(df))
