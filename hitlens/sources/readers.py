"""Readers. Paths and credentials always come from the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """All text files below ``path``, one ``value`` per line."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet; a given schema spares the job that reads one from the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_partition(
    spark: SparkSession, path: str, column: str, value: str, equal: bool = True
) -> DataFrame:
    """Rows of one partition value, or of all others; other folders are not opened."""
    test = F.col(column) == value if equal else F.col(column) != value
    return read_table(spark, path).filter(test)


def local_table(
    spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | Sequence[str] | str
) -> DataFrame:
    """A few rows from the driver, with column names or a full schema."""
    return spark.createDataFrame(list(rows), schema)


def object_store_conf(
    endpoint: str, access_key: str, secret_key: str, path_style: bool = True
) -> dict[str, str]:
    """Session settings for an S3-compatible store."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
    }


def load_category_models(path: str, column: str) -> tuple[StringIndexerModel, OneHotEncoderModel]:
    base = f"{path.rstrip('/')}/{column}"
    return StringIndexerModel.load(f"{base}/indexer"), OneHotEncoderModel.load(f"{base}/encoder")


def load_indexer(path: str, column: str) -> StringIndexerModel:
    return StringIndexerModel.load(f"{path.rstrip('/')}/{column}/indexer")


def load_classifier(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
