"""Run logs: (Metric, Value) tables of text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG = "Metric string, Value string"


def now_text() -> str:
    return datetime.now(timezone.utc).strftime("%y-%m-%d-%H_%M")


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored table, from its files' footers; 0 if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return spark.read.parquet(path).count()


def volume_text(rows: int, columns: int) -> str:
    return f"{rows}, {columns}"


def run_log(spark: SparkSession, entries: Sequence[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(m, str(v)) for m, v in entries], RUN_LOG)


def volume_log(df: DataFrame, **conditions) -> DataFrame:
    """Run log computed as a query: volume and the count of each condition."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )
    volume = F.concat_ws(", ", F.col("rows").cast("string"), F.lit(str(len(df.columns))))
    entries = [F.struct(F.lit("Volume").alias("Metric"), volume.alias("Value"))] + [
        F.struct(F.lit(n).alias("Metric"), F.col(n).cast("string").alias("Value"))
        for n in conditions
    ]
    return counts.select(F.inline(F.array(*entries)))
