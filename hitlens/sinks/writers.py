"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The columns a search index receives.
PUBLISHED = (
    "method status body_bytes_sent http_referer user_agent dec_req_uri "
    "fabstime day_of_week es_time outlierScore anomaly_bool domain_category"
).split()


def write_partitioned(
    df: DataFrame, path: str, by: str, mode: str = "error", keep_others: bool = False
) -> None:
    """Parquet in one folder per value of ``by``.

    ``mode`` is ``error`` (a target that exists is left alone), ``append`` or
    ``overwrite``. ``keep_others`` overwrites only the values present in ``df``. The rebalance
    hint shuffles rows by value so that a value has few files, and adaptive
    execution splits the partitions of a hot value by size.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite" if keep_others else mode)
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(by)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with header, for aggregates.

    ``repartition`` rather than ``coalesce``: the aggregate before it keeps all
    its tasks, only its result is gathered.
    """
    df.repartition(1).write.mode(mode).option("header", "true").csv(path)


def select_published(df: DataFrame) -> DataFrame:
    return df.select(*PUBLISHED)


def publish(df: DataFrame, target: str, fmt: str = "json", **options: str) -> None:
    """Replace an index by the published columns.

    ``fmt`` names any Spark data source; with a search connector on the class
    path ``target`` is the index, by default it is a folder of JSON lines.
    """
    select_published(df).write.format(fmt).options(**options).mode("overwrite").save(target)


def save_model(model, path: str, overwrite: bool = True) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def save_category_models(indexer, encoder, path: str, column: str) -> None:
    base = f"{path.rstrip('/')}/{column}"
    save_model(indexer, f"{base}/indexer")
    if encoder is not None:
        save_model(encoder, f"{base}/encoder")
