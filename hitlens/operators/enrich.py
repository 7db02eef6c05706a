"""Derived request columns: decoded URI, referer domain, time parts, site category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.functions import times, uri

OTHER = "other"
UNKNOWN = uri.UNKNOWN_DOMAIN


def add_uri_columns(requests: DataFrame) -> DataFrame:
    """Decoded URI, path, query pairs and referer domain.

    Each step is a column of its own: Spark keeps such projections apart when a
    column is used more than once, so no regular expression runs twice per row.
    """
    decoded = requests.withColumn("dec_req_uri", uri.decode_uri(F.col("req_uri")))
    cleaned = decoded.withColumns(
        {
            "_uri": uri.without_controls(F.col("dec_req_uri")),
            "_referer": uri.without_controls(F.col("http_referer")),
        }
    )
    parts = cleaned.withColumns(
        {
            "_path": uri.path_part(F.col("_uri")),
            "_query": uri.query_part(F.col("_uri")),
            "_netloc": uri.netloc_part(F.col("_referer")),
        }
    )
    return parts.select(
        *decoded.columns,
        uri.strip_params(F.col("_path"), F.col("_uri")).alias("clean_path"),
        uri.split_query(F.col("_query")).alias("clean_query_list"),
        uri.name_domain(F.col("_netloc")).alias("domain"),
    )


def add_time_columns(requests: DataFrame) -> DataFrame:
    stamped = requests.withColumn("fdate_time", times.log_timestamp(F.col("date_time")))
    stamp = F.col("fdate_time")
    return stamped.withColumns(
        {
            "dateunixtimest": times.epoch_seconds(stamp),
            "fabstime": times.fractional_hour(stamp),
            "day_of_week": times.day_of_week(stamp),
        }
    )


def add_domain_category(
    requests: DataFrame, domains: Sequence[str] | DataFrame
) -> DataFrame:
    """``domain`` when registered, else ``other``.

    ``domains`` is a list (a job parameter) or a table with one ``domain``
    column. The table is left-joined without a hint: Spark broadcasts it while
    it is under the broadcast threshold and shuffles beyond, where adaptive
    execution splits a hot domain.
    """
    if isinstance(domains, DataFrame):
        known = domains.select("domain", F.col("domain").alias("domain_category"))
        return requests.join(known.dropDuplicates(["domain"]), "domain", "left").select(
            *requests.columns,
            F.coalesce("domain_category", F.lit(OTHER)).alias("domain_category"),
        )
    registered = F.col("domain").isin(*domains) if domains else F.lit(False)
    return requests.withColumn(
        "domain_category", F.when(registered, F.col("domain")).otherwise(OTHER)
    )


def accept_class(probability, labels: Sequence[str], threshold: float = 0.70):
    """Label of the largest probability when it exceeds ``threshold``, else ``other``.

    ``probability`` is an array column; the first of equal maxima wins.
    """
    best = F.array_max(probability)
    names = F.array(*[F.lit(name) for name in labels])
    label = F.element_at(names, F.array_position(probability, best).cast("int"))
    return F.when(best > threshold, label).otherwise(OTHER)
