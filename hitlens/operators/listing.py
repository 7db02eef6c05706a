"""Listings of the highest scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TASKS_A_GROUP = 256


def highest(
    df: DataFrame, group: str, score: str = "outlierScore", k: int = 20, ties: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` rows of highest ``score`` of every ``group``, with their ``place`` from 1.

    Equal scores are in order of ``ties``, so that a listing is the same on every run; rows that are
    equal there too share the last places in any order. Rows without a score are left out; a NULL
    group is a group. Each task keeps ``k`` rows of a group before anything is shuffled, then
    ``TASKS_A_GROUP`` tasks' rows are reduced to ``k``, and those to ``k`` again: no task sees all rows of
    a group, however large it is. Spark reduces early up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    (1,000) rows; a listing beyond that is refused.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if not 0 < k <= most:
        raise ValueError(f"k must be from 1 to {most}; it is {k}")
    order = [F.desc(score), *map(F.asc, ties)]
    share = F.floor(F.spark_partition_id() / TASKS_A_GROUP)
    scored = df.filter(F.col(score).isNotNull()).withColumn("_share", share)
    some = Window.partitionBy(group, "_share").orderBy(*order)
    all_of_it = Window.partitionBy(group).orderBy(*order)
    few = scored.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= k)
    few = few.drop("_share", "place")
    return few.withColumn("place", F.row_number().over(all_of_it)).filter(F.col("place") <= k)
