"""Missing values and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that a cast to double turns into NaN.
NAN_TEXT = r"^[\x00-\x20]*(?:(?i:nan)|[+-]NaN)[\x00-\x20]*$"


def is_missing(field: T.StructField) -> Column:
    """NULL, blank, NaN or NaN text."""
    column = F.col(field.name)
    missing = column.isNull()
    if isinstance(field.dataType, T.StringType):
        return missing | (F.trim(column) == "") | column.rlike(NAN_TEXT)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return missing | F.isnan(column)
    return missing


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blank text, NaN and NaN text become NULL in every column."""
    return df.select(
        *[F.when(~is_missing(f), F.col(f.name)).alias(f.name) for f in df.schema.fields]
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any NULL."""
    return df.na.drop()


def complete_rows(df: DataFrame) -> DataFrame:
    """``drop_incomplete(blank_to_null(df))`` as one filter."""
    return df.filter(~reduce(or_, [is_missing(f) for f in df.schema.fields]))


def distinct_requests(df: DataFrame) -> DataFrame:
    """Full-row distinct. Copies collapse before the shuffle, so hot rows do not travel."""
    return df.dropDuplicates()


def union_strict(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=False)


def union_sparse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that one side lacks are NULL there."""
    return left.unionByName(right, allowMissingColumns=True)


def numbered_slice(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` (from 0, included) to ``stop`` (excluded) of the given order.

    The limit keeps the sort to the first ``stop`` rows of each task.
    """
    ordered = df.orderBy(*order)
    return ordered.limit(stop).offset(start)


MOST_SPANS = 64
DAY_SECONDS = 86_400


def _within(days: list[int], seconds: str) -> Column:
    """``seconds`` are of one of the sorted ``days``: one range per run of days, or one for all beyond 64 runs."""
    runs = [[days[0], days[0]]]
    for day in days[1:]:
        if day > runs[-1][1] + 1:
            runs.append([day, day])
        runs[-1][1] = day
    if len(runs) > MOST_SPANS:
        runs = [[days[0], days[-1]]]
    ends = [(F.lit(first * DAY_SECONDS), F.lit((last + 1) * DAY_SECONDS)) for first, last in runs]
    return reduce(or_, [(F.col(seconds) >= start) & (F.col(seconds) < end) for start, end in ends])


def unseen_rows(df: DataFrame, stored: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Rows of ``df`` whose ``keys`` no row of ``stored`` has.

    ``df`` should be a stored table: its days are looked up first, and of ``stored`` only rows of those days
    are read, the ``keys`` alone. ``seconds`` is a column of epoch seconds: Spark's Parquet files keep no
    statistics of timestamps by default, but of integers, by which the scan leaves out the row groups of
    other days. Equal keys must have equal times. A row of ``df`` with a NULL among its keys is kept, as it
    equals nothing.
    """
    day = F.floor(F.col(seconds) / DAY_SECONDS)
    days = sorted(r[0] for r in df.filter(F.col(seconds).isNotNull()).select(day).distinct().collect())
    if not days:
        return df
    there = stored.filter(_within(days, seconds)).select(*keys)
    return df.join(there, list(keys), "left_anti").select(*df.columns)
