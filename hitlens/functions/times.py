"""Log time expressions. The session time zone must be UTC (see ``hitlens.session``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
INDEX_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def log_date(date_time: Column) -> Column:
    return F.substring(date_time, 1, 11)


def log_clock(date_time: Column) -> Column:
    return F.substring(date_time, 13, 8)


def log_timestamp(date_time: Column) -> Column:
    """Timestamp of the log's own notation; any offset is honoured, bad dates are NULL."""
    return F.try_to_timestamp(date_time, F.lit(LOG_TIME))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def day_of_week(ts: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(ts)


def index_time(ts: Column) -> Column:
    """ISO text with milliseconds and offset, as search indexes take it."""
    return F.date_format(ts, INDEX_TIME)
