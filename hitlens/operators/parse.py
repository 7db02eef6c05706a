"""From log lines to typed requests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.functions import times
from hitlens.operators.clean import is_missing

# The line format and the names of its groups, in order.
LINE = r"^((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F:]+) - (-|[^\s]+) \[([^\]]+)\] \"([A-Z]+) ([^ ]+) (HTTP/\d\.\d)\" (\d{3}) (\d+) \"([^\"]*)\" \"([^\"]*)\"(?:\s+(\d+))?"  # noqa: E501
FIELDS = (
    "remote_addr remote_usr date_time method req_uri http_ver "
    "status body_bytes_sent http_referer user_agent gzip_ratio"
).split()
NUMERIC_FIELDS = ("status", "body_bytes_sent")

# Columns that make a request what it is: the rest is derived from these.
REQUEST_KEY = [name for name in FIELDS if name != "gzip_ratio"]


def is_request(line: Column) -> Column:
    return line.rlike(LINE)


def split_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """All groups of every matching line, as text; other lines are left out.

    The pattern runs once per line: it rewrites the line to its groups, one per
    row of text, which a single split takes apart. A line holds no line feed, so
    the separator cannot occur inside a field. The one-element explode keeps the
    optimizer from copying that expression into each of the eleven columns.
    """
    groups = "\n".join(f"${i}" for i in range(1, len(FIELDS) + 1))
    fields = F.split(F.regexp_replace(F.col(value), LINE + r"[\s\S]*", groups), "\n")
    return (
        lines.select(F.explode(F.array(fields)).alias("field"))
        .filter(F.size("field") == len(FIELDS))
        .select(*[F.get("field", i).alias(name) for i, name in enumerate(FIELDS)])
    )


def type_fields(fields: DataFrame) -> DataFrame:
    """Numbers as int (NULL when out of range); the gzip ratio is dropped."""
    numbers = {c: F.col(c).try_cast("int") for c in NUMERIC_FIELDS}
    return fields.withColumns(numbers).drop("gzip_ratio")


def add_date_parts(requests: DataFrame) -> DataFrame:
    """``date`` and ``time`` text, placed after ``date_time``."""
    after = requests.columns.index("date_time") + 1
    stamp = F.col("date_time")
    return requests.select(
        *requests.columns[:after],
        times.log_date(stamp).alias("date"),
        times.log_clock(stamp).alias("time"),
        *requests.columns[after:],
    )


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The 12-column request table."""
    return add_date_parts(type_fields(split_lines(lines, value)))


def line_outcome(lines: DataFrame, value: str = "value") -> DataFrame:
    """``outcome`` of every line: rejected, incomplete, bad date or accepted.

    The first that applies. A rejected line does not have the format, an incomplete
    one misses a field, a bad date is not a time. Copies are counted each.
    """
    whole = F.regexp_replace(F.col(value), LINE + r"[\s\S]*", "\n".join(f"${i}" for i in range(1, len(FIELDS) + 1)))
    parts = lines.select(F.explode(F.array(F.split(whole, "\n"))).alias("field"))
    fields = type_fields(
        parts.select("field", *[F.get("field", i).alias(name) for i, name in enumerate(FIELDS)])
    )
    missing = reduce(or_, [is_missing(f) for f in fields.schema.fields if f.name != "field"])
    outcome = (
        F.when(F.size("field") != len(FIELDS), "rejected")
        .when(missing, "incomplete")
        .when(times.log_timestamp(F.col("date_time")).isNull(), "bad date")
        .otherwise("accepted")
    )
    return fields.select(outcome.alias("outcome"))


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.filter(~is_request(F.col(value)))
