"""Access log lines derived from the ``events`` and ``pages`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.operators.enrich import UNKNOWN, add_domain_category
from hitlens.plans.extract import requests
from hitlens.session import land

SITES = 5

# Given schemas spare each query the jobs that read them from the files.
PAGES = "page_id bigint, url string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"

HARD_URI = "/5f43a1b2c3d4e5f6a7b8c9d0/%zz?k=v=w+x&%6Bey=100%&n"

LINE = """concat(
  '10.', cast(user_id % 256 AS string), '.', cast(event_id % 256 AS string), '.7 - - [',
  date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "',
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT'
                  WHEN 'error' THEN 'HEAD' ELSE 'GET' END, ' ',
  regexp_replace(url, '^[a-z]+://[^/]+', ''),
  CASE WHEN event_id % 5 = 0 THEN '%20x%C3%B1' ELSE '' END, ' HTTP/1.1" ',
  CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 17 = 0 THEN '404' ELSE '200' END, ' ',
  cast(cast(round(value * 100) AS int) AS string), ' "',
  CASE WHEN event_id % 11 = 0 THEN '-' ELSE url END,
  '" "Mozilla/5.0 (u', cast(user_id % 9 AS string), ')"')"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event, and beside it repeated lines, lines that do not parse, that have no such date, no
    agent, no referer, another kind of address, another time zone, or a URI of escapes that are none, an
    identifier, a plus, a second ``=`` and a key without value.

    Page ids must be dense from 0, as they are in the given tables: an event takes the
    page of its number's remainder.
    """
    pages = spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet")
    count = pages.count()
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    paired = events.withColumn("page_id", F.col("event_id") % count).join(pages, "page_id")
    line, number = F.col("line"), F.col("event_id")
    variants = F.array(
        line,
        F.when(number % 13 == 0, line),
        F.when(number % 26 == 0, F.concat(line, F.lit(" 5"))),
        F.when(number % 19 == 0, F.replace(line, F.lit('"'), F.lit(""))),
        F.when(number % 23 == 0, F.regexp_replace(line, r"\[[^\]]*\]", "[31/Feb/2024:10:00:00 +0000]")),
        F.when(number % 29 == 0, F.regexp_replace(line, '"Mozilla[^"]*"', '"NaN"')),
        F.when(number % 31 == 0, F.regexp_replace(line, "^[0-9.]+", "2001:db8::1")),
        F.when(number % 37 == 0, F.replace(line, F.lit(" HTTP/1.1"), F.lit(f"{HARD_URI} HTTP/1.1"))),
        F.when(number % 41 == 0, F.replace(line, F.lit("+0000]"), F.lit("-0230]"))),
        F.when(number % 43 == 0, F.regexp_replace(line, '"[^"]*" "Mozilla', '"" "Mozilla')),
    )
    return (
        paired.select("event_id", F.expr(LINE).alias("line"))
        .select(F.explode(variants).alias("value"))
        .filter("value IS NOT NULL")
    )


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(log_lines(spark, sf_dir))


def top_sites(table: DataFrame, count: int = SITES) -> DataFrame:
    """The ``count`` most frequent known referer domains, most frequent first."""
    known = table.filter(F.col("domain") != UNKNOWN).groupBy("domain").count()
    return known.orderBy(F.desc("count"), "domain").limit(count).select("domain")


def stored_extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The stored 21-column request table and its registered sites."""
    stored = land(log_requests(spark, sf_dir), "requests")
    sites = [row.domain for row in top_sites(stored).collect()]
    return add_domain_category(stored, sites), sites
