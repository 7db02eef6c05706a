"""Raw log text to the stored request table, plus category models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.operators.categories import fit_encoder, fit_indexer
from hitlens.operators.clean import complete_rows, distinct_requests, unseen_rows
from hitlens.operators.enrich import OTHER, add_domain_category, add_time_columns, add_uri_columns
from hitlens.operators.parse import REQUEST_KEY, add_date_parts, line_outcome, split_lines, type_fields
from hitlens.operators.runlog import now_text, run_log, stored_rows, volume_text
from hitlens.session import land, require_utc
from hitlens.sinks.writers import save_category_models, write_partitioned, write_report
from hitlens.sources.readers import read_log_text, read_table


def requests(lines: DataFrame) -> DataFrame:
    """Typed, complete, distinct requests with URI and time columns (20 columns).

    Incomplete rows go before the distinct and derived columns come after it, so
    the one shuffle of the job carries nothing but the ten request fields. A row
    whose date is none is incomplete too.
    """
    require_utc(lines.sparkSession)
    fields = complete_rows(type_fields(split_lines(lines)))
    timed = add_time_columns(add_uri_columns(add_date_parts(distinct_requests(fields))))
    return timed.filter(F.col("fdate_time").isNotNull())


def extract(lines: DataFrame, domains: Sequence[str] | DataFrame) -> DataFrame:
    """The 21-column request table."""
    return add_domain_category(requests(lines), domains)


def append_requests(table: DataFrame, output: str) -> int:
    """Add the requests of ``table`` that ``output`` does not hold; the number of rows it held before.

    What is stored decides, so a run that is repeated, or was cut short, adds only what is missing. Two
    runs at once are not told apart. A request that is stored keeps the category it has there.
    """
    spark = table.sparkSession
    before = stored_rows(spark, output)
    if before:
        table = land(table, "extracted")
        table = unseen_rows(table, read_table(spark, output, table.schema), REQUEST_KEY, "dateunixtimest")
    write_partitioned(table, output, "domain_category", "append")
    return before


def run(
    spark: SparkSession,
    logs: str,
    output: str,
    metadata: str,
    report: str,
    domains: Sequence[str],
    mode: str = "error",
) -> DataFrame:
    """Store the request table once; models and counts come from the stored table.

    Logs of one day after the other are added with ``mode="append"``: requests that are
    stored are not added again, and each run's shuffles are a day's. The category models
    are those of everything stored.
    """
    start = now_text()
    lines = read_log_text(spark, logs)
    table = extract(lines, domains)
    before = 0
    if mode == "append":
        before = append_requests(table, output)
    else:
        write_partitioned(table, output, "domain_category", mode)
    stored = read_table(spark, output, table.schema)
    rows = stored_rows(spark, output) - before
    outcomes = {r.outcome: r["count"] for r in line_outcome(lines).groupBy("outcome").count().collect()}

    methods = fit_indexer(stored, "method")
    methods_onehot = fit_encoder(methods.transform(stored), "method")
    save_category_models(methods, methods_onehot, metadata, "method")
    # Classes are the registered sites: traffic of no known site has no class.
    registered = stored.filter(F.col("domain_category") != OTHER)
    sites = fit_indexer(registered, "domain_category")
    sites_onehot = fit_encoder(sites.transform(registered), "domain_category")
    save_category_models(sites, sites_onehot, metadata, "domain_category")
    entries = [
        ("Start", start),
        ("End", now_text()),
        ("Volume", volume_text(rows, len(table.columns))),
        ("Rejected", outcomes.get("rejected", 0)),
        ("Incomplete", outcomes.get("incomplete", 0)),
        ("Bad dates", outcomes.get("bad date", 0)),
    ]
    write_report(run_log(spark, entries), report)
    return stored
