"""Volume and token profile of the merged table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hitlens.operators.counts import token_profile, volume_by
from hitlens.operators.runlog import now_text, run_log
from hitlens.operators.sketches import daily_profile, latest, merged_profile, store_run
from hitlens.sinks.writers import write_report
from hitlens.sources.readers import read_table


def run(spark: SparkSession, ground_truth: str, report: str, state: str | None = None) -> None:
    """Volumes of the given table and its token profile.

    With ``state``, a folder of daily sums and sketches, the days read are stored there (instead of what it has of
    them) and the profile covers all days stored; its distinct count is then an estimate.
    """
    start = now_text()
    requests = read_table(spark, ground_truth)
    base = report.rstrip("/")
    write_report(volume_by(requests, "date"), f"{base}/byDate")
    write_report(volume_by(requests, "date", "domain_category"), f"{base}/byDateDomain")
    if state:
        profile = merged_profile(latest(store_run(daily_profile(requests), state), "day"))
    else:
        profile = token_profile(requests)
    profile = profile.first().asDict()
    entries = [("Start", start), ("End", now_text()), *profile.items()]
    write_report(run_log(spark, entries), f"{base}/general")
