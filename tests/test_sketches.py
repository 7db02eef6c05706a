"""Sketches and sums that are stored per day and merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from hitlens.operators import counts, forest, sketches
from hitlens.plans import detect, profile
from hitlens.session import land

REQUESTS = "date string, clean_path string"


def scores(spark):
    rng = np.random.default_rng(6)
    groups = {"even": rng.random(30_000), "ties": np.repeat([0.1, 0.5, 0.9], 4000), "one": np.array([0.25])}
    rows = [(g, k % 5, float(v)) for g, values in groups.items() for k, v in enumerate(rng.permutation(values))]
    rows += [("even", 1, None), ("even", 1, float("nan")), (None, 1, 0.5)]
    return groups, land(spark.createDataFrame(rows, "site string, day int, outlierScore double"), "scores")


@pytest.mark.parametrize("error", [0.05, 0.01, 0.002])
def test_merged_thresholds_keep_the_error(spark, error):
    groups, table = scores(spark)
    made = sketches.score_sketches(table, "site", "day", size=sketches.sketch_size(error))
    limits = sketches.sketch_thresholds(land(made, "days"), "site", 0.05).collect()
    assert {r.forest_group for r in limits} == set(groups)
    for row in limits:
        values = groups[row.forest_group]
        assert row.threshold in values
        # The ranks of the value found reach into the allowed ones.
        below, upto = (values < row.threshold).mean(), (values <= row.threshold).mean()
        assert below <= 0.95 + error and upto >= 0.95 - error


def test_sketch_sizes():
    assert sketches.sketch_size(0.0) is None and sketches.sketch_size(1e-6) is None
    sizes = [sketches.sketch_size(e) for e in (0.9, 0.05, 0.01, 0.001)]
    assert sizes == sorted(sizes) and sizes[0] == sketches.LEAST_K


def test_one_scan_for_thresholds(spark):
    _, table = scores(spark)
    plan = plan_of(sketches.score_sketches(table, "site"))
    assert plan.count("FileScan") == 1 and "day" not in plan


def test_detector_uses_sketches_and_history(spark, extracted, tmp_path):
    table = extracted[0]
    small = detect.Detector(trees=20, samples=32, buckets=64)
    days = sorted(r[0] for r in table.select(F.to_date("fdate_time")).distinct().collect())
    half = days[len(days) // 2]
    day = F.to_date("fdate_time")
    model = land(detect.fit(table, small), "forest")
    other = land(detect.fit(table, detect.Detector(trees=5, samples=8, buckets=64)), "forest")
    path = str(tmp_path / "history")
    detect.detect(table.filter(day < half), small, forest=other, history=path)
    for part in (day < half, day < half, day >= half):
        found, _ = detect.detect(table.filter(part), small, forest=model, history=path)
    whole, _ = detect.score(table, small, forest=model)
    stored = spark.read.parquet(path)
    marks = detect.forest_marks(model)
    merged = sketches.latest(stored.join(marks, [detect.SITE, "forest"], "left_semi"), detect.SITE, "day")
    rows = {r[0]: r[1] for r in merged.groupBy(detect.SITE).agg(F.sum("n")).collect()}
    assert rows == {r[0]: r[1] for r in whole.groupBy(detect.SITE).count().collect()}
    limits = {r.forest_group: r.threshold for r in sketches.sketch_thresholds(merged, detect.SITE, 0.05).collect()}
    for site, values in whole.groupBy(detect.SITE).agg(F.collect_list("outlierScore")).collect():
        values = np.array(values)
        assert (values < limits[site]).mean() <= 0.95 + 0.01 and (values <= limits[site]).mean() >= 0.95 - 0.01
    assert found.columns == detect.OUTPUT_COLUMNS
    with pytest.raises(ValueError, match="allowed error"):
        detect.thresholds(whole, detect.Detector(error=0.0), model, path)


def test_marks_do_not_depend_on_order(spark, extracted):
    model = land(detect.fit(extracted[0], detect.Detector(trees=5, samples=8, buckets=16)), "forest")
    assert set(model.columns) == set(forest.NODES.names)
    one, two = detect.forest_marks(model), detect.forest_marks(model.repartition(7))
    assert sorted(one.collect()) == sorted(two.collect())


def test_merged_days_equal_one_run(spark):
    rows = [(f"d{k % 4}", f"/a/{'x' * (k % 9)}/{k % 37}") for k in range(500)]
    table = spark.createDataFrame([*rows, ("d9", ""), ("d9", None), (None, "/no/day")], REQUESTS)
    got = sketches.merged_profile(sketches.daily_profile(table.repartition(5))).first().asDict()
    wanted = counts.token_profile(table).first().asDict()
    assert abs(got.pop("unique_words") - wanted["unique_words"]) <= 0.05 * wanted.pop("unique_words")
    assert got.keys() == wanted.keys()
    for name, value in wanted.items():
        assert got[name] == pytest.approx(value, rel=1e-12), name


@pytest.mark.parametrize("rows", [[], [("d", None)], [("d", "alone")]])
def test_small_profiles(spark, rows):
    table = spark.createDataFrame(rows, REQUESTS)
    got = sketches.merged_profile(sketches.daily_profile(table)).first().asDict()
    assert got == counts.token_profile(table).first().asDict()


def test_profile_job_keeps_days(spark, tmp_path):
    """Days are added run by run; a day that is read again replaces what was stored of it."""
    paths = {"d1": ["/a/b", "/c"], "d2": ["/a/bbbb"]}
    state, report = str(tmp_path / "state"), str(tmp_path / "report")

    def go(*days):
        rows = [(d, p, "s") for d in days for p in paths[d]]
        given = str(tmp_path / f"given-{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, REQUESTS + ", domain_category string").write.parquet(given)
        profile.run(spark, given, report, state)
        log = spark.read.option("header", "true").csv(f"{report}/general")
        return {r.Metric: r.Value for r in log.collect()}

    assert go("d1")["max_word_length"] == "1"
    assert go("d2")["max_word_length"] == "4"
    paths["d2"] = ["/a/bb", "/a/bb"]
    last = go("d2")
    assert last["max_word_length"] == "2" and last["unique_words"] == "5"
