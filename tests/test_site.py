"""Classifier, metrics and the whole chain of jobs."""

import os

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SMALL
from hitlens.__main__ import arguments, main
from hitlens.operators import categories, enrich, metrics
from hitlens.operators.parse import REQUEST_KEY
from hitlens.plans import site
from hitlens.session import shared_folder
from registry.access_log import log_lines


def predictions(spark, pairs):
    return spark.createDataFrame(
        [(float(a), float(b)) for a, b in pairs], "domain_index double, prediction double"
    )


def test_metrics_equal_the_evaluator(spark):
    table = predictions(
        spark, [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)] * 2 + [(1, 3)] + [(2, 2)]
    )
    got = metrics.classifier_metrics(metrics.confusion_matrix(table)).first()
    for name, metric in [
        ("accuracy", "accuracy"),
        ("weighted_precision", "weightedPrecision"),
        ("weighted_recall", "weightedRecall"),
        ("weighted_f1", "f1"),
    ]:
        evaluator = MulticlassClassificationEvaluator(labelCol="domain_index", metricName=metric)
        assert got[name] == pytest.approx(evaluator.evaluate(table))


def test_pivot_fills_missing_cells(spark):
    matrix = metrics.confusion_matrix(predictions(spark, [(0, 0), (1, 0), (1, 0)]))
    pivot = metrics.confusion_pivot(matrix, [0, 1]).orderBy("domain_index").collect()
    assert [tuple(r) for r in pivot] == [(0, 1, 0), (1, 2, 0)]


@pytest.mark.parametrize(
    "probability, wanted",
    [([0.71, 0.29], "a"), ([0.7, 0.3], "other"), ([0.5, 0.5], "other"), ([0.1, 0.9], "b")],
)
def test_accept_class(spark, probability, wanted):
    table = spark.createDataFrame([(probability,)], "p array<double>")
    assert table.select(enrich.accept_class(F.col("p"), ["a", "b"])).first()[0] == wanted


def test_first_of_equal_maxima_wins(spark):
    table = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    assert table.select(enrich.accept_class(F.col("p"), ["a", "b"], 0.4)).first()[0] == "a"


def test_split_ignores_partitioning(spark, extracted):
    table = extracted[0]
    one, _ = metrics.holdout_split(table.repartition(1), REQUEST_KEY)
    many, rest = metrics.holdout_split(table.repartition(7), REQUEST_KEY)
    assert one.exceptAll(many).isEmpty()
    assert one.count() + rest.count() == table.count()
    assert 0.75 < one.count() / table.count() < 0.85


def test_unseen_methods(spark):
    seen = spark.createDataFrame([("GET",), ("GET",), ("POST",)], "method string")
    indexer = categories.fit_indexer(seen, "method")
    encoder = categories.fit_encoder(indexer.transform(seen), "method")
    new = spark.createDataFrame([("GET",), ("BREW",)], "method string")
    assert categories.encode(new, indexer, encoder, "skip").count() == 1
    with pytest.raises(Exception, match="BREW"):
        categories.encode(new, indexer, encoder).collect()


def test_small_classifier(spark, extracted):
    table, sites = extracted
    registered = table.filter("domain_category <> 'other'")
    methods = categories.fit_indexer(table, "method")
    models = site.SiteModels(
        methods,
        categories.fit_encoder(methods.transform(table), "method"),
        categories.fit_indexer(registered, "domain_category"),
    )
    models.classifier, tested = site.train(table, models, max_iter=5, buckets=256)
    assert models.classes.labels == sites
    assert tested.count() > 0
    predicted = site.predict(table, models, buckets=256)
    assert predicted.columns == site.PREDICTED_COLUMNS
    assert predicted.count() == table.filter("domain_category = 'other'").count()
    named = {r.prediction_domain for r in predicted.select("prediction_domain").distinct().collect()}
    assert named <= {*sites, "other"}
    merged = site.ground_truth(table, predicted)
    assert merged.columns == table.columns
    assert merged.count() == table.count()


def test_all_jobs(spark, extracted, tmp_path):
    """Raw text to published rows through the command line."""
    sites = extracted[1]
    p = {n: str(tmp_path / n) for n in (
        "logs extract meta train predict merged detect forest index report".split()
    )}
    log_lines(spark, SMALL).write.text(f"{p['logs']}/2024/01")
    main(["extract", "--logs", p["logs"], "--output", p["extract"], "--metadata", p["meta"],
          "--report", p["report"] + "/1", "--domains", *sites])
    table = spark.read.parquet(p["extract"])
    assert len(table.columns) == 21
    main(["train", "--extracted", p["extract"], "--metadata", p["meta"], "--output", p["train"],
          "--report", p["report"] + "/2", "--run-id", "r1"])
    main(["predict", "--extracted", p["extract"], "--metadata", p["meta"], "--classifier",
          p["train"] + "/r1/model_domain_classifier", "--output", p["predict"],
          "--report", p["report"] + "/3"])
    main(["predict", "--extracted", p["extract"], "--pipeline", p["train"] + "/r1/model_pipeline",
          "--output", p["predict"] + "2", "--report", p["report"] + "/9"])
    parts, whole = (spark.read.parquet(p["predict"] + end) for end in ("", "2"))
    assert whole.columns == parts.columns and len(parts.columns) == 25
    assert whole.count() == parts.count()
    assert whole.exceptAll(parts).isEmpty()
    main(["merge", "--extracted", p["extract"], "--predicted", p["predict"], "--output",
          p["merged"], "--report", p["report"] + "/4"])
    merged = spark.read.parquet(p["merged"])
    assert merged.count() == table.count()
    assert sorted(merged.columns) == sorted(table.columns)
    for one in (sites[0], sites[1]):
        main(["detect", "--ground-truth", p["merged"], "--output", p["detect"], "--model",
              p["forest"], "--report", p["report"] + "/5" + one, "--sites", one,
              "--detector", "first"])
    main(["detect", "--ground-truth", p["merged"], "--output", p["detect"] + "2", "--model",
          p["forest"], "--report", p["report"] + "/7", "--detector", "first", "--use-model",
          "--listing", p["report"] + "/8", "--top", "3"])
    listed = spark.read.option("header", "true").csv(p["report"] + "/8")
    assert {r[0] for r in listed.select("domain_category").collect()} == set(sites[:2])
    assert all(r["count"] <= 3 for r in listed.groupBy("domain_category").count().collect())
    reused = spark.read.parquet(p["detect"] + "2")
    assert reused.count() == merged.count()
    assert reused.filter(~F.col("domain_category").isin(sites[:2]) & F.col("outlierScore").isNotNull()).isEmpty()
    found = spark.read.parquet(p["detect"])
    scores = ["dec_req_uri", "es_time", "outlierScore", "anomaly_bool"]
    assert found.select(scores).exceptAll(reused.select(scores)).isEmpty()
    assert {r[0] for r in found.select("domain_category").distinct().collect()} == set(sites[:2])
    main(["publish", "--detected", p["detect"], "--target", p["index"]])
    assert spark.read.json(p["index"]).count() == found.count()
    main(["profile", "--ground-truth", p["merged"], "--report", p["report"] + "/6"])
    volume = {
        r.Metric: r.Value
        for r in spark.read.option("header", "true").csv(p["report"] + "/1").collect()
    }
    assert volume["Volume"] == f"{table.count()}, 21"
    assert min(int(volume[name]) for name in ("Rejected", "Incomplete", "Bad dates")) > 0
    left = shared_folder(spark).removeprefix("file:") + "/hitlens/" + spark.sparkContext.applicationId
    assert not [name for name in os.listdir(left) if name.startswith("job-")]
    by_date = spark.read.option("header", "true").csv(p["report"] + "/6/byDate")
    assert by_date.selectExpr("sum(count)").first()[0] == merged.count()


def test_missing_arguments_end_before_a_session():
    with pytest.raises(SystemExit):
        arguments().parse_args(["predict", "--extracted", "x"])
    with pytest.raises(SystemExit):
        main(["predict", "--extracted", "x", "--output", "y", "--report", "z", "--classifier", "c"])
