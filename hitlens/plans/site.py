"""Site classifier: train on registered traffic, classify the rest, merge both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.operators.clean import union_strict
from hitlens.operators.classify import fit_classifier
from hitlens.operators.enrich import OTHER
from hitlens.operators.features import SITE_BUCKETS, site_features
from hitlens.operators.metrics import (
    TRAIN_TENTHS,
    classifier_metrics,
    confusion_matrix,
    confusion_pivot,
    split_bucket,
)
from hitlens.operators.parse import REQUEST_KEY
from hitlens.operators.runlog import now_text, run_log, stored_rows, volume_text
from hitlens.operators.stages import site_pipeline
from hitlens.session import land
from hitlens.sinks.writers import save_model, write_partitioned, write_report
from hitlens.sources.readers import (
    load_category_models,
    load_classifier,
    load_indexer,
    load_pipeline,
    read_partition,
    read_table,
)

# The columns of each stored table.
TRAIN_COLUMNS = (
    "fabstime day_of_week body_bytes_sent clean_path clean_query_list domain_category method domain"
).split()
EXTRACT_COLUMNS = (
    "remote_addr remote_usr date_time date time method req_uri http_ver status body_bytes_sent "
    "http_referer user_agent dec_req_uri clean_path clean_query_list domain fdate_time "
    "dateunixtimest fabstime day_of_week"
).split()
PREDICTED_COLUMNS = EXTRACT_COLUMNS + (
    "method_index method_onehot probability prediction prediction_domain"
).split()


@dataclass
class SiteModels:
    methods: StringIndexerModel
    encoder: OneHotEncoderModel
    classes: StringIndexerModel
    classifier: LogisticRegressionModel | None = None


def labelled_features(
    requests: DataFrame, models: SiteModels, buckets: int = SITE_BUCKETS
) -> DataFrame:
    """Features and class of registered traffic, with the request key."""
    known = requests.filter(F.col("domain_category") != OTHER)
    columns = list(dict.fromkeys(TRAIN_COLUMNS + REQUEST_KEY))
    classes = models.classes.setInputCol("domain_category").setOutputCol("domain_index")
    indexed = classes.transform(known.select(columns))
    featured = site_features(indexed, models.methods, models.encoder, buckets=buckets)
    return featured.select("domain_index", "features", *REQUEST_KEY)


def train(
    requests: DataFrame,
    models: SiteModels,
    seed: int = 123,
    max_iter: int = 100,
    buckets: int = SITE_BUCKETS,
    tasks: int | None = None,
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Classifier and its predictions on the hold-out rows.

    The features are stored once, because every iteration of the fit reads them.
    Every iteration sums a dense gradient per task; ``tasks`` merges the stored
    partitions into so many, for small data that has more partitions than it needs.
    """
    featured = labelled_features(requests, models, buckets).select(
        "domain_index", "features", split_bucket(REQUEST_KEY, seed).alias("bucket")
    )
    stored = land(featured, "site-features")
    training = stored.filter(F.col("bucket") < TRAIN_TENTHS).drop("bucket")
    if tasks is not None:
        training = training.coalesce(tasks)
    test = stored.filter(F.col("bucket") >= TRAIN_TENTHS)
    classifier = fit_classifier(training, max_iter=max_iter)
    return classifier, classifier.transform(test).select("domain_index", "prediction")


def pipeline(
    models: SiteModels, threshold: float = 0.70, buckets: int = SITE_BUCKETS
) -> PipelineModel:
    """Everything prediction needs, as one object that can be stored."""
    labels = models.classes.labels
    return site_pipeline(models.methods, models.encoder, models.classifier, labels, threshold, buckets=buckets)


def apply_pipeline(requests: DataFrame, stored: PipelineModel) -> DataFrame:
    """The 25-column prediction table of unregistered traffic; unseen methods are skipped."""
    unknown = requests.filter(F.col("domain_category") == OTHER)
    return stored.transform(unknown).select(PREDICTED_COLUMNS)


def predict(
    requests: DataFrame, models: SiteModels, threshold: float = 0.70, buckets: int = SITE_BUCKETS
) -> DataFrame:
    return apply_pipeline(requests, pipeline(models, threshold, buckets))


def ground_truth(requests: DataFrame, predicted: DataFrame) -> DataFrame:
    """Registered traffic and classified traffic as one 21-column table."""
    known = requests.filter(F.col("domain_category") != OTHER)
    classified = predicted.select(*EXTRACT_COLUMNS, "prediction_domain")
    return union_strict(known, classified.withColumnRenamed("prediction_domain", "domain_category"))


def _models(metadata: str, classifier: str | None = None) -> SiteModels:
    methods, encoder = load_category_models(metadata, "method")
    classes = load_indexer(metadata, "domain_category")
    return SiteModels(
        methods, encoder, classes, load_classifier(classifier) if classifier else None
    )


def run_train(
    spark: SparkSession, extracted: str, metadata: str, output: str, report: str, run_id: str
) -> dict[str, float]:
    """Train, store the model and the whole pipeline under ``run_id``, report the confusion matrix and metrics."""
    start = now_text()
    known = read_partition(spark, extracted, "domain_category", OTHER, equal=False)
    models = _models(metadata)
    classifier, tested = train(known, models)
    base = f"{output.rstrip('/')}/{run_id}"
    save_model(classifier, f"{base}/model_domain_classifier", overwrite=False)
    models.classifier = classifier
    save_model(pipeline(models), f"{base}/model_pipeline", overwrite=False)
    matrix = land(confusion_matrix(tested), "confusion")
    write_report(matrix, f"{base}/confusion_matrix_raw")
    classes = range(len(models.classes.labels))
    write_report(confusion_pivot(matrix, classes), f"{base}/confusion_matrix_counts")
    write_report(confusion_pivot(matrix, classes, "percentage"), f"{base}/confusion_matrix_shares")
    quality = classifier_metrics(matrix).first().asDict()
    entries = [("Start", start), ("End", now_text()), *quality.items()]
    write_report(run_log(spark, entries), f"{report.rstrip('/')}/{run_id}")
    return quality


def run_predict(
    spark: SparkSession,
    extracted: str,
    metadata: str | None,
    classifier: str | None,
    output: str,
    report: str,
    threshold: float | None = None,
    mode: str = "error",
    stored: str | None = None,
) -> None:
    """Classify unregistered traffic by the pipeline ``stored``, or by ``classifier`` with the models in ``metadata``.

    The threshold is 0.70, or that of the pipeline, unless one is given.
    """
    start, before = now_text(), stored_rows(spark, output)
    unknown = read_partition(spark, extracted, "domain_category", OTHER)
    chain = load_pipeline(stored) if stored else pipeline(_models(metadata, classifier))
    if threshold is not None:
        chain.stages[-1].set(chain.stages[-1].threshold, threshold)
    table = apply_pipeline(unknown, chain)
    write_partitioned(table, output, "prediction_domain", mode)
    rows = stored_rows(spark, output) - (before if mode == "append" else 0)
    entries = [
        ("Start", start),
        ("End", now_text()),
        ("Volume", volume_text(rows, len(table.columns))),
        ("Skipped methods", unknown.count() - rows),
    ]
    write_report(run_log(spark, entries), report)


def run_merge(
    spark: SparkSession,
    extracted: str,
    predicted: str,
    output: str,
    report: str,
    mode: str = "error",
) -> None:
    start, before = now_text(), stored_rows(spark, output)
    table = ground_truth(read_table(spark, extracted), read_table(spark, predicted))
    write_partitioned(table, output, "domain_category", mode)
    rows = stored_rows(spark, output) - (before if mode == "append" else 0)
    volume = volume_text(rows, len(table.columns))
    write_report(
        run_log(spark, [("Start", start), ("End", now_text()), ("Volume", volume)]), report
    )
