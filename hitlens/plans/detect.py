"""Anomaly detection for every site, and publishing of the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.operators.embed import embed_paths
from hitlens.operators.features import assemble, detect_columns, detect_features
from hitlens.operators.forest import (
    NODES,
    fit_forest,
    label_anomalies,
    score_forest,
    score_thresholds,
)
from hitlens.operators.listing import highest
from hitlens.operators.parse import REQUEST_KEY
from hitlens.operators.runlog import now_text, run_log, volume_text
from hitlens.operators.sketches import latest, score_sketches, sketch_size, sketch_thresholds, store_run
from hitlens.session import broadcast_if_small, land, require_utc
from hitlens.sinks.writers import publish, write_partitioned, write_report
from hitlens.sources.readers import read_table

SITE = "domain_category"

# The columns read and written.
INPUT_COLUMNS = (
    "method status body_bytes_sent http_referer user_agent dec_req_uri clean_path "
    "clean_query_list domain fdate_time fabstime day_of_week domain_category"
).split()
EMBEDDED_FEATURES = ["fabstime", "status", "body_bytes_sent", "url_embedding"]
LISTED_COLUMNS = (
    "domain_category outlierScore es_time method status body_bytes_sent http_referer user_agent dec_req_uri"
).split()
OUTPUT_COLUMNS = INPUT_COLUMNS + ["es_time", "query_len", "outlierScore", "anomaly_bool"]


@dataclass(frozen=True)
class Detector:
    """Parameters of a detector; the defaults are the final ones."""

    trees: int = 1000
    samples: int = 512
    buckets: int = 512
    contamination: float = 0.05
    error: float = 0.01
    classify_tokens: bool = True
    seed: int = 1


# Trees, samples, hash buckets, contamination and its error.
FINAL = Detector()
FIRST = Detector(100, 256, 2040, 0.02, 0.0, classify_tokens=False)


def token_features(detector: Detector) -> Callable[[DataFrame], DataFrame]:
    """Adds the detector's ``features``: scalars and hashed URL tokens."""
    return lambda requests: detect_features(
        requests, detector.buckets, detector.classify_tokens
    )


def embedding_features(vectors: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``features`` of scalars and the mean word vector of the URL tokens."""

    def prepare(requests: DataFrame) -> DataFrame:
        embedded = embed_paths(detect_columns(requests), vectors)
        return assemble(embedded, EMBEDDED_FEATURES).drop("url_features", "url_embedding")

    return prepare


def fit(
    requests: DataFrame,
    detector: Detector = FINAL,
    features: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Forest of every site; features are computed for the drawn rows only."""
    require_utc(requests.sparkSession)
    return fit_forest(
        requests,
        SITE,
        REQUEST_KEY,
        num_trees=detector.trees,
        max_samples=detector.samples,
        seed=detector.seed,
        prepare=features or token_features(detector),
    )


def score(
    requests: DataFrame,
    detector: Detector = FINAL,
    features: Callable[[DataFrame], DataFrame] | None = None,
    forest: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scored requests (features dropped) and the forest, both stored.

    With ``forest``, a stored node table, nothing is fitted.
    """
    features = features or token_features(detector)
    if forest is None:
        forest = land(fit(requests, detector, features), "forest")
    featured = features(requests.select(INPUT_COLUMNS))
    keep = [name for name in featured.columns if name != "features"]
    return score_forest(featured, forest, SITE, keep=keep), forest


def forest_marks(forest: DataFrame) -> DataFrame:
    """One number per site that tells its forest from others, in whatever order its nodes are read."""
    marks = forest.select(*NODES.names).groupBy(F.col("forest_group").alias(SITE))
    return marks.agg(F.bit_xor(F.xxhash64(*NODES.names)).alias("forest"))


def thresholds(
    scored: DataFrame, detector: Detector, forest: DataFrame, history: str | None = None
) -> DataFrame:
    """The score from which requests of a site are anomalies.

    Without an allowed error it is exact. With one, scores go into a sketch per site in one pass; under
    ``history`` the sketches of each day are kept, and those of earlier days count too if they
    were made with the same forest. A run replaces the days it covers.
    """
    size = sketch_size(detector.error)
    if size is None:
        if history:
            raise ValueError("a history of scores needs a detector with an allowed error of 0.0001 or more")
        return score_thresholds(scored, SITE, contamination=detector.contamination, bounds=(0.0, 1.0))
    if not history:
        return sketch_thresholds(score_sketches(scored, SITE, size=size), SITE, detector.contamination)
    dated = scored.withColumn("day", F.to_date("fdate_time"))
    marks = broadcast_if_small(land(forest_marks(forest), "forest-marks"))
    made = land(score_sketches(dated, SITE, "day", size=size).join(marks, SITE), "score-sketches")
    stored = store_run(made, history).join(marks, [SITE, "forest"], "left_semi")
    return sketch_thresholds(latest(stored, SITE, "day"), SITE, detector.contamination)


def detect(
    requests: DataFrame,
    detector: Detector = FINAL,
    features: Callable[[DataFrame], DataFrame] | None = None,
    forest: DataFrame | None = None,
    history: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The 17-column detection table and the forest behind it, a new one unless one is given."""
    scored, forest = score(requests, detector, features, forest)
    limits = thresholds(scored, detector, forest, history)
    return label_anomalies(scored, limits, SITE).select(OUTPUT_COLUMNS), forest


def anomaly_listing(detected: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` anomalies of highest score of every site; equal scores in order of the other columns."""
    ties = [c for c in LISTED_COLUMNS if c not in (SITE, "outlierScore")]
    found = detected.filter("anomaly_bool").select(*LISTED_COLUMNS)
    return highest(found, SITE, "outlierScore", k, ties)


def run(
    spark: SparkSession,
    ground_truth: str,
    output: str,
    model: str,
    report: str,
    sites: Sequence[str] | None = None,
    detector: Detector = FINAL,
    use_model: bool = False,
    listing: str | None = None,
    top: int = 20,
    history: str | None = None,
) -> None:
    """Detect for the given sites, or for all in one pass.

    With ``history``, a folder of score sketches by day, thresholds also follow the scores of earlier runs.

    With ``listing``, the ``top`` anomalies of each site are stored there as CSV.

    The forests are stored under ``model``; with ``use_model`` those stored there are
    applied. Requests of a site without a forest get no score; they are counted.
    """
    start = now_text()
    requests = read_table(spark, ground_truth)
    if sites:
        requests = requests.filter(F.col(SITE).isin(*sites))
    stored = None
    if use_model:
        stored = read_table(spark, model).withColumnRenamed(SITE, "forest_group").select(*NODES.names)
        if sites:
            stored = stored.filter(F.col("forest_group").isin(*sites))
    table, forest = detect(requests, detector, forest=stored, history=history)
    if not use_model:
        write_partitioned(forest.withColumnRenamed("forest_group", SITE), model, SITE, keep_others=True)
    # Counts of the run come from one stored result, not from tasks that may run twice.
    table = land(table, "detected")
    write_partitioned(table, output, SITE, keep_others=True)
    if listing:
        write_report(anomaly_listing(table, top), listing)
    found = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("anomaly_bool").alias("anomalies"),
        F.count_if(F.col("outlierScore").isNull()).alias("unscored"),
    ).first()
    entries = [
        ("Start", start),
        ("End", now_text()),
        (SITE, ", ".join(sites) if sites else "all"),
        ("Volume", volume_text(found["rows"], len(INPUT_COLUMNS))),
        ("Anomalies", found["anomalies"]),
        ("No forest", found["unscored"]),
    ]
    write_report(run_log(spark, entries), report)


def run_publish(spark: SparkSession, detected: str, target: str, fmt: str = "json") -> None:
    publish(read_table(spark, detected), target, fmt)
