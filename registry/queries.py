"""One query per operator. Arrays are joined to text so that engines compare alike."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.functions import times, tokens, uri
from hitlens.operators import categories, clean, counts, enrich, features, forest, metrics
from hitlens.operators import embed, parse, runlog, similar, sketches
from hitlens.plans import detect, extract, site
from hitlens.session import land, use_utc, work_path
from hitlens.sinks import writers
from hitlens.sources import readers
from registry.access_log import log_lines, log_requests, stored_extract, top_sites

QUERIES = {}


def query(function):
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return function(spark, str(sf_dir).rstrip("/"))

    QUERIES[function.__name__] = run
    return run


def joined(array, by: str = " | "):
    return F.array_join(array, by)


# Sources, parsing, cleaning


@query
def log_raw(spark, sf):
    path = work_path(spark, "log-text")
    log_lines(spark, sf).write.text(f"{path}/day/part")
    return readers.read_log_text(spark, path)


@query
def log_parse(spark, sf):
    return parse.parse_lines(log_lines(spark, sf))


@query
def log_dedup(spark, sf):
    return clean.distinct_requests(parse.parse_lines(log_lines(spark, sf)))


def _with_gaps(spark, sf):
    """Parsed requests with some fields blank or NaN."""
    size = F.col("body_bytes_sent")
    return parse.parse_lines(log_lines(spark, sf)).withColumns(
        {
            "user_agent": F.when(size % 7 == 0, "NaN").otherwise(F.col("user_agent")),
            "http_referer": F.when(size % 11 == 0, "  ").otherwise(F.col("http_referer")),
            "remote_usr": F.when(size % 13 == 0, "").otherwise(F.col("remote_usr")),
        }
    )


@query
def blank_to_null(spark, sf):
    return clean.blank_to_null(_with_gaps(spark, sf))


@query
def drop_incomplete(spark, sf):
    return clean.drop_incomplete(clean.blank_to_null(_with_gaps(spark, sf)))


# URI, time and token expressions


@query
def uri_decode(spark, sf):
    table = log_requests(spark, sf)
    return table.groupBy("req_uri", "dec_req_uri").agg(F.count("*").alias("requests"))


@query
def uri_path(spark, sf):
    return log_requests(spark, sf).select("date_time", "remote_addr", "dec_req_uri", "clean_path")


@query
def uri_query(spark, sf):
    return log_requests(spark, sf).select(
        "date_time",
        "remote_addr",
        F.size("clean_query_list").alias("pairs"),
        joined("clean_query_list").alias("clean_query_list"),
    )


@query
def referer_domain(spark, sf):
    referers = parse.parse_lines(log_lines(spark, sf)).select("http_referer")
    return (
        referers.withColumn("domain", uri.referer_domain(F.col("http_referer")))
        .groupBy("http_referer", "domain")
        .agg(F.count("*").alias("lines"))
    )


@query
def log_time(spark, sf):
    return log_requests(spark, sf).select(
        "date_time",
        "date",
        "time",
        "dateunixtimest",
        "fabstime",
        "day_of_week",
        times.index_time(F.col("fdate_time")).alias("es_time"),
    )


@query
def log_features(spark, sf):
    stored = land(log_requests(spark, sf), "requests")
    table = enrich.add_domain_category(stored, top_sites(stored))
    return table.drop("fdate_time").withColumn("clean_query_list", joined("clean_query_list"))


@query
def path_tokens(spark, sf):
    table = log_requests(spark, sf)
    url = tokens.url_tokens(F.col("clean_path"), F.col("clean_query_list"))
    return table.select("date_time", "remote_addr", joined(url).alias("url_features"))


@query
def agent_tokens(spark, sf):
    table = log_requests(spark, sf)
    words = tokens.agent_tokens(F.col("user_agent"))
    return table.select("user_agent", F.size(words).alias("words"), joined(words).alias("agent"))


@query
def query_keys(spark, sf):
    keys = tokens.query_keys(F.col("clean_query_list"))
    return log_requests(spark, sf).select("date_time", "remote_addr", joined(keys).alias("keys"))


@query
def query_values(spark, sf):
    values = tokens.query_values(F.col("clean_query_list"))
    cut = tokens.query_values_cut(F.col("clean_query_list"))
    return log_requests(spark, sf).select(
        "date_time", "remote_addr", joined(values).alias("values"), joined(cut).alias("cut_values")
    )


@query
def query_pairs(spark, sf):
    pairs = counts.explode_pairs(log_requests(spark, sf))
    return pairs.groupBy("query_key", "query_value").agg(F.count("*").alias("requests"))


@query
def path_normalise(spark, sf):
    table = log_requests(spark, sf)
    url = tokens.classify_tokens(tokens.url_tokens(F.col("clean_path"), F.col("clean_query_list")))
    return table.select("clean_path", joined(url).alias("url_features_regex"))


@query
def path_document(spark, sf):
    table = embed.add_path_tokens(log_requests(spark, sf))
    document = table.select(tokens.token_document(F.col("url_features")).alias("document"))
    return document.groupBy("document").agg(F.count("*").alias("requests"))


@query
def path_ngrams(spark, sf):
    table = features.add_path_ngrams(log_requests(spark, sf))
    return table.select(
        "date_time",
        "remote_addr",
        "clean_path",
        F.size("path_ngrams").alias("grams"),
        joined("path_ngrams").alias("path_ngrams"),
    )


@query
def token_counts(spark, sf):
    words = counts.explode_path_words(log_requests(spark, sf))
    return words.groupBy("word").agg(F.count("*").alias("tokens"))


# Selection, union, category


@query
def domain_category(spark, sf):
    stored = land(log_requests(spark, sf).select("date_time", "remote_addr", "domain"), "domains")
    return enrich.add_domain_category(stored, top_sites(stored)).select(
        "date_time", "remote_addr", "domain", "domain_category"
    )


@query
def path_contains(spark, sf):
    pairs = counts.explode_pairs(
        log_requests(spark, sf), keep=["domain", "clean_path"], keep_empty=True
    )
    chosen = pairs.filter(
        F.col("clean_path").contains("/en/")
        & (F.col("domain") != enrich.UNKNOWN)
        & F.col("query_param").isNotNull()
    )
    return counts.volume_by(chosen, "domain").withColumnRenamed("count", "pairs")


@query
def row_slice(spark, sf):
    table = log_requests(spark, sf).select("date_time", "remote_addr", "req_uri", "status")
    return clean.numbered_slice(table, ["date_time", "remote_addr", "req_uri"], 100, 120)


@query
def union_sparse(spark, sf):
    table = log_requests(spark, sf)
    error = F.col("status").cast("string").alias("error")
    errors = table.filter("status >= 500").select("date_time", "remote_addr", error)
    missing = table.filter("status = 404").select("date_time", "remote_addr", "clean_path")
    return clean.union_sparse(errors, missing)


# Volumes and profiles


@query
def volume_by_date(spark, sf):
    return counts.volume_by(log_requests(spark, sf), "date").withColumnRenamed("count", "requests")


@query
def volume_by_domain(spark, sf):
    table = log_requests(spark, sf)
    return counts.volume_by(table, "domain").withColumnRenamed("count", "requests")


@query
def volume_by_date_domain(spark, sf):
    table = log_requests(spark, sf)
    return counts.volume_by(table, "date", "domain").withColumnRenamed("count", "requests")


@query
def token_profile(spark, sf):
    profile = counts.token_profile(log_requests(spark, sf))
    return profile.select(
        "unique_words",
        "min_word_length",
        "max_word_length",
        F.round("avg_word_length", 6).alias("avg_word_length"),
        F.round("stddev_word_length", 6).alias("stddev_word_length"),
    )


def _rounded_sizes(profile):
    return profile.select(
        "min_array_length",
        "max_array_length",
        F.round("avg_array_length", 6).alias("avg_array_length"),
        F.round("stddev_array_length", 6).alias("stddev_array_length"),
    )


@query
def token_profile_weighted(spark, sf):
    return _rounded_sizes(counts.token_profile(log_requests(spark, sf)))


@query
def token_profile_merged(spark, sf):
    """Profile from stored days, of which one was stored twice."""
    table = land(log_requests(spark, sf), "requests")
    path = work_path(spark, "profiles")
    first = table.agg(F.min("date")).first()[0]
    sketches.store_run(sketches.daily_profile(table.filter(F.col("date") == first).limit(5)), path)
    stored = sketches.store_run(sketches.daily_profile(table), path)
    merged = sketches.merged_profile(sketches.latest(stored, "day"))
    exact = counts.token_profile(table).first().unique_words
    near = F.abs(F.col("unique_words") - exact) <= 0.05 * exact
    return merged.select(
        near.alias("unique_words_near"),
        "min_word_length",
        "max_word_length",
        F.round("avg_word_length", 6).alias("avg_word_length"),
        F.round("stddev_word_length", 6).alias("stddev_word_length"),
    )


@query
def path_size_profile(spark, sf):
    return _rounded_sizes(counts.path_size_profile(log_requests(spark, sf)))


@query
def job_log(spark, sf):
    table = log_requests(spark, sf)
    return runlog.volume_log(
        table, Errors=F.col("status") >= 500, Unknown=F.col("domain") == enrich.UNKNOWN
    )


# Sinks


@query
def partition_scan(spark, sf):
    table, sites = stored_extract(spark, sf)
    path = work_path(spark, "by-site")
    writers.write_partitioned(table, path, "domain_category")
    rows = readers.read_partition(spark, path, "domain_category", sites[0])
    return rows.select("date_time", "remote_addr", "method", "dec_req_uri", "domain_category")


@query
def partitioned_roundtrip(spark, sf):
    table, _ = stored_extract(spark, sf)
    path = work_path(spark, "by-site")
    writers.write_partitioned(table, path, "domain_category")
    stored = readers.read_table(spark, path, table.schema)
    return stored.drop("fdate_time").withColumn("clean_query_list", joined("clean_query_list"))


@query
def append_again(spark, sf):
    """Every other line is extracted first, then all lines are; the second run adds the rest only."""
    lines = land(log_lines(spark, sf), "lines")
    sites = [row.domain for row in top_sites(land(extract.requests(lines), "requests")).collect()]
    path, table = work_path(spark, "by-site"), extract.extract(lines, sites)
    extract.append_requests(extract.extract(lines.filter(F.crc32("value") % 2 == 0), sites), path)
    extract.append_requests(table, path)
    stored = readers.read_table(spark, path, table.schema)
    return stored.drop("fdate_time").withColumn("clean_query_list", joined("clean_query_list"))


@query
def csv_roundtrip(spark, sf):
    table, _ = stored_extract(spark, sf)
    path = work_path(spark, "report")
    writers.write_report(counts.volume_by(table, "date", "domain_category"), path)
    schema = "date string, domain_category string, requests bigint"
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(path)


def _with_byte_score(spark, sf):
    """Detector columns with a score that SQL can compute too: bytes over bytes + 1000."""
    table, sites = stored_extract(spark, sf)
    size = F.col("body_bytes_sent").cast("double")
    scored = features.detect_columns(table).withColumn("outlierScore", size / (size + 1000))
    return land(scored, "byte-score"), sites


@query
def anomaly_label(spark, sf):
    scored, _ = _with_byte_score(spark, sf)
    limits = forest.score_thresholds(scored, "domain_category", contamination=0.05)
    return forest.label_anomalies(scored, limits, "domain_category").select(
        "date_time", "remote_addr", "domain_category", "outlierScore", "anomaly", "anomaly_bool"
    )


@query
def anomaly_top(spark, sf):
    """The ten highest anomalies of every site."""
    scored, _ = _with_byte_score(spark, sf)
    limits = forest.score_thresholds(scored, "domain_category", contamination=0.05)
    labelled = forest.label_anomalies(scored, limits, "domain_category")
    return detect.anomaly_listing(labelled, 10)


@query
def publish_rows(spark, sf):
    scored, _ = _with_byte_score(spark, sf)
    limits = forest.score_thresholds(scored, "domain_category", contamination=0.05)
    labelled = forest.label_anomalies(scored, limits, "domain_category")
    path = work_path(spark, "index")
    writers.publish(labelled, path)
    return spark.read.schema(writers.select_published(labelled).schema).json(path)


@query
def detect_features(spark, sf):
    table = features.detect_columns(log_requests(spark, sf))
    return table.select(
        "date_time",
        "remote_addr",
        "es_time",
        "fabstime",
        "status",
        "body_bytes_sent",
        "query_len",
        joined("url_features").alias("url_features"),
    )


# Categories, split, evaluation


@query
def category_index(spark, sf):
    table = log_requests(spark, sf)
    return categories.category_index(table, "domain").select(
        "label", F.col("count").alias("requests"), F.col("index").alias("domain_index")
    )


@query
def category_index_skip(spark, sf):
    """Methods indexed on registered traffic without POST; POST is then unseen and skipped."""
    table, _ = stored_extract(spark, sf)
    seen = table.filter((F.col("domain_category") != enrich.OTHER) & (F.col("method") != "POST"))
    indexer = categories.fit_indexer(seen, "method").setHandleInvalid("skip")
    indexed = indexer.transform(table.filter(F.col("domain_category") == enrich.OTHER))
    return indexed.select("date_time", "remote_addr", "method", "method_index")


@query
def method_onehot(spark, sf):
    table, _ = stored_extract(spark, sf)
    indexer = categories.fit_indexer(table, "method")
    encoder = categories.fit_encoder(indexer.transform(table), "method")
    encoded = categories.encode(table, indexer, encoder)
    slots = F.transform(vector_to_array("method_onehot"), lambda v: v.cast("int").cast("string"))
    return encoded.groupBy("method", "method_index", joined(slots, "").alias("method_onehot")).agg(
        F.count("*").alias("requests")
    )


@query
def holdout_split(spark, sf):
    table, _ = stored_extract(spark, sf)
    train, test = metrics.holdout_split(table, parse.REQUEST_KEY)
    columns = ["date_time", "remote_addr", "req_uri"]
    return train.select(*columns, F.lit(True).alias("training")).union(
        test.select(*columns, F.lit(False).alias("training"))
    )


def _votes(table, sites):
    """Share of each site among registered training requests for the same path and query keys.

    A stand-in for model probabilities that SQL can compute as well. ``training`` says
    which rows the votes come from; the others are for evaluation.
    """
    keys = F.array_join(tokens.query_keys(F.col("clean_query_list")), "&")
    table = table.withColumns(
        {
            "page": F.concat_ws("|", "clean_path", keys),
            "training": metrics.split_bucket(parse.REQUEST_KEY, 123) < metrics.TRAIN_TENTHS,
        }
    )
    tally = (
        table.filter((F.col("domain_category") != enrich.OTHER) & F.col("training"))
        .groupBy("page")
        .agg(F.array(*[F.count_if(F.col("domain_category") == s) for s in sites]).alias("votes"))
        .withColumn("total", F.aggregate("votes", F.lit(0).cast("bigint"), lambda a, b: a + b))
        .select("page", F.transform("votes", lambda v: v / F.col("total")).alias("probability"))
    )
    nobody = F.array(*[F.lit(0.0) for _ in sites])
    return (
        table.join(tally, "page", "left")
        .withColumn("probability", F.coalesce("probability", nobody))
        .withColumn(
            "prediction",
            (F.array_position("probability", F.array_max("probability")) - 1).cast("double"),
        )
    )


@query
def predict_threshold(spark, sf):
    table, sites = stored_extract(spark, sf)
    sure = enrich.accept_class(F.col("probability"), sites)
    return (
        _votes(table, sites)
        .filter(F.col("domain_category") == enrich.OTHER)
        .select(
            "date_time",
            "remote_addr",
            "clean_path",
            "prediction",
            sure.alias("prediction_domain"),
        )
    )


@query
def ground_truth(spark, sf):
    table, sites = stored_extract(spark, sf)
    unknown = _votes(table, sites).filter(F.col("domain_category") == enrich.OTHER)
    sure = enrich.accept_class(F.col("probability"), sites)
    predicted = unknown.withColumn("prediction_domain", sure)
    merged = site.ground_truth(table, predicted)
    return merged.drop("fdate_time").withColumn("clean_query_list", joined("clean_query_list"))


def _tested(spark, sf):
    """Class and vote of registered traffic held out from voting, and the number of sites."""
    table, sites = stored_extract(spark, sf)
    known = _votes(table, sites).filter(
        (F.col("domain_category") != enrich.OTHER) & ~F.col("training")
    )
    names = F.array(*[F.lit(s) for s in sites])
    label = (F.array_position(names, F.col("domain_category")) - 1).cast("double")
    return known.select(label.alias("domain_index"), "prediction"), len(sites)


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_tested(spark, sf)[0]).withColumnRenamed("count", "requests")


@query
def confusion_pivot(spark, sf):
    tested, classes = _tested(spark, sf)
    pivot = metrics.confusion_pivot(metrics.confusion_matrix(tested), range(classes))
    return pivot.select("domain_index", *[F.col(str(c)).alias(f"class_{c}") for c in range(classes)])


@query
def confusion_share_pivot(spark, sf):
    tested, classes = _tested(spark, sf)
    shares = metrics.confusion_matrix(tested)
    pivot = metrics.confusion_pivot(shares, range(classes), "percentage")
    named = [F.round(F.col(str(c)), 9).alias(f"class_{c}") for c in range(classes)]
    return pivot.select("domain_index", *named)


@query
def line_outcomes(spark, sf):
    """How many lines became requests, and what became of the others."""
    outcomes = parse.line_outcome(log_lines(spark, sf))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("lines"))


@query
def classifier_metrics(spark, sf):
    table = metrics.classifier_metrics(metrics.confusion_matrix(_tested(spark, sf)[0]))
    return table.select(*[F.round(c, 9).alias(c) for c in table.columns])


# Models: SQL states what holds whatever the hashes and random trees are; tests check the rest


@query
def hashed_terms(spark, sf):
    """Number of terms per row under every bucket count in use."""
    table = features.detect_columns(log_requests(spark, sf))
    table = features.add_agent_ngrams(table.drop("agent"))
    columns = (("url_features", 2040), ("url_features", 512), ("agent", 32), ("agent_ngrams", 32))
    for terms, buckets in columns:
        table = features.hash_terms(table, terms, f"{terms}_{buckets}", buckets)
    names = [f"{terms}_{buckets}" for terms, buckets in columns]
    total = {
        n: F.aggregate(F.unwrap_udt(F.col(n))["values"], F.lit(0.0), lambda a, b: a + b)
        for n in names
    }
    return table.select("date_time", "remote_addr", *[total[n].alias(n) for n in names])


def _feature_summary(df):
    values = F.unwrap_udt(F.col("features"))
    return df.select(
        "date_time",
        "remote_addr",
        F.coalesce(values["size"], F.size(values["values"])).alias("width"),
        F.round(F.aggregate(values["values"], F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
    )


def _site_models(table):
    methods = categories.fit_indexer(table, "method")
    encoder = categories.fit_encoder(methods.transform(table), "method")
    registered = table.filter(F.col("domain_category") != enrich.OTHER)
    return site.SiteModels(methods, encoder, categories.fit_indexer(registered, "domain_category"))


@query
def domain_features(spark, sf):
    table, _ = stored_extract(spark, sf)
    return _feature_summary(site.labelled_features(table, _site_models(table)))


@query
def detect_vector(spark, sf):
    return _feature_summary(features.detect_features(log_requests(spark, sf)))


@query
def train_domain(spark, sf):
    table, _ = stored_extract(spark, sf)
    _, tested = site.train(table, _site_models(table))
    matrix = land(metrics.confusion_matrix(tested), "confusion")
    quality = metrics.classifier_metrics(matrix)
    fit = reduce(and_, [F.col(name).between(0, 1) for name in quality.columns])
    tested = matrix.agg(F.sum("count")).first()[0]
    return quality.select(F.lit(tested).cast("long").alias("tested"), fit.alias("metrics_fit"))


def _predictions_fit(predicted, labels):
    chances = vector_to_array("probability")
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)
    sure = F.array_max(chances) > 0.70
    return predicted.groupBy("method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.every(F.col("prediction").isin([float(k) for k in range(len(labels))])).alias("classes_fit"),
        F.every((F.size(chances) == len(labels)) & (F.abs(_total(chances) - 1) < 1e-9)).alias("chances_fit"),
        F.every(F.array_position(chances, F.array_max(chances)) == F.col("prediction") + 1).alias("most_likely"),
        F.every(F.col("prediction_domain") == F.when(sure, label).otherwise("other")).alias("labels_fit"),
        # Different requests get different chances.
        (F.count_distinct("probability") > 1).alias("tells_apart"),
    )


@query
def predict_domain(spark, sf):
    table, _ = stored_extract(spark, sf)
    models = _site_models(table)
    models.classifier, _ = site.train(table, models)
    return _predictions_fit(site.predict(table, models), models.classes.labels)


@query
def predict_stored(spark, sf):
    """Prediction by one stored pipeline, from which everything is loaded."""
    table, _ = stored_extract(spark, sf)
    models = _site_models(table)
    models.classifier, _ = site.train(table, models)
    path = work_path(spark, "pipeline")
    writers.save_model(site.pipeline(models), path)
    return _predictions_fit(site.apply_pipeline(table, readers.load_pipeline(path)), models.classes.labels)


def _total(numbers):
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x)


@query
def forest_fit(spark, sf):
    table, _ = stored_extract(spark, sf)
    nodes = detect.fit(table, detect.FIRST)
    return nodes.groupBy("forest_group").agg(
        F.count_distinct("tree").alias("trees"),
        F.min("sample_size").alias("least_sample"),
        F.max("sample_size").alias("most_sample"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows"),
    )


def _labels_fit(found, contamination, error=0.0):
    """Per site: requests, whether scores lie in (0, 1], and whether the labels are those of a threshold.

    That is, anomalies are the top scores, there are as many as wanted (or up to ``error`` of the rows
    fewer or more), and beyond that number only ties of the lowest of them.
    """
    score, odd = F.col("outlierScore"), F.col("anomaly_bool")
    lowest = found.groupBy("domain_category").agg(F.min(F.when(odd, score)).alias("lowest"))
    per_site = found.join(lowest, "domain_category").groupBy("domain_category").agg(
        F.count("*").alias("requests"),
        F.every((score > 0) & (score <= 1)).alias("scores_fit"),
        F.every(odd == (score >= F.col("lowest"))).alias("split"),
        F.count_if(odd).alias("odd"),
        F.count_if(score > F.col("lowest")).alias("above"),
    )
    rank = F.greatest(F.lit(1), F.ceil((1.0 - contamination) * F.col("requests")))
    wanted, slack = F.col("requests") - rank + 1, error * F.col("requests")
    enough = (F.col("odd") >= wanted - slack) & (F.col("above") < wanted + slack)
    return per_site.select(
        "domain_category", "requests", "scores_fit", (F.col("split") & enough).alias("labels_fit")
    )


@query
def forest_score(spark, sf):
    """First detector: 100 trees of 256 rows, 2 % anomalies."""
    table, _ = stored_extract(spark, sf)
    found, _ = detect.detect(table, detect.FIRST)
    return _labels_fit(found, detect.FIRST.contamination)


@query
def forest_by_domain(spark, sf):
    """Final detector: 1000 trees of 512 rows for every site, 5 % anomalies."""
    table, _ = stored_extract(spark, sf)
    found, _ = detect.detect(table)
    return _labels_fit(found, detect.FINAL.contamination, detect.FINAL.error)


@query
def forest_one_feature(spark, sf):
    """Forest over a list of plain columns instead of a vector."""
    table, _ = stored_extract(spark, sf)
    nodes = land(
        forest.fit_forest(table, "domain_category", parse.REQUEST_KEY, ["body_bytes_sent"]), "forest"
    )
    scored = forest.score_forest(table, nodes, "domain_category", ["body_bytes_sent"])
    limits = forest.score_thresholds(scored, "domain_category", contamination=0.05)
    return _labels_fit(forest.label_anomalies(scored, limits, "domain_category"), 0.05)


@query
def path_minhash(spark, sf):
    grams = features.add_path_ngrams(log_requests(spark, sf)).select("clean_path", "path_ngrams")
    signed = similar.minhash_signatures(grams, "path_ngrams")
    minima = [name for name in signed.columns if name.startswith("min")]
    return signed.groupBy("clean_path").agg(
        F.count("*").alias("requests"),
        F.count_distinct(F.struct(*minima)).alias("signatures"),
        F.every(reduce(and_, [F.col(name).isNull() for name in minima])).alias("missing"),
    )


def _similar_paths(spark, sf):
    """Sets of three characters, as the given paths are short, and their links from 75 % on."""
    sets = land(similar.path_sets(log_requests(spark, sf), 3), "path-sets")
    return sets, similar.similar_classes(similar.set_classes(sets, "clean_path"))


@query
def similar_paths(spark, sf):
    return _similar_paths(spark, sf)[1]


@query
def similar_path_members(spark, sf):
    sets, links = _similar_paths(spark, sf)
    return similar.similar_members(sets, "clean_path", links)


@query
def path_embedding(spark, sf):
    table, _ = stored_extract(spark, sf)
    worded = land(embed.add_path_tokens(table), "path-tokens")
    embedded = embed.embed_paths(worded, embed.fit_path_embedding(worded))
    vector = vector_to_array("url_embedding")
    return embedded.select(
        "date_time",
        "remote_addr",
        "clean_path",
        F.size(vector).alias("width"),
        F.forall(vector, lambda v: v == 0).alias("is_zero"),
    )


@query
def forest_embedding(spark, sf):
    """First detector on embedded paths instead of hashed tokens."""
    table, _ = stored_extract(spark, sf)
    vectors = embed.fit_path_embedding(land(embed.add_path_tokens(table), "path-tokens"))
    found, _ = detect.detect(table, detect.FIRST, detect.embedding_features(vectors))
    return _labels_fit(found, detect.FIRST.contamination)
