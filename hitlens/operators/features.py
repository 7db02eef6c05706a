"""Feature vectors for the site classifier and for the anomaly detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import (
    HashingTF,
    NGram,
    OneHotEncoderModel,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.functions import times, tokens
from hitlens.operators.categories import encode

PATH_GRAM = 9
AGENT_GRAM = 7
SITE_BUCKETS = 16384
SITE_FEATURES = ["fabstime", "day_of_week", "method_onehot", "body_bytes_sent", "hash_url_features"]
DETECT_FEATURES = ["fabstime", "status", "body_bytes_sent", "query_len", "url_hashes"]


def add_path_ngrams(df: DataFrame, n: int = PATH_GRAM, output: str = "path_ngrams") -> DataFrame:
    """Character n-grams of the path, characters joined by blanks; none for short and missing paths."""
    spelled = df.withColumn("path_characters", tokens.characters(F.coalesce("clean_path", F.lit(""))))
    return NGram(n=n, inputCol="path_characters", outputCol=output).transform(spelled)


def add_agent_ngrams(df: DataFrame, n: int = AGENT_GRAM, output: str = "agent_ngrams") -> DataFrame:
    """N-grams of the words of the user agent; none where there are fewer words."""
    worded = df.withColumn("agent", tokens.agent_tokens(F.col("user_agent")))
    return NGram(n=n, inputCol="agent", outputCol=output).transform(worded)


def hash_terms(df: DataFrame, column: str, output: str, buckets: int) -> DataFrame:
    """Sparse term counts by hash bucket."""
    return HashingTF(inputCol=column, outputCol=output, numFeatures=buckets).transform(df)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def add_site_terms(df: DataFrame, n: int = PATH_GRAM, output: str = "url_features") -> DataFrame:
    """Path n-grams and query keys as one array."""
    grams = add_path_ngrams(df, n)
    keys = F.coalesce(tokens.query_keys(F.col("clean_query_list")), F.array().cast("array<string>"))
    return grams.withColumn(output, F.concat("path_ngrams", keys)).drop("path_characters", "path_ngrams")


def site_features(
    requests: DataFrame,
    indexer: StringIndexerModel,
    encoder: OneHotEncoderModel,
    unseen: str = "error",
    n: int = PATH_GRAM,
    buckets: int = SITE_BUCKETS,
) -> DataFrame:
    """Classifier features for training; the stored pipeline computes the same ones."""
    terms = add_site_terms(encode(requests, indexer, encoder, unseen), n)
    hashed = hash_terms(terms, "url_features", "hash_url_features", buckets)
    return assemble(hashed, SITE_FEATURES).drop("url_features", "hash_url_features")


def detect_columns(requests: DataFrame, classify: bool = True) -> DataFrame:
    """Scalar detector columns and URL tokens (classes such as DIGIT when ``classify``)."""
    path, pairs = F.col("clean_path"), F.col("clean_query_list")
    url = tokens.url_tokens(path, pairs)
    return requests.withColumns(
        {
            "es_time": times.index_time(F.col("fdate_time")),
            "query_len": tokens.query_length(F.col("dec_req_uri"), path),
            "url_features": tokens.classify_tokens(url) if classify else url,
        }
    )


def detect_features(requests: DataFrame, buckets: int = 512, classify: bool = True) -> DataFrame:
    """Detector columns plus the assembled ``features`` vector."""
    hashed = hash_terms(detect_columns(requests, classify), "url_features", "url_hashes", buckets)
    return assemble(hashed, DETECT_FEATURES).drop("url_features", "url_hashes")
