"""Volume counts and token profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.functions import tokens


def volume_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count()


def explode_path_words(df: DataFrame, path: str = "clean_path") -> DataFrame:
    """One row per path token, with the number of tokens in its path."""
    words = df.select(tokens.path_tokens(F.col(path)).alias("path_words"))
    # A split has at least one part. The outer form spares the "not empty" filter that
    # Spark would otherwise push down, evaluating the path a second time below a shuffle.
    return words.select(
        F.explode_outer("path_words").alias("word"), F.size("path_words").alias("array_length")
    )


def explode_pairs(
    df: DataFrame,
    pairs: str = "clean_query_list",
    keep: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """One row per query pair with its key and value, beside the columns ``keep``.

    Requests without query give none; with ``keep_empty`` one row whose pair is NULL.
    """
    exploded = df.select(*keep, F.explode_outer(pairs).alias("query_param"))
    if not keep_empty:
        exploded = exploded.filter("query_param IS NOT NULL")
    return exploded.withColumns(
        {
            "query_key": tokens.pair_key(F.col("query_param")),
            "query_value": tokens.pair_value(F.col("query_param")),
        }
    )


def _spread(column: str, prefix: str) -> list:
    return [
        F.min(column).alias(f"min_{prefix}"),
        F.max(column).alias(f"max_{prefix}"),
        F.avg(column).alias(f"avg_{prefix}"),
        F.stddev_samp(column).alias(f"stddev_{prefix}"),
    ]


def token_profile(df: DataFrame, path: str = "clean_path", approximate: bool = False) -> DataFrame:
    """One row: distinct tokens and the spread of token length and path size.

    ``*_array_length`` is taken over tokens, so long paths weigh more.
    """
    words = explode_path_words(df, path).withColumn("word_length", F.length("word"))
    distinct = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    return words.agg(
        distinct.alias("unique_words"),
        *_spread("word_length", "word_length"),
        *_spread("array_length", "array_length"),
    )


def path_size_profile(df: DataFrame, path: str = "clean_path") -> DataFrame:
    """Spread of tokens per path, each request counted once."""
    sizes = df.select(F.size(tokens.path_tokens(F.col(path))).alias("array_length"))
    return sizes.agg(*_spread("array_length", "array_length"))
