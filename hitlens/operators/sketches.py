"""Results per day that are stored and merged later, without reading the requests again.

Thresholds keep a quantile sketch (KLL) per site and day, profiles a distinct sketch (HLL) and exact sums per day. A
stored row carries the number of the run that made it; of equal keys the latest run counts.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.functions import tokens
from hitlens.session import land

RUN = "run"
# Sizes the sketch accepts, and its rank error (99 % sure) 2.296 / k ** 0.9723.
LEAST_K, MOST_K = 8, 65535
ERROR_SCALE, ERROR_POWER = 2.296, 0.9723
# Distinct counts are within 5 % (three standard errors).
HLL_BITS = 12


def sketch_size(error: float) -> int | None:
    """Size of a sketch whose rank error is half of ``error`` with 99 %; None if no size does."""
    if error <= 0:
        return None
    k = math.ceil((ERROR_SCALE / (error / 2)) ** (1 / ERROR_POWER))
    return max(LEAST_K, k) if k <= MOST_K else None


def score_sketches(df: DataFrame, *keys: str, score: str = "outlierScore", size: int = 546) -> DataFrame:
    """keys, n, sketch: the scores of each group. Rows without a score count nowhere."""
    scored = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    made = scored.groupBy(*keys).agg(F.kll_sketch_agg_double(score, F.lit(size)).alias("sketch"))
    return made.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), "sketch")


def sketch_thresholds(sketches: DataFrame, group: str, contamination: float = 0.02) -> DataFrame:
    """forest_group, threshold: the score at rank ``(1 - contamination) * rows``, within the sketches' error. Stored.

    Sketches are random where they drop values, so what is found is stored before anyone uses it.
    """
    merged = sketches.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("forest_group"))
    whole = merged.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    rank = F.lit(1.0 - contamination)
    limit = F.kll_sketch_get_quantile_double("sketch", rank).alias("threshold")
    return land(whole.select("forest_group", limit), "thresholds")


def store_run(df: DataFrame, path: str) -> DataFrame:
    """Append rows as those of a new run, and return all that is stored under ``path``."""
    df.withColumn(RUN, F.lit(time.time_ns())).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def latest(stored: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the latest run."""
    values = [c for c in stored.columns if c not in (*keys, RUN)]
    kept = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), RUN).alias("kept"))
    return kept.select(*keys, "kept.*")


def _sums(column: str) -> list:
    x = F.col(column).cast("long")
    return [
        F.count(x).alias(f"n_{column}"),
        F.sum(x).alias(f"sum_{column}"),
        F.sum((x * x).cast("decimal(28,0)")).alias(f"squares_{column}"),
        F.min(column).alias(f"min_{column}"),
        F.max(column).alias(f"max_{column}"),
    ]


def daily_profile(df: DataFrame, day: str = "date", path: str = "clean_path") -> DataFrame:
    """One row per day: sums of token lengths and path sizes, and a sketch of the tokens."""
    words = df.select(F.col(day).alias("day"), tokens.path_tokens(F.col(path)).alias("path_words")).select(
        "day", F.explode_outer("path_words").alias("word"), F.size("path_words").alias("array_length")
    )
    words = words.withColumn("word_length", F.length("word"))
    # The sketch passes over empty texts, which are tokens too.
    marked = F.concat(F.lit("/"), "word")
    return words.groupBy("day").agg(
        F.hll_sketch_agg(marked, F.lit(HLL_BITS)).alias("words"), *_sums("word_length"), *_sums("array_length")
    )


def merged_profile(states: DataFrame) -> DataFrame:
    """The row of ``counts.token_profile`` from stored days; all but ``unique_words`` is exact."""

    def spread(column: str) -> list:
        exact = "decimal(38,0)"
        n, total = (F.sum(f"{part}_{column}").cast(exact) for part in ("n", "sum"))
        squares = F.sum(f"squares_{column}").cast(exact)
        # n * squares - total ** 2 is a whole number, so nothing cancels.
        scatter = (n * squares).cast(exact) - (total * total).cast(exact)
        pairs = (n * (n - 1)).cast("double")
        values = (
            F.min(f"min_{column}"),
            F.max(f"max_{column}"),
            total.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)),
            F.sqrt(scatter.cast("double") / F.nullif(pairs, F.lit(0.0))),
        )
        return [value.alias(f"{name}_{column}") for name, value in zip(("min", "max", "avg", "stddev"), values)]

    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("words")), F.lit(0)).cast("long")
    return states.agg(distinct.alias("unique_words"), *spread("word_length"), *spread("array_length"))
