"""Exact deduplication by sorting the content.

Rows are dealt to ranges of their normalised text by splitters that Spark samples, each range is sorted
(external sort, it spills), and every row is compared with the row before it over the whole text. What
decides the range is a bounded key, the first characters and a hash of the text, so the splitters stay small
however long texts are; equal texts have equal keys and so are neighbours.

A text with more rows than its share of a range is heavy. Its rows are spread over several ranges by an extra
key, and the few survivors of those ranges are compared once more. There are at most ``8 * ranges`` heavy
texts, because each holds more than that share of all rows; nothing else about the result depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlens.llm.common import SPACES, shuffle_partitions, text_of
from hitlens.session import land

KEY_CHARS = 32
HEAVY_PER_RANGE = 8


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), SPACES, " ")


def content_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of each group of equal texts is kept: the one with the smallest id, whatever its
    repetitions. A null text is the empty text. A row without an id counts as the largest; if no row of the
    group has one, keep_id is null and one row stays. Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    ranges = shuffle_partitions(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), normalised(text_column).alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))

    counts = land(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "exact-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (HEAVY_PER_RANGE * ranges))
    # More than total / (8 * ranges) rows each, so at most 8 * ranges of them: safe to broadcast.
    heavy = counts.where(F.col("n") > share).select("hash", F.ceil(F.col("n") / share).cast("int").alias("spread"))
    rows = rows.join(F.broadcast(heavy), "hash", "left").withColumns(
        {
            "start": F.substring("norm", 1, KEY_CHARS),
            "salt": F.when(F.col("spread").isNull(), 0).otherwise(
                F.pmod(F.xxhash64("doc_id"), F.coalesce("spread", F.lit(1)).cast("long"))
            ),
        }
    )

    key = ["start", "hash", "salt"]
    ordered = rows.repartitionByRange(ranges, *key).sortWithinPartitions(
        *key, "norm", F.col("doc_id").asc_nulls_last()
    )
    # Both windows find the rows dealt and sorted as they need them: no further exchange.
    neighbours = Window.partitionBy(*key).orderBy("norm", F.col("doc_id").asc_nulls_last())
    equal = Window.partitionBy(*key, "norm")
    before = F.lag("norm").over(neighbours)
    found = ordered.select(
        "doc_id",
        "norm",
        "spread",
        (before.isNull() | (before != F.col("norm"))).alias("first"),
        F.min("doc_id").over(equal).alias("near_id"),
        F.count(F.lit(1)).over(equal).alias("near_size"),
    ).select(
        "doc_id",
        "near_id",
        "near_size",
        "first",
        F.sha2("norm", 256).alias("text_sha256"),
        F.col("spread").isNotNull().alias("heavy"),
        # The text stays only where survivors of a heavy text meet again.
        F.when(F.col("first") & F.col("spread").isNotNull(), F.col("norm")).alias("norm"),
    )
    found = land(found, "exact-found")

    merged = (
        found.where("norm is not null")
        .groupBy("norm")
        .agg(
            F.first("text_sha256").alias("text_sha256"),
            F.min("near_id").alias("all_id"),
            F.sum("near_size").alias("all_size"),
        )
        .drop("norm")
    )
    # Rows of null ids all have the same salt, so of a group without ids one row is first too.
    light = found.where("not heavy").select(
        "doc_id",
        F.col("near_id").alias("keep_id"),
        F.col("near_size").alias("group_size"),
        F.col("first").alias("kept"),
        "text_sha256",
    )
    spread = (
        found.where("heavy")
        .join(F.broadcast(merged), "text_sha256")
        .select(
            "doc_id",
            F.col("all_id").alias("keep_id"),
            F.col("all_size").alias("group_size"),
            (F.col("first") & F.col("doc_id").eqNullSafe(F.col("all_id"))).alias("kept"),
            "text_sha256",
        )
    )
    return light.unionByName(spread)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id stays; ids must be unique."""
    kept = content_groups(docs, id_column, text_column).where("kept").select(F.col("doc_id").alias(id_column))
    return docs.join(kept, id_column, "left_semi")
