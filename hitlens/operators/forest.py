"""Isolation forests, one per group (site), fitted and applied in one pass over all groups.

Spark draws the samples, moves each tree's sample to a task and spreads the
scoring; numpy grows and walks the trees inside the tasks. What travels is the
sample, whose size depends on the trees, not on the rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitlens.operators import tree_kernels
from hitlens.operators.tree_kernels import Forest, grow_trees
from hitlens.session import broadcast_if_small, land, size_checked

# Executors get the array code with the function, whether or not they have the package.
cloudpickle.register_pickle_by_value(tree_kernels)

TREES_PER_CHUNK = 50
ROWS_PER_TASK = 100_000
UNIT = 2.0**-53

NODES = T.StructType(
    [
        T.StructField("forest_group", T.StringType()),
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("sample_size", T.IntegerType()),
        T.StructField("path_length", T.DoubleType()),
    ]
)


def feature_columns(features: str | Sequence[str]) -> tuple[Column, Column]:
    """Index and value arrays of a vector column, or of a list of numeric columns."""
    if isinstance(features, str):
        vector = F.unwrap_udt(F.col(features))
        every = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
        return F.coalesce(vector["indices"], every), vector["values"]
    positions = F.array(*[F.lit(i) for i in range(len(features))])
    return positions, F.array(*[F.col(c).cast("double") for c in features])


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11) * F.lit(UNIT)


def draw_samples(
    df: DataFrame,
    group: str,
    key: Sequence[str],
    features: str | Sequence[str],
    num_trees: int,
    max_samples: int,
    seed: int,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows that each chunk of trees draws from: one row per (group, chunk, row).

    A chunk needs a pool of ``TREES_PER_CHUNK * max_samples`` of a group's N
    rows, so a row joins it with probability q, slightly above that share.
    Chunks are taken in strides of 1/q: within a stride a row's hash assigns it
    to at most one chunk. A large group needs a single stride, hence one hash per
    row; a small group needs many, but then has few rows. The hash is of the
    row's own ``key`` values, so the draw is the same under any partitioning and
    after any retry. What leaves the scan is bounded by trees times samples.

    ``prepare`` adds the feature columns to the rows drawn, so that they are not
    computed for all others.
    """
    wanted = TREES_PER_CHUNK * max_samples
    overdraw = wanted + 6 * math.sqrt(wanted) + 10
    chunks = math.ceil(num_trees / TREES_PER_CHUNK)
    sizes = (
        df.groupBy(F.col(group).alias("forest_group"))
        .count()
        .filter("forest_group IS NOT NULL")
        .select("forest_group", F.least(F.lit(1.0), overdraw / F.col("count")).alias("q"))
        .withColumn("stride", F.floor(1 / F.col("q")).cast("int"))
        .withColumn("strides", F.ceil(chunks / F.col("stride")).cast("int"))
    )
    sizes, groups = size_checked(land(sizes, "forest-sizes"))
    rows = df.withColumns(
        {
            "forest_group": F.col(group),
            "sample_key": F.xxhash64(F.lit(seed), *[F.col(c) for c in key]),
        }
    )
    slot = F.floor(_unit(F.xxhash64("sample_key", "stride_no")) / F.col("q")).cast("int")
    in_stride = (F.col("slot") < F.col("stride")) & (F.col("chunk") < chunks)

    def with_chunk(df: DataFrame) -> DataFrame:
        placed = df.withColumn("slot", slot)
        return placed.withColumn("chunk", F.col("stride_no") * F.col("stride") + F.col("slot"))

    # Of a group with a single stride only the rows drawn go on. Copies of a row
    # share its key and count once, so that no copied row can fill a chunk; they
    # collapse before the shuffle and before a small group's rows are multiplied.
    chosen = (
        with_chunk(rows.join(sizes, "forest_group").withColumn("stride_no", F.lit(0)))
        .filter((F.col("strides") > 1) | in_stride)
        .drop("slot", "chunk", "stride_no")
        .dropDuplicates(["forest_group", "sample_key"])
    )
    indices, values = feature_columns(features)
    prepared = (prepare(chosen) if prepare else chosen).select(
        "forest_group",
        "sample_key",
        "q",
        "stride",
        "strides",
        indices.alias("indices"),
        values.alias("values"),
    )
    every_stride = F.sequence(F.lit(0), F.col("strides") - 1)
    # Growing trees is work per chunk, not per byte: the number of tasks is set here.
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(groups * chunks, 4 * cores))
    return (
        with_chunk(prepared.withColumn("stride_no", F.explode(every_stride)))
        .filter(in_stride)
        .select("forest_group", "chunk", "sample_key", "indices", "values")
        .repartition(tasks, "forest_group", "chunk")
    )


def fit_forest(
    df: DataFrame,
    group: str,
    key: Sequence[str],
    features: str | Sequence[str] = "features",
    num_trees: int = 100,
    max_samples: int = 256,
    seed: int = 1,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Node table of all trees of all groups. ``key`` columns tell rows apart."""
    samples = draw_samples(df, group, key, features, num_trees, max_samples, seed, prepare)
    schema = NODES

    def grow(table: pa.Table) -> pa.Table:
        name, chunk = table["forest_group"][0].as_py(), table["chunk"][0].as_py()
        first = chunk * TREES_PER_CHUNK
        trees = range(first, min(first + TREES_PER_CHUNK, num_trees))
        grown = grow_trees(table, trees, zlib.crc32(name.encode()), max_samples, seed)
        grown["forest_group"] = [name] * len(grown["node"])
        return pa.table({field.name: grown[field.name] for field in schema})

    return samples.groupBy("forest_group", "chunk").applyInArrow(grow, schema)


def pack_forest(forest: DataFrame) -> DataFrame:
    """forest_group, trees: a group's node rows as one binary value of bounded size (trees times samples)."""

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.drop_columns(["forest_group"]).schema) as stream:
            stream.write_table(table.drop_columns(["forest_group"]))
        return pa.table({"forest_group": table["forest_group"].slice(0, 1), "trees": [sink.getvalue().to_pybytes()]})

    return forest.drop("size").groupBy("forest_group").applyInArrow(pack, "forest_group string, trees binary")


def unpack_forest(trees: bytes) -> Forest:
    table = pa.ipc.open_stream(trees).read_all()
    return Forest({name: table[name].to_numpy() for name in table.column_names})


def score_forest(
    df: DataFrame,
    forest: DataFrame,
    group: str,
    features: str | Sequence[str] = "features",
    output: str = "outlierScore",
    keep: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Outlier score of every row by its own group's trees; NULL without trees. Stored.

    Rows meet their trees in a shuffle by group, all groups in one pass. A group of more than ``rows_per_task`` rows
    is dealt to several tasks by a hash of its columns, and its trees, packed as one value, go to each. So a task holds
    one group's trees and a bounded number of rows at a time, and the driver holds neither. ``df`` is read twice and
    should be stored. ``keep`` names the columns to store beside the score: by default all but the feature vector.
    """
    indices, values = feature_columns(features)
    keep = list(keep if keep is not None else (name for name in df.columns if name != features))
    shares = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_task)).alias("_shares")
    sizes = df.groupBy(F.col(group).alias("forest_group")).agg(shares)
    packed = land(pack_forest(forest).join(sizes, "forest_group"), "packed-forest")

    known = broadcast_if_small(packed.select(F.col("forest_group").alias("_site"), "_shares"))
    rows = df.withColumns({"_site": F.col(group), "_indices": indices, "_values": values}).join(known, "_site", "left")
    hashable = [field.name for field in df.select(keep).schema if not isinstance(field.dataType, T.MapType)]
    share = F.pmod(F.xxhash64(*hashable, "_indices", "_values"), F.col("_shares"))
    dealt = rows.filter("_shares IS NOT NULL").select(*keep, "_site", share.alias("_share"), "_indices", "_values")
    trees = packed.select(
        F.col("forest_group").alias("_site"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"),
        "trees",
    )

    def score(requests: pa.Table, own: pa.Table) -> pa.Table:
        scores = [] if not len(requests) else unpack_forest(own["trees"][0].as_py()).score(
            requests["_indices"], requests["_values"]
        )
        return requests.select(keep).append_column(output, pa.array(scores, pa.float64()))

    schema = T.StructType([*df.select(keep).schema.fields, T.StructField(output, T.DoubleType())])
    scored = dealt.groupBy("_site", "_share").cogroup(trees.groupBy("_site", "_share")).applyInArrow(score, schema)
    without = rows.filter("_shares IS NULL").select(*keep, F.lit(None).cast("double").alias(output))
    return land(scored.unionByName(without), "scores")


def score_thresholds(
    df: DataFrame,
    group: str,
    score: str = "outlierScore",
    contamination: float = 0.02,
    error: float = 0.0,
    buckets: int = 4096,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Per group, the score at rank ``ceil((1 - contamination) * rows)``.

    The exact order statistic, found by histograms: each round counts the scores
    of a group's current range in ``buckets`` steps and keeps the step holding
    the rank, until that step is one value, or with ``error`` until its ranks are
    within ``error * rows`` of the wanted one. A round's result has at most
    ``buckets`` rows per group, whatever the number of rows. ``df`` is read once
    per round and should be a stored table; two or three rounds are usual. With
    ``bounds`` of all scores the first round needs no pass to find them.
    """
    rows = df.select(F.col(group).alias("forest_group"), F.col(score).alias("_s")).filter(
        "_s IS NOT NULL AND forest_group IS NOT NULL"
    )
    upto = W.partitionBy("forest_group").orderBy("_step")

    def narrowed(histogram: DataFrame) -> DataFrame:
        return (
            histogram.withColumn("_cum", F.sum("_c").over(upto))
            .filter("_cum >= _rank AND _cum - _c < _rank")
            .select(
                "forest_group",
                "_n",
                "_lo",
                "_hi",
                (F.col("_rank") - (F.col("_cum") - F.col("_c"))).alias("_rank"),
                F.col("_c").alias("_inside"),
            )
        )

    def counted(source: DataFrame, low, high, *keys: str) -> DataFrame:
        step = F.floor((F.col("_s") - low) / (high - low) * buckets)
        step = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), step))
        return source.groupBy("forest_group", *keys, step.alias("_step")).agg(
            F.count("*").alias("_c"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")
        )

    rank = F.greatest(F.lit(1), F.ceil((1.0 - contamination) * F.col("_n")))
    if bounds:
        histogram = counted(rows, F.lit(bounds[0]), F.lit(bounds[1]))
        whole = F.sum("_c").over(W.partitionBy("forest_group"))
        state = narrowed(histogram.withColumn("_n", whole).withColumn("_rank", rank))
    else:
        state = (
            rows.groupBy("forest_group")
            .agg(F.count("*").alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
            .select(
                "forest_group", "_n", "_lo", "_hi", rank.alias("_rank"), F.col("_n").alias("_inside")
            )
        )
    state = land(state, "thresholds")
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > error * F.col("_n"))
    while True:
        open_groups, left = size_checked(state.filter(is_open))
        if left == 0:
            break
        inside = rows.join(
            open_groups.withColumnsRenamed({"_lo": "_from", "_hi": "_to"}), "forest_group"
        ).filter("_s BETWEEN _from AND _to")
        histogram = counted(inside, F.col("_from"), F.col("_to"), "_n", "_rank")
        state = land(state.filter(~is_open).unionByName(narrowed(histogram)), "thresholds")
    return state.select("forest_group", F.col("_lo").alias("threshold"))


def label_anomalies(
    df: DataFrame, thresholds: DataFrame, group: str, score: str = "outlierScore"
) -> DataFrame:
    """``anomaly`` 0/1 and ``anomaly_bool``: score at or above the group's threshold."""
    limits = thresholds.select(F.col("forest_group").alias(group), "threshold")
    limits = broadcast_if_small(limits)
    labelled = df.join(limits, group, "left").withColumn(
        "anomaly", F.coalesce((F.col(score) >= F.col("threshold")).cast("int"), F.lit(0))
    )
    return labelled.withColumn("anomaly_bool", F.col("anomaly").cast("boolean")).select(
        *df.columns, "anomaly", "anomaly_bool"
    )
