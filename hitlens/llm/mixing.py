"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a line of words: its documents in a shuffled order, cut into blocks of equally many words. A
slot of the mix takes one block. Points of the golden-ratio sequence, mapped through the cumulative slot counts
of the sources, say which source each slot takes; the rank of a slot within its source says which block, the
blocks following each other in as many rounds as the source's target needs. The last slot of a source is cut at
its target. So every stretch of the mix holds the sources in their proportions, and the whole holds them to the
word.

No source is handled in one task: lines and ranks are prefix sums over small buckets, whose totals (at most
``BUCKETS`` a source, or one per chunk of slots) are summed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlens.llm.common import text_of, word_count
from hitlens.session import land

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
# A mix has about this many slots at most; blocks grow with a larger corpus.
MOST_SLOTS = 2**26
# The golden-ratio sequence in whole numbers: i * STEP mod CYCLE, STEP the odd number next to CYCLE / 1.618...
CYCLE, STEP = 2**31, 1327217885
CELLS = 4096
CHUNK = 65536


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", row_column: str | None = None):
    """Number, id, source and words of every row. Null text: no words. The number tells equal rows apart.

    ``row_column`` holds the number; without it rows are numbered here, by places that another scan may not repeat.
    """
    return docs.select(
        (F.col(f"`{row_column}`") if row_column else F.monotonically_increasing_id()).alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        word_count(text_of(text_column)).alias("size"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source: sid, source, source_size, target, quota.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the words of all. A target
    stops at ``most`` times the words of its source; the rest is shared again by weight. With sources in order
    of limit per weight, those before the first whose limit is above its share of what is left are at the limit.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    numbered = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    numbered = numbered.withColumns({"weight": weight.cast("long"), "limit": F.col("source_size") * most})
    order = [F.col("limit") / F.col("weight"), F.col("sid")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = numbered.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(after),
        }
    )
    shared = shared.withColumn("level", F.col("left") / F.col("left_weight"))
    shared = shared.withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    shared = shared.withColumn(
        "level", F.min(F.when(F.col("open"), F.struct(*order, F.col("level").alias("level")))).over(everything)["level"]
    )
    target = F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return shared.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "sid", "source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota")
    )


def _earlier(rows: DataFrame, group: str, bucket: str, amount, name: str) -> DataFrame:
    """Sum of ``amount`` in the earlier buckets of a group, one row per group and bucket."""
    sums = rows.groupBy(group, bucket).agg(F.sum(amount).alias("amount"))
    window = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, bucket, F.coalesce(F.sum("amount").over(window), F.lit(0)).alias(name))


def lines(rows: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """Rows with their source's figures and their place (start) in the shuffled line of the source."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).select(
        "row", "doc_id", "size", "sid", "source_size", "target", key.alias("key"), F.substring(key, 1, 3).alias("bucket")
    )
    order = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "row")
    inside = F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = keyed.withColumn("inside", inside).join(
        _earlier(keyed, "sid", "bucket", "size", "before"), ["sid", "bucket"]
    )
    return placed.select(
        "row", "doc_id", "size", "sid", "source_size", "target", (F.col("before") + F.col("inside")).alias("start")
    )


def slots(shares: DataFrame, block: int) -> DataFrame:
    """The schedule: slot, sid, round, block, length (words the slot takes from the block's beginning)."""
    spark = shares.sparkSession
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    rounds = F.floor(F.col("quota") / F.col("source_size")).cast("long")
    need = rounds * blocks + F.ceil((F.col("quota") - rounds * F.col("source_size")) / block).cast("long")
    needs = shares.where("quota > 0").select("sid", "source_size", "quota", blocks.alias("blocks"), need.alias("need"))
    count = needs.agg(F.sum("need")).first()[0] or 0
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    width = max(1, -(-count // CELLS))
    ends = needs.withColumn("end", F.sum("need").over(upto)).withColumn("begin", F.col("end") - F.col("need"))
    cells = ends.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width)))
    )
    # Gaps between the first 2n points are below 1/n, so every source gets the slots it needs among them.
    points = spark.range(2 * count).select(
        F.col("id").alias("slot"),
        F.floor((F.col("id") % CYCLE * STEP % CYCLE) * F.lit(count) / F.lit(CYCLE)).cast("long").alias("point"),
    )
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    hits = points.join(cells, "cell").where("point >= begin and point < end")
    hits = hits.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("local", local).join(
        _earlier(hits, "sid", "chunk", F.lit(1), "before"), ["sid", "chunk"]
    )
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local")).where("rank < need")
    ranked = ranked.withColumns({"round": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    at = F.col("block") * block
    length = F.least(
        F.lit(block), F.col("source_size") - at, F.col("quota") - F.col("round") * F.col("source_size") - at
    )
    return ranked.select("slot", "sid", "round", "block", length.cast("long").alias("length"))


def block_words(rows: DataFrame, least: int = BLOCK_WORDS) -> int:
    words = rows.agg(F.sum("size")).first()[0] or 0
    return max(least, -(-words // MOST_SLOTS))


def mix(line: DataFrame, schedule: DataFrame, block: int) -> DataFrame:
    """The mix in pieces: slot, place, row, doc_id, begin, length (a piece of a document's words).

    Ordered by slot and place it is the mix itself. A document is in the blocks its words lie in.
    """
    last = F.col("start") + F.col("size") - 1
    parts = (
        line.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
        .withColumns(
            {
                "place": F.greatest(F.lit(0), F.col("start") - F.col("block") * block),
                "begin": F.greatest(F.lit(0), F.col("block") * block - F.col("start")),
                "until": F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block),
            }
        )
    )
    joined = parts.join(schedule, ["sid", "block"]).where("place < length")
    return joined.select(
        "slot", "place", "row", "doc_id", "begin", (F.least("until", "length") - F.col("place")).alias("length")
    )


def mixed(
    docs: DataFrame, least_block: int = BLOCK_WORDS, seed: int = 0, row_column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The line of every row, and the mix in pieces. An empty table, or one without words, gives an empty mix."""
    rows = land(sizes(docs, row_column=row_column), "mix-sizes")
    shares = land(targets(rows), "mix-targets")
    block = block_words(rows, least_block)
    line = land(lines(rows, shares, seed), "mix-lines")
    return line, mix(line, slots(shares, block), block)


def words_taken(
    docs: DataFrame, least_block: int = BLOCK_WORDS, seed: int = 0, row_column: str | None = None
) -> DataFrame:
    """Per row: row, doc_id, size, source_size, target, taken.

    Repeated rows are rows of their own. A null source is a source, the last. Rows without words take none.
    """
    line, pieces = mixed(docs, least_block, seed, row_column)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return line.join(taken, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, its share of a text rounded (half up).

    Rows are numbered once and stored with their numbers, so it does not matter how scans deal them to tasks.

    Only the document at the cut of a source is taken in part, so the words stay within one document of the
    target. The columns are those of ``docs``.
    """
    share = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    numbered = docs.select(F.monotonically_increasing_id().alias("mix row"), *docs.columns)
    numbered = land(numbered, "mix-documents")
    times = words_taken(numbered, row_column="mix row").select(F.col("row").alias("mix row"), F.floor(share + 0.5).cast("int").alias("mix times"))
    repeated = numbered.join(times.where("`mix times` > 0"), "mix row")
    return repeated.withColumn("mix row", F.explode(F.sequence(F.lit(1), F.col("mix times")))).select(*docs.columns)
