"""Hard negatives: per anchor its nearest rows of the same label, and for each the nearest others within a margin.

Candidates are stored in blocks of ``BLOCK`` rows: a Parquet table with a block a row, in order of label and of the
Hilbert curve through the dimensions that vary most. A block's zone map holds the least and the greatest value of every
dimension and of the label. The anchors, in the same order, form groups of up to ``GROUP``. A search asks for the best
rows whose score lies in a window, several windows per anchor. Interval arithmetic over a zone map bounds the scores of
its block; only blocks whose bounds meet a window of some anchor of a group are read for it. They come a page of
``PAGE`` blocks at a time, the most promising first, and are skipped once the best rows found so far are beyond their
bounds. Windows of the first search begin at the score that an anchor's own block already offers.

All anchors meet all zone maps (they are a stated query set), in groups and pages; nothing is broadcast, and no task
holds more than a group and a page.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlens.llm.common import shuffle_partitions
from hitlens.llm.grouping import groups
from hitlens.session import land

SCALE, LARGEST = 256, 2.0**18
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
BLOCK, PAGE, GROUP = 512, 64, 1024
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
# Sorts after every id, and below every score.
NO_ID, NO_SCORE = 2**63 - 1, -(2**63)


def longs(values) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def read_longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


# Rows, and their order


ROW_SCHEMA = "row long, vec_id long, label long, vector binary"
ROW_ARROW = pa.schema([(name, pa.int64()) for name in ("row", "vec_id", "label")] + [("vector", pa.binary())])


def _quantised(batches):
    for batch in batches:
        vectors = batch.column("vector")
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4").tobytes()
        ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * 4
        found = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        columns = [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=ROW_ARROW)


def usable(rows: DataFrame, vector: str = "embedding", relabel_every: int = RELABEL_EVERY, n_labels: int = LABELS) -> DataFrame:
    """row, vec_id, label, vector (int32, little endian) of the rows that take part, numbered once."""
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % n_labels).otherwise(label)
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    whole = rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad)
    found = whole.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        changed.alias("label"), values.alias("vector"),
    )
    return land(found.mapInArrow(_quantised, ROW_SCHEMA), "negatives-rows")


def matrix(found: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    if all(len(one) == 4 * width for one in found):
        return np.frombuffer(b"".join(found), "<i4").reshape(len(found), width)
    return np.frombuffer(b"".join(one.ljust(4 * width, b"\0") for one in found), "<i4").reshape(len(found), width)


SPREAD_ARROW = pa.schema([("place", pa.int64())] + [(n, pa.float64()) for n in ("n", "total", "squares", "least", "most")])


def _spread(batches):
    """Per dimension the count, sums and bounds of a task's values."""
    total = np.zeros((5, 0))
    for batch in batches:
        found = batch.column("vector").to_pylist()
        width = max([total.shape[1], *(len(one) // 4 for one in found)])
        more = np.zeros((5, width - total.shape[1]))
        more[3], more[4] = np.inf, -np.inf
        total = np.hstack([total, more])
        if found:
            values = matrix(found, width).astype(float)
            total[0] += len(values)
            total[1] += values.sum(axis=0)
            total[2] += (values**2).sum(axis=0)
            total[3] = np.minimum(total[3], values.min(axis=0))
            total[4] = np.maximum(total[4], values.max(axis=0))
    columns = [pa.array(np.arange(total.shape[1])), *(pa.array(one) for one in total)]
    yield pa.RecordBatch.from_arrays(columns, schema=SPREAD_ARROW)


def spread(rows: DataFrame) -> np.ndarray:
    """Dimensions by (variance, least, most): as many rows as a vector has components."""
    schema = "place long, n double, total double, squares double, least double, most double"
    sums = rows.select("vector").mapInArrow(_spread, schema).groupBy("place").agg(
        F.sum("n"), F.sum("total"), F.sum("squares"), F.min("least"), F.max("most")
    )
    found = np.array(sorted(tuple(one) for one in sums.collect()), float).reshape(-1, 6)
    n = np.maximum(found[:, 1], 1)
    return np.stack([found[:, 3] / n - (found[:, 2] / n) ** 2, found[:, 4], found[:, 5]], axis=1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (one a row, ``bits`` bits a dimension), by Skilling's transform (2004)."""
    x, width = cells.astype(np.int64).copy(), cells.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(width):
            high = x[:, k] >> bit & 1
            swap = (x[:, 0] ^ x[:, k]) & low & (high - 1)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, k] ^= swap
    for k in range(1, width):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= (x[:, -1] >> bit & 1) * ((1 << bit) - 1)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(width):
            key = key << 1 | x[:, k] >> bit & 1
    return key


def _keys(measured: np.ndarray, batches):
    width = len(measured)
    chosen = np.argsort(-measured[:, 0], kind="stable")[:CURVE_DIMENSIONS]
    least, most = measured[chosen, 1], measured[chosen, 2]
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = matrix(batch.column("vector").to_pylist(), width)
        cells = ((vectors[:, chosen] - least) * (1 << CURVE_BITS) / (most - least + 1)).astype(np.int64)
        key = hilbert(cells, CURVE_BITS) if width else np.zeros(len(vectors), np.int64)
        full = [row.tobytes() for row in vectors]
        columns = [*batch.columns[:3], pa.array(full, pa.binary()), pa.array(key)]
        yield pa.RecordBatch.from_arrays(columns, names=[*ROW_ARROW.names, "key"])


PLACED_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("part", "place", "anchor_place", "row", "vec_id", "label")] + [("vector", pa.binary())]
)


def _placed(anchor_every: int, batches):
    """Rows with their places in the part, and in the part's anchors (null: none)."""
    part, place, anchors = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        ids = batch.column("vec_id")
        is_anchor = ids.is_valid().to_numpy(zero_copy_only=False) & (ids.fill_null(1).to_numpy() % anchor_every == 0)
        n = batch.num_rows
        own = anchors + np.cumsum(is_anchor) - 1
        columns = [np.full(n, part), place + np.arange(n), pa.array(own, pa.int64(), mask=~is_anchor), *batch.columns[:4]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACED_ARROW)], schema=PLACED_ARROW)
        place, anchors = place + n, anchors + int(is_anchor.sum())


def numbered(rows: DataFrame, measured: np.ndarray, anchor_every: int = ANCHOR_EVERY, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Rows in curve order with their block, and anchors with their group (others: null)."""
    keyed = rows.mapInArrow(partial(_keys, measured), ROW_SCHEMA + ", key long")
    # The row's number parts many equal vectors.
    order = ["label", "key", "row"]
    dealt = keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = "part long, place long, anchor_place long, " + ROW_SCHEMA
    placed = land(dealt.mapInArrow(partial(_placed, anchor_every), schema), "negatives-order")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("anchor_place").alias("anchors"))
    # As many rows as range partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.sum("anchors").over(before), F.lit(0)).alias("first_anchor"),
    )
    return placed.join(F.broadcast(offsets), "part").select(
        F.floor((F.col("first") + F.col("place")) / block).alias("block"),
        F.floor((F.col("first_anchor") + F.col("anchor_place")) / group).alias("group"),
        "row", "vec_id", "label", "vector",
    )


# Blocks with zone maps, and groups of anchors


BLOCK_SCHEMA = "block long, rows binary, ids binary, labels binary, groups binary, vectors binary, zone binary, zone_labels binary"
BLOCK_ARROW = pa.schema([("block", pa.int64())] + [
    (name, pa.binary()) for name in ("rows", "ids", "labels", "groups", "vectors", "zone", "zone_labels")
])


def _blocks(width: int, batches):
    for found in groups(batches, ("block",)):
        ids = found["vec_id"].fill_null(NO_ID).to_numpy()
        rows, labels = found["row"].to_numpy(), found["label"].to_numpy()
        # Of equal scores the first place is the smaller id.
        order = np.lexsort((rows, ids))
        vectors = matrix(found["vector"].to_pylist(), width)[order]
        zone = np.stack([vectors.min(axis=0), vectors.max(axis=0)])
        columns = [
            found["block"][0].as_py(), longs(rows[order]), longs(ids[order]), longs(labels[order]),
            longs(found["group"].fill_null(-1).to_numpy()[order]), vectors.tobytes(), zone.tobytes(),
            longs([labels.min(), labels.max()]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, BLOCK_ARROW)], schema=BLOCK_ARROW)


def blocks(placed: DataFrame, width: int) -> DataFrame:
    """The stored table of blocks, one a row."""
    rows = placed.repartition(shuffle_partitions(placed.sparkSession), "block").sortWithinPartitions("block", "row")
    return land(rows.mapInArrow(partial(_blocks, width), BLOCK_SCHEMA), "negatives-blocks")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float64 if largest < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


ANCHOR_SCHEMA = "group long, row long, vec_id long, label long, vector binary, low long"
ANCHOR_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("group", "row", "vec_id", "label")] + [("vector", pa.binary()), ("low", pa.int64())]
)


def _anchors(width: int, k: int, batches):
    """Anchors with the score of their k-th neighbour of the same label in their own block."""
    for batch in batches:
        for raws in zip(*(batch.column(name).to_pylist() for name in ("rows", "ids", "labels", "groups", "vectors"))):
            rows, ids, labels, in_group = (read_longs(raw) for raw in raws[:4])
            vectors = np.frombuffer(raws[4], "<i4").reshape(len(rows), width)
            own = np.flatnonzero(in_group >= 0)
            if not len(own):
                continue
            scores = products(vectors[own], vectors)
            scores[labels[own][:, None] != labels[None, :]] = NO_SCORE
            scores[np.arange(len(own)), own] = NO_SCORE
            low = np.full(len(own), NO_SCORE) if len(rows) < k else -np.partition(-scores.clip(NO_SCORE + 1), k - 1, axis=1)[:, k - 1]
            columns = [in_group[own], rows[own], ids[own], labels[own], [vectors[one].tobytes() for one in own], low]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANCHOR_ARROW)], schema=ANCHOR_ARROW)


GROUP_SCHEMA = "group long, rows binary, ids binary, labels binary, vectors binary, lows binary, highs binary"
GROUP_ARROW = pa.schema([("group", pa.int64())] + [
    (name, pa.binary()) for name in ("rows", "ids", "labels", "vectors", "lows", "highs")
])


def _groups(batches):
    for found in groups(batches, ("group",)):
        columns = [found["group"][0].as_py()]
        columns += [longs(found[name].to_numpy()) for name in ("row", "vec_id", "label")]
        columns.append(b"".join(found["vector"].to_pylist()))
        columns += [longs(found[name].combine_chunks().flatten().to_numpy()) for name in ("lows", "highs")]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, GROUP_ARROW)], schema=GROUP_ARROW)


def packed(anchors: DataFrame) -> DataFrame:
    """Groups of anchors, one a row; ``lows`` and ``highs`` are arrays with a window a place."""
    rows = anchors.select("group", "row", "vec_id", "label", "vector", "lows", "highs")
    rows = rows.repartition(shuffle_partitions(anchors.sparkSession), "group").sortWithinPartitions("group", "row")
    return land(rows.mapInArrow(_groups, GROUP_SCHEMA), "negatives-groups")


# Search


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``least`` and ``most`` (blocks a row)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, least) + products(down, most), products(up, most) + products(down, least)


class Anchors:
    """A group of anchors, their windows, and the best rows found so far."""

    def __init__(self, row: dict, width: int, k: int, same: bool):
        self.rows, self.ids, self.labels = (read_longs(row[name]) for name in ("rows", "ids", "labels"))
        n = len(self.rows)
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(n, width)
        self.lows, self.highs = (read_longs(row[name]).reshape(n, -1) for name in ("lows", "highs"))
        self.k, self.same = k, same
        shape = (n, self.lows.shape[1], k)
        self.scores = np.full(shape, NO_SCORE)
        self.found_ids, self.found_rows = np.full(shape, NO_ID), np.full(shape, NO_ID)

    def wanted(self, zone: np.ndarray, zone_labels: np.ndarray) -> np.ndarray:
        """Anchors (a row each) that must read the block (a column each) for one of their windows."""
        low, high = bounds(self.vectors, zone[:, 0], zone[:, 1])
        own, (least, most) = self.labels[:, None], zone_labels.T
        right = (least <= own) & (own <= most) if self.same else ~((least == own) & (own == most))
        met = np.zeros(low.shape, bool)
        for window in range(self.lows.shape[1]):
            # Of full results only better ones count; equal scores may still have smaller ids.
            floor, top = np.maximum(self.lows[:, window], self.scores[:, window, -1]), self.highs[:, window]
            met |= (high >= floor[:, None]) & (low <= top[:, None]) & (floor <= top)[:, None]
        return right & met

    def read(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Merge a block into the best rows of the anchors that want it."""
        zone = np.stack([vectors.min(axis=0), vectors.max(axis=0)])[None]
        own = np.flatnonzero(self.wanted(zone, np.array([[labels.min(), labels.max()]]))[:, 0])
        if not len(own):
            return
        scores = products(self.vectors[own], vectors)
        right = labels[None, :] == self.labels[own][:, None]
        right = right & (rows[None, :] != self.rows[own][:, None]) if self.same else ~right
        for window in range(self.lows.shape[1]):
            low, high = self.lows[own, window], self.highs[own, window]
            inside = right & (scores >= low[:, None]) & (scores <= high[:, None])
            here = np.where(inside, scores, NO_SCORE)
            best = here.max(axis=1)
            better = np.flatnonzero((best > NO_SCORE) & (best >= self.scores[own, window, -1]))
            if len(better):
                self.merge(own[better], window, here[better], rows, ids)

    def merge(self, own: np.ndarray, window: int, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        columns = [[self.scores[own, window]], [self.found_ids[own, window]], [self.found_rows[own, window]]]
        places = np.arange(len(own))
        for _ in range(min(self.k, scores.shape[1])):
            first = scores.argmax(axis=1)
            best = scores[places, first]
            none = best == NO_SCORE
            for column, values in zip(columns, (best, np.where(none, NO_ID, ids[first]), np.where(none, NO_ID, rows[first]))):
                column.append(values[:, None])
            scores[places, first] = NO_SCORE
        scores, ids, rows = (np.hstack(column) for column in columns)
        # By score, the highest first, then id, then row.
        order = np.lexsort((rows, ids, ~scores), axis=1)[:, : self.k]
        for kept, values in ((self.scores, scores), (self.found_ids, ids), (self.found_rows, rows)):
            kept[own, window] = np.take_along_axis(values, order, axis=1)


DEALT = "group long, page long, block long, rows binary, ids binary, labels binary, vectors binary, lows binary, highs binary"
WANTED_ARROW = pa.schema([(name, pa.int64()) for name in ("group", "page", "block")])
FOUND_SCHEMA = "row long, vec_id long, window int, found_id long, found_row long, score long"
FOUND_ARROW = pa.schema([
    ("row", pa.int64()), ("vec_id", pa.int64()), ("window", pa.int32()),
    ("found_id", pa.int64()), ("found_row", pa.int64()), ("score", pa.int64()),
])


def _wanted(width: int, same: bool, batches):
    """Blocks that some anchor of a group must read."""
    for found in groups(batches, ("group", "page")):
        group, *zones = found.to_pylist()
        if not zones:
            continue
        zone = np.stack([np.frombuffer(one["vectors"], "<i4").reshape(2, width) for one in zones])
        labels = np.stack([read_longs(one["labels"]) for one in zones])
        met = Anchors(group, width, 1, same).wanted(zone, labels).any(axis=0)
        columns = [[one[name] for one, is_met in zip(zones, met) if is_met] for name in WANTED_ARROW.names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=WANTED_ARROW)


def _search(width: int, k: int, same: bool, batches):
    """The k best rows of a page for every window of a group."""
    for found in groups(batches, ("group", "page")):
        group, *candidates = found.to_pylist()
        anchors = Anchors(group, width, k, same)
        read = []
        for one in candidates:
            rows, ids, labels = (read_longs(one[name]) for name in ("rows", "ids", "labels"))
            vectors = np.frombuffer(one["vectors"], "<i4").reshape(len(rows), width)
            _, high = bounds(anchors.vectors, vectors.min(axis=0)[None], vectors.max(axis=0)[None])
            read.append((float(-high.astype(float).mean()), one["block"], (rows, ids, labels, vectors)))
        for _, _, block in sorted(read, key=lambda one: one[:2]):
            anchors.read(*block)
        anchor, window, place = np.nonzero(anchors.scores > NO_SCORE)
        columns = [anchors.rows[anchor], anchors.ids[anchor], window]
        columns += [kept[anchor, window, place] for kept in (anchors.found_ids, anchors.found_rows, anchors.scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_ARROW)], schema=FOUND_ARROW)


def _dealt(anchors: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Every group with its rows of a page, the group's own row first."""
    columns = [field.split()[0] for field in DEALT.split(", ")]
    first = pages.join(anchors, "group").withColumn("block", F.lit(-1).cast("long"))
    for name in ("lows", "highs"):
        rows = rows.withColumn(name, F.lit(None).cast("binary"))
    both = first.select(*columns).unionByName(rows.select(*columns))
    both = both.repartition(shuffle_partitions(anchors.sparkSession), "group", "page")
    return both.sortWithinPartitions("group", "page", "block")


def wanted_blocks(anchors: DataFrame, candidates: DataFrame, width: int, same: bool, page: int = PAGE) -> DataFrame:
    """group, page, block: what the zone maps leave to be read."""
    numbers = anchors.select("group")
    zones = candidates.select(
        "block", F.floor(F.col("block") / page).alias("page"), F.col("zone").alias("vectors"),
        F.col("zone_labels").alias("labels"), F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("ids"),
    )
    # Groups and blocks are numbered without gaps; a group meets all zone maps.
    n_groups = numbers.count()
    zones = zones.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    pages = zones.select("group", "page").distinct()
    dealt = _dealt(anchors, zones, pages)
    return land(dealt.mapInArrow(partial(_wanted, width, same), "group long, page long, block long"), "negatives-wanted")


def search(anchors: DataFrame, candidates: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """row, vec_id, window, rank, found_id, score: the ``k`` best rows of each window of each anchor.

    ``same``: rows of the anchor's label, itself left out; else rows of other labels.
    """
    chosen = wanted_blocks(anchors, candidates, width, same)
    rows = chosen.join(candidates.select("block", "rows", "ids", "labels", "vectors"), "block")
    dealt = _dealt(anchors, rows, chosen.select("group", "page").distinct())
    found = dealt.mapInArrow(partial(_search, width, k, same), FOUND_SCHEMA)
    best = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id", "found_row")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("row", "vec_id", "window", "rank", "found_id", "score")


RESULT_SCHEMA = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def hard_negatives(
    rows: DataFrame, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row takes no part if its label, its vector or a component is null or not finite, or a component is above 2**18
    in absolute value (a score could leave a long). Vectors of several lengths are compared as if filled up with 0. A
    row without id is a candidate, after all others of its score, and is returned as null; an id of 2**63 - 1 counts as
    none. Rows of one id are rows of their own. An empty table gives no rows; extra columns are not read.
    """
    spark = rows.sparkSession
    found = usable(rows, vector)
    measured = spread(found)
    width = len(measured)
    placed = numbered(found, measured)
    candidates = blocks(placed, width)
    anchors = candidates.mapInArrow(partial(_anchors, width, positives), ANCHOR_SCHEMA)
    anchors = land(anchors, "negatives-anchors")
    if anchors.isEmpty():
        return spark.createDataFrame([], RESULT_SCHEMA)
    first = anchors.withColumns({"lows": F.array("low"), "highs": F.array(F.lit(NO_ID))})
    near = search(packed(first), candidates, width, positives, same=True)
    near = land(near.select("row", "vec_id", "rank", "found_id", "score"), "negatives-positives")

    # Half the positive's score, rounded up, to 95 % of it, rounded down; a place without a positive has no window.
    scores = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    of = [f"scores[{k + 1}]" for k in range(positives)]
    lows = F.array(*(F.coalesce(F.expr(f"({s} + pmod({s}, 2)) div 2"), F.lit(1)) for s in of))
    highs = F.array(*(F.coalesce(F.expr(f"{s} - ({s} + pmod(-{s}, 20)) div 20"), F.lit(0)) for s in of))
    windows = scores.select("row", lows.alias("lows"), highs.alias("highs"))
    second = anchors.join(windows, "row")
    far = search(packed(second), candidates, width, negatives, same=False)

    pairs = near.select(
        "row", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    far = far.withColumnRenamed("score", "negative_score").join(pairs, ["row", "window"])

    def known(name):
        return F.when(F.col(name) != NO_ID, F.col(name))

    return far.select(
        F.col("vec_id").alias("anchor_id"), known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("found_id").alias("negative_id"), "positive_score", "negative_score",
    )
