"""Groups of sorted Arrow batches, and connected components by joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hitlens.session import land


def groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of equal ``keys`` (numbers, not null) of batches that are sorted by them, group by group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy() for key in keys]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            key = tuple(column[start] for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def stars(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Links (node, smallest node reachable) that connect what the links ``a``, ``b`` connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x, up in parent.items() if x != up]
    return nodes, [root(x) for x in nodes]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (smallest node reachable) for every node of ``links`` (a, b).

    Alternating large and small stars: each step points nodes at the smallest neighbour they know. A step is an
    aggregation and a join; nothing is gathered per node. Ends when every node that has a smaller neighbour has no
    other one, so that links which are stars already cost one aggregation.
    """
    edges = land(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        loose = Observation()
        known = known.observe(loose, F.count_if(F.expr("low < a and low < high")).alias("n"))
        known = land(known.select("a", F.least("low", "a").alias("m")), "links-least")
        if not loose.get["n"]:
            return known.select(F.col("a").alias("node"), F.col("m").alias("label"))
        large = edges.join(known.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        large = land(large, "links-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = land(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links-small")
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")


FILTER_WORDS = 2**18


def narrowed(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``ids``, for a join that would shuffle all others too.

    Every id sets one bit of a map of ``FILTER_WORDS`` words, which is broadcast. No row of an id is lost; others pass
    by chance, more of them the more ids there are.
    """
    hashed = F.xxhash64(column)
    word, bit = F.pmod(hashed, F.lit(FILTER_WORDS)), F.shiftrightunsigned(hashed, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = ids.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    known = df.join(F.broadcast(words), word == F.col("_word")).where(F.col("_bits").bitwiseAND(one) != 0)
    return known.select(*df.columns)
