"""Sequences of at most ``CAPACITY`` tokens with little padding, by Karmarkar-Karp differencing.

Every task packs the documents of its own part of the table, so nothing is shuffled. A document is its token ids and an
end id. What it has beyond a multiple of the capacity is an item; the rest are full sequences of their own. Items are
packed a group at a time, ``GROUP`` to ``2 * GROUP`` windows of them. Each item starts as a partial partition: itself
in one window, the others empty. The two partial partitions of the largest imbalance are merged with opposing order,
the fullest window of one with the emptiest of the other, until one is left. Its windows are near-equal; while the
fullest exceeds the capacity, the whole is done again with a window more.

A sequence of a power of two needs no padding. Where padding would be felt, as in a group of few windows, the group
gives up some tokens of its longest items as sequences of such lengths, and what stays fills its windows. If that is
not enough, as with many items of a little over half a window, items are cut.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.codes import TEXTS_AT_ONCE, encoder
from hitlens.llm.common import text_of

END_ID, CAPACITY, GROUP = 2, 4096, 256
# Shares of padding a group is content with, one after another; the room per window it gives tokens up for, in grains.
FELT, ROOMS, GRAIN = (0.02, 0.1, float("inf")), (32, 64, 128, 256, 512), 64


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k - 1) of each of at least one item."""
    merges, heap, number = [], [], count(len(sizes))
    for item, size in enumerate(sizes.tolist()):
        sums, parts = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], parts[0] = size, item
        heap.append((-size, item, sums, parts))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, other_sums, other_parts = heapq.heappop(heap)
        total = sums + other_sums[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order] - total.min()
        merged = np.arange(made, made + k)
        made += k
        merges.append((merged, parts[order], other_parts[::-1][order]))
        heapq.heappush(heap, (-int(total[0]), next(number), total, merged))
    # The last place takes what is written for windows without a part.
    window = np.zeros(made + 1, np.int64)
    parts = heap[0][3]
    window[parts] = np.arange(k)
    for merged, left, right in reversed(merges):
        window[left], window[right] = window[merged], window[merged]
    return window[: len(sizes)]


def near_equal(sizes: np.ndarray, capacity: int, most: float) -> tuple[np.ndarray, int] | None:
    """Window of each item and the number of windows; the number rises until none is above ``capacity``.

    Nothing if that takes more than ``most`` windows.
    """
    if not len(sizes):
        return np.zeros(0, np.int64), 0
    # No window holds two items of more than half of it.
    k = max(-(-int(sizes.sum()) // capacity), int((sizes > capacity // 2).sum()))
    while k <= most:
        window = difference(sizes, k)
        beyond = np.maximum(np.bincount(window, sizes, k) - capacity, 0)
        if not beyond.any():
            return window, k
        k += max(1, int(beyond.sum()) // capacity)
    return None


def powers(total: int, most: int) -> list[int]:
    """Powers of two up to ``most``, one of them, that make up ``total``; the largest first."""
    rest = total % most
    return [most] * (total // most) + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def given_up(sizes: np.ndarray, total: int) -> np.ndarray:
    """Tokens that each item gives up, the longest first, ``total`` in all."""
    order = np.argsort(-sizes, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    given = np.zeros(len(sizes), np.int64)
    given[order] = np.clip(total - before, 0, sizes[order])
    return given


def cut(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start in it and length of pieces of ``longest`` tokens (the last of an item: the rest)."""
    n = -(-sizes // longest)
    item = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)) * longest
    return item, start, np.minimum(longest, sizes[item] - start)


def arranged(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Item, start and length of pieces, what each gives up, and the window of what stays.

    Items stay whole where that leaves little padding; else a part of the tokens is given up, then items are cut.
    """
    total = int(sizes.sum())
    for felt in FELT:
        for longest in (capacity, capacity // 4, capacity // 16):
            item, start, length = cut(sizes, max(longest, 1))
            for room in (None, *ROOMS):
                rest = 0 if room is None else total - total // capacity * max(capacity - room, 0)
                given = given_up(length, min(total, -(-rest // GRAIN) * GRAIN))
                stays = length > given
                most = ((1 + felt) * total - int(given.sum())) / capacity
                found = near_equal((length - given)[stays], capacity, most)
                if found:
                    window = np.full(len(length), -1)
                    window[stays] = found[0]
                    return item, start, length, given, window


def plan(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of parts (item, start, length) that hold every token of the items (1 to ``capacity`` each) once."""
    if not len(sizes):
        return []
    rows = [column.tolist() for column in arranged(sizes, capacity)]
    sequences = [[] for _ in range(max(rows[-1]) + 1)]
    cuts = []
    for item, start, length, given, window in zip(*rows):
        if length > given:
            sequences[window].append((item, start, length - given))
        if given:
            cuts.append((item, start + length - given, given))
    for size in powers(sum(length for _, _, length in cuts), capacity):
        sequences.append([])
        while size:
            item, start, length = cuts.pop()
            taken = min(size, length)
            sequences[-1].append((item, start, taken))
            if taken < length:
                cuts.append((item, start + taken, length - taken))
            size -= taken
    return sequences


PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long"
)
PIECE_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "length")] + [("ids", pa.binary())]
    + [(name, pa.int64()) for name in ("doc_tokens", "sequence_id", "offset", "padded")]
)


class Packer:
    """Rows of the pieces of the documents of one task, in order of their sequences."""

    def __init__(self, first: int, capacity: int, group: int):
        self.number, self.capacity, self.group = count(first), capacity, group
        self.rows: list[tuple] = []
        # (doc_id, start, length, ids, doc_tokens)
        self.items: list[tuple] = []
        self.waiting = 0

    def sequence(self, parts: list[tuple]) -> None:
        """Write (item, start in it, length) as one sequence."""
        number, offset, size = next(self.number), 0, sum(length for _, _, length in parts)
        padded = size if size & (size - 1) == 0 else self.capacity
        for (doc_id, start, _, ids, doc_tokens), at, length in parts:
            raw = ids[4 * at : 4 * (at + length)]
            self.rows.append((doc_id, start + at, length, raw, doc_tokens, number, offset, padded))
            offset += length

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, capacity = len(ids) // 4, self.capacity
        rest = tokens % capacity
        for start in range(0, tokens - rest, capacity):
            item = (doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], tokens)
            self.sequence([(item, 0, capacity)])
        if rest:
            self.items.append((doc_id, tokens - rest, rest, ids[4 * (tokens - rest) :], tokens))
            self.waiting += rest
        if self.waiting >= 2 * self.group * capacity:
            self.close(self.group * capacity)

    def close(self, tokens: int | None = None) -> None:
        """Pack the items that wait, or the first that hold ``tokens``."""
        sizes = np.array([item[2] for item in self.items], np.int64)
        stop = len(sizes) if tokens is None else int(np.searchsorted(np.cumsum(sizes), tokens)) + 1
        for parts in plan(sizes[:stop], self.capacity):
            self.sequence([(self.items[item], at, length) for item, at, length in parts])
        self.waiting -= int(sizes[:stop].sum())
        self.items = self.items[stop:]

    def taken(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in PIECE_ARROW]
        arrays = [pa.array(column, field.type) for column, field in zip(columns, PIECE_ARROW)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=PIECE_ARROW)


def _pieces(path: str, end_id: int, capacity: int, group: int):
    def run(batches):
        encode, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, group)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
                yield packer.taken()
        packer.close()
        yield packer.taken()

    return run


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, padded: every piece of every document.

    ``ids`` are the piece's token ids, little endian, four bytes each; ``padded`` is the length its sequence is padded
    to. ``capacity`` is a power of two. A null or empty text is the end id alone; a null doc_id stays null; rows of one
    id are documents of their own; extra columns are not read; an empty table gives no rows. Sequence ids are distinct,
    not gapless. How the table is split into tasks decides which documents meet; every split packs all tokens.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, capacity, group), PIECE_SCHEMA)


def padding(found: DataFrame) -> DataFrame:
    """n_sequences, tokens, padded: one row over the ``pieces`` of a table."""
    sequences = found.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.first("padded").alias("padded"))
    return sequences.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("tokens").alias("tokens"), F.sum("padded").alias("padded"))
