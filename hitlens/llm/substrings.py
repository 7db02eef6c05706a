"""Repeated passages: windows of words that occurred before, and the words they cover.

The windows of ``WINDOW`` words are the edges of a De Bruijn graph of the corpus. It is not built edge by edge: as
in compaction with minimisers, every window is filed under the least hash of its ``PART`` word parts, and
consecutive windows under the same part stay one path (a piece). Pieces meet by that hash in one join of the corpus
with itself (a shuffle and a sort): there each window is compared with those before it in source order, and what
repeats of a piece leaves as one span. A second join, with the documents by source coordinates, glues the spans of
neighbouring pieces to maximal ones.

Equal pieces are folded where they are made, so a passage in a third of all documents is compared once per chunk
of input. A part that stands in very many different pieces is heavy; its windows are filed one by one under their
own hash. The heavy parts are estimated from a sample: which they are changes where windows meet, not the result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import shuffle_partitions, text_of
from hitlens.session import land

WINDOW, PART = 20, 6
CHUNK = 2**17
HASH_BYTES = 6  # of a window, beside the 64 bits of the part it is filed under
HEAVY_SAMPLE, HEAVY_PER_RANGE, LEAST_HEAVY = 0.05, 4, 32
LAST = 2**63 - 1

_rng = np.random.default_rng(20240301)
_steps = _rng.integers(1, 2**63, PART, dtype=np.uint64) * 2 + 1
_offsets = [*range(0, WINDOW - PART, PART), WINDOW - PART]
_window_steps = _rng.integers(1, 2**63, len(_offsets), dtype=np.uint64) * 2 + 1
_piece_steps = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * 2 + 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and number of windows of each piece of a text, and the hashes of all windows."""
    count = len(words) - WINDOW + 1
    if count < 1:
        empty = np.zeros(0, np.uint64)
        return empty, np.zeros(0, np.int64), np.zeros(0, np.int64), empty
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - PART + 1
    parts = np.zeros(n, np.uint64)
    for k in range(PART):
        parts += hashes[k : k + n] * _steps[k]
    parts = mixed(parts)
    windows = np.zeros(count, np.uint64)
    for k, offset in enumerate(_offsets):
        windows += parts[offset : offset + count] * _window_steps[k]
    # The first least part of a window: the same place in equal windows.
    least = np.lib.stride_tricks.sliding_window_view(parts, WINDOW - PART + 1).argmin(axis=1) + np.arange(count)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return parts[least[starts]], starts, np.diff(np.append(starts, count)), mixed(windows)


PIECE_SCHEMA = "part long, doc long, row long, start int, n int, windows binary"
PIECE_ARROW = pa.schema(
    [("part", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
    + [("windows", pa.binary())]
)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _folded(part, doc, row, start, n, windows) -> pa.RecordBatch:
    """A batch of pieces; of equal ones only the first keeps its windows, the others are known to repeat it."""
    begins = np.cumsum(n) - n
    whole = np.add.reduceat(windows * _piece_steps[_within(n)], begins) + n.astype(np.uint64)
    order = np.lexsort((start, row, doc, whole, part))
    again = np.zeros(len(part), bool)
    again[order[1:]] = (part[order[1:]] == part[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
    kept = np.repeat(~again, n)
    data = windows[kept].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
    offsets = np.concatenate([[0], np.cumsum(np.where(again, 0, n) * HASH_BYTES)]).astype(np.int32)
    # Known repetitions meet nobody: any part will do, and a hash of the place spreads them.
    part = np.where(again, mixed(row.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), part)
    binary = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    columns = [pa.array(part.astype(np.int64)), pa.array(doc), pa.array(row)]
    columns += [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), binary]
    return pa.RecordBatch.from_arrays(columns, schema=PIECE_ARROW)


def _spread(found: list, heavy: np.ndarray) -> pa.RecordBatch:
    part, doc, row, start, n, windows = (np.concatenate(column) for column in zip(*found))
    if len(heavy) and (much := np.isin(part, heavy)).any():
        one = np.repeat(much, n)
        alone = [np.repeat(column[much], n[much]) for column in (doc, row, start)]
        alone[2] = alone[2] + _within(n[much])
        extra = [mixed(windows[one]), *alone, np.ones(one.sum(), np.int64), windows[one]]
        rest = [part[~much], doc[~much], row[~much], start[~much], n[~much], windows[~one]]
        part, doc, row, start, n, windows = (np.concatenate(pair) for pair in zip(rest, extra))
    return _folded(part, doc, row, start, n, windows)


def _pieces(heavy, batches):
    found, size = [], 0
    for batch in batches:
        for row, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part, starts, n, windows = pieces(raw.as_py().split())
            if not len(part):
                continue
            found.append((part, np.full(len(part), doc), np.full(len(part), row), starts, n, windows))
            size += len(part)
            if size >= CHUNK:
                yield _spread(found, heavy)
                found, size = [], 0
    if found:
        yield _spread(found, heavy)


SPAN_SCHEMA = "row long, begin int, end int"
SPAN_ARROW = pa.schema([("row", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def _repeated(batches):
    """Spans of words under windows seen before; pieces come sorted by part and source order.

    Of a part that goes on in the next batch the windows seen are remembered.
    """
    before, seen = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        part, row = batch.column(0).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
        start, n = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
        column = batch.column(5)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
        counts = np.diff(offsets) // HASH_BYTES
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HASH_BYTES)
        padded = np.zeros((len(raw), 8), np.uint8)
        padded[:, :HASH_BYTES] = raw
        windows = padded.view(np.uint64).ravel()
        owner = np.repeat(np.arange(len(part)), counts)
        again = np.ones(len(windows), bool)
        again[np.unique(mixed(part[owner] * _steps[0] + windows), return_index=True)[1]] = False
        here = part[owner] == part[-1]
        if before is not None and part[0] == before:
            first = part[owner] == before
            again[first] |= np.isin(windows[first], seen)
        last = np.unique(windows[here])
        seen = np.union1d(seen, last) if before is not None and part[-1] == before else last
        before = part[-1]

        places = np.flatnonzero(again)
        owners = owner[places]
        at = start[owners] + _within(counts)[places]
        new = np.ones(len(places), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (at[1:] != at[:-1] + 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(places)) - 1 if len(places) else firsts
        known = np.flatnonzero(counts == 0)
        rows = np.concatenate([row[owners[firsts]], row[known]])
        begin = np.concatenate([at[firsts], start[known]])
        end = np.concatenate([at[lasts], start[known] + n[known] - 1]) + WINDOW
        columns = [pa.array(rows), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, schema=SPAN_ARROW)


def _numbered(docs: DataFrame) -> DataFrame:
    # Documents in source order: by id, rows without one last, rows of one id in the order they are stored.
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        text_of().cast("binary").alias("raw"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )


def heavy_parts(rows: DataFrame, ranges: int) -> np.ndarray:
    """Parts with more of the sampled pieces than a share of a range: at most ``4 * ranges`` of them."""
    sampled = rows.sample(HEAVY_SAMPLE, seed=1).mapInArrow(partial(_pieces, np.zeros(0, np.uint64)), PIECE_SCHEMA)
    counts = land(sampled.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sampled-parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(LEAST_HEAVY, total / (HEAVY_PER_RANGE * ranges))
    found = counts.where(F.col("n") >= share).select("part").collect()
    return np.array(sorted(row[0] for row in found), np.int64).astype(np.uint64)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row, spans: per row of ``docs`` with any, the words (begin, end) under windows that occurred before."""
    ranges = shuffle_partitions(docs.sparkSession)
    rows = _numbered(docs).select("row", "doc", "raw")
    made = rows.mapInArrow(partial(_pieces, heavy_parts(rows, ranges)), PIECE_SCHEMA)
    met = made.repartition(ranges, "part").sortWithinPartitions("part", "doc", "row", "start")
    spans = met.mapInArrow(_repeated, SPAN_SCHEMA)
    # Spans of one document, at most one per window of it.
    return spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(batches):
    for batch in batches:
        columns = [[], [], []]
        for raw, spans in zip(batch.column(1), batch.column(2)):
            words = raw.as_py().split()
            edges = np.zeros(len(words) + 1, np.int64)
            if spans.is_valid and len(spans):
                values = spans.values
                np.add.at(edges, values.field("begin").to_numpy(), 1)
                np.add.at(edges, values.field("end").to_numpy(), -1)
            stays = np.cumsum(edges)[:-1] == 0
            kept = words if stays.all() else [words[k] for k in np.flatnonzero(stays).tolist()]
            columns[0].append(len(words))
            columns[1].append(len(words) - len(kept))
            columns[2].append(b" ".join(kept).decode("utf-8"))
        arrays = [pa.array(c, f.type) for c, f in zip(columns, list(KEPT_ARROW)[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=KEPT_ARROW)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by blanks) for every row of ``docs``.

    ``docs`` is a stored table. Null and empty texts have no words. Texts shorter than a window lose nothing.
    """
    texts = _numbered(docs).select("row", "doc_id", "raw")
    joined = texts.join(repeated_spans(docs), "row", "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(_kept, KEPT_SCHEMA)

