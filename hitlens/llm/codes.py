"""Token ids in directly addressable codes.

Every id is split into chunks of eight bits. Level 0 holds the low chunk of every id, level 1 the second chunk of
those ids that have one, and so on; a bitmap per level says which of its chunks continue, and a rank directory
(ones before every 512 bits) finds the place in the next level. Any token is read with one lookup per level, no
block is decoded.

A shard is the unit of the format: the documents of a stretch of the order, whole, about ``SHARD_TOKENS`` ids.
Shards are rows of a Parquet table (so they can be in any store Spark writes to) with the shard as one binary
value; ``part`` and ``seq`` give their order. Layout of a shard, little endian::

    b"DAC1"  u32 levels  u64 tokens  u64 documents  u64 document starts [documents + 1]
    per level:  u64 chunks   u8 chunk [chunks]   u8 bitmap [(chunks + 7) / 8]   u32 ones before [chunks / 512 + 1]
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from functools import partial
from itertools import chain, count, takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlens.llm.common import shuffle_partitions, text_of
from hitlens.session import work_path

END_ID = 1
SHARD_TOKENS = 2**18
RANK_BITS = 512
TEXTS_AT_ONCE = 256
MAGIC = b"DAC1"


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A shard of ``ids`` (below 2**32) whose documents begin at ``starts`` (and end at the last of them)."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = rest > 0xFF
        ones = np.concatenate([[0], np.cumsum(more, dtype=np.uint32)])
        levels.append(
            struct.pack("<Q", len(rest))
            + (rest & 0xFF).astype(np.uint8).tobytes()
            + np.packbits(more, bitorder="little").tobytes()
            + ones[: len(rest) + 1 : RANK_BITS].astype("<u4").tobytes()
        )
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<IQQ", len(levels), len(ids), len(starts) - 1) + starts.astype("<u8").tobytes()
    return head + b"".join(levels)


class Shard:
    """Reads a packed shard in place."""

    def __init__(self, packed: bytes):
        if packed[:4] != MAGIC:
            raise ValueError("not a shard")
        count, self.tokens, documents = struct.unpack_from("<IQQ", packed, 4)
        at = 24
        self.starts = np.frombuffer(packed, "<u8", documents + 1, at).astype(np.int64)
        at += 8 * (documents + 1)
        self.levels = []
        for _ in range(count):
            (chunks,) = struct.unpack_from("<Q", packed, at)
            at += 8
            parts = []
            for kind, n in (("u1", chunks), ("u1", (chunks + 7) // 8), ("<u4", chunks // RANK_BITS + 1)):
                parts.append(np.frombuffer(packed, kind, n, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : i // 8 + 1], bitorder="little")
            i = int(rank[block]) + int(bits[: i - block * RANK_BITS].sum())
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= values << 8
            values = here
        return values


# How a vocabulary file must treat a text for its pieces to be those of ``PieceEncoder``.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": "</w>",
}


def splits_into_pieces(tokenizer) -> bool:
    """Whether a tokenizer normalises and splits texts as ``PieceEncoder.pieces`` does."""
    told = json.loads(tokenizer.to_str())
    return (
        told["normalizer"] == NORMALIZER
        and told["pre_tokenizer"] == SPLITTER
        and told["post_processor"] is None
        and all(told["model"].get(name) == value for name, value in MODEL.items())
        and all(token["content"].startswith("<|") and not token["normalized"] for token in told["added_tokens"])
    )


class PieceEncoder:
    """Ids (little endian bytes) of texts, by pieces where the vocabulary encodes pieces one by one.

    Any vocabulary file gives its own ids: one that does not split texts as below encodes them whole, and a
    truncation or padding the file asks for is left out.

    Pieces are runs of letters, single digits, runs of other marks, and the endings ``'s`` and the like; white
    space is dropped and letters are lower-cased first. Pieces met before are remembered, ``most`` of them at a
    time: each has a number, by which its ids are found in one array. The new ones of some texts are encoded as one
    text, in which the last id of each carries the mark of a word's end; they are normalised and split already, so
    that is done by the file's model alone. That holds for texts of ASCII and western letters. Any other text is
    encoded as it is.
    """

    simple = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
    pieces = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\\[-`{-~]+")

    def __init__(self, path: str, most: int = 500_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.by_pieces = splits_into_pieces(tokenizer)
        self.encode = partial(getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch), add_special_tokens=False)
        if self.by_pieces:
            model = Tokenizer(tokenizer.model)
            model.normalizer = normalizers.Sequence([])
            model.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.encode_pieces = partial(getattr(model, "encode_batch_fast", model.encode_batch), add_special_tokens=False)
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[number for token, number in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.most, self.longest = most, longest
        self.forget()

    def forget(self) -> None:
        # Number of a piece; its ids are from starts[number] to starts[number + 1] in the table.
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.starts, self.table = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(code.ids, "<u4").tobytes() for code in self.encode(texts)]

    def together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces, and where those of each end."""
        ids = np.array(self.encode_pieces([" ".join(pieces)])[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            lists = self.one_by_one(pieces)
            ids, stops = np.frombuffer(b"".join(lists), "<u4"), np.cumsum([len(one) // 4 for one in lists])
        return ids, stops

    def learn(self) -> None:
        """Ids of the pieces that have a number and no place in the table yet, which are the latest."""
        told = len(self.starts) - 1
        new = [piece for piece, _ in takewhile(lambda item: item[1] >= told, reversed(self.known.items()))][::-1]
        if new:
            ids, stops = self.together(new)
            self.starts = np.concatenate([self.starts, stops + len(self.table)])
            self.table = np.concatenate([self.table, ids])
        for piece in new:
            if len(piece) > self.longest:
                del self.known[piece]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some texts."""
        if not self.by_pieces:
            return self.one_by_one(texts)
        if len(self.starts) > self.most or len(self.table) > 16 * self.most:
            self.forget()
        # A special token of the vocabulary may begin with these two marks.
        plain = [self.simple.fullmatch(text) is not None and "<|" not in text for text in texts]
        lists = [self.pieces.findall(text.lower()) for text, one in zip(texts, plain) if one]
        sizes = [len(pieces) for pieces in lists]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, sum(sizes))
        self.learn()
        first = self.starts[numbers]
        ends = np.cumsum(self.starts[numbers + 1] - first)
        lengths = np.diff(ends, prepend=0)
        places = np.arange(lengths.sum()) + np.repeat(first - ends + lengths, lengths)
        raw = self.table[places].tobytes()
        stops = (4 * np.concatenate([[0], ends])[np.cumsum([0, *sizes])]).tolist()
        found = iter([raw[a:b] for a, b in zip(stops, stops[1:])])
        others = iter(self.one_by_one([text for text, one in zip(texts, plain) if not one]))
        return [next(found if one else others) for one in plain]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, shard binary"
SHARD_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("shard", pa.binary())]
)


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches):
        encode, part, seq = encoder(path).ids, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, starts, docs = [], [0], []

        def closed():
            nonlocal seq
            tokens = np.frombuffer(b"".join(ids), "<u4")
            row = [[part], [seq], [len(tokens)], [list(docs)], [pack(tokens, np.array(starts))]]
            seq += 1
            ids.clear(), docs.clear(), starts.__setitem__(slice(None), [0])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SHARD_ARROW)], schema=SHARD_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part_of = batch.slice(at, TEXTS_AT_ONCE)
                for doc_id, found in zip(part_of.column(0).to_pylist(), encode(part_of.column(1).to_pylist())):
                    ids.append(found + end)
                    docs.append(doc_id)
                    starts.append(starts[-1] + len(ids[-1]) // 4)
                    if starts[-1] >= shard_tokens:
                        yield closed()
        if docs:
            yield closed()

    return run


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode all texts in ascending doc_id order (null last; equal ids by text) and write the shards to ``path``.

    Rows are dealt to ranges of ids, equal ids over several if they are many. A null or empty text is the end id alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    ranges = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), order, F.xxhash64("text"))
    ranges = ranges.sortWithinPartitions(order, F.xxhash64("text"), "text")
    ranges.mapInArrow(_shards(vocabulary, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def shard_places(shards: DataFrame) -> DataFrame:
    """part, seq, n_tokens, first: the number of ids before each shard. Parts are summed first."""
    before = Window.unboundedPreceding, -1
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", F.sum("tokens").over(Window.orderBy("part").rowsBetween(*before)).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before))
    sizes = shards.select("part", "seq", "n_tokens", inside.alias("inside")).join(parts, "part")
    first = (F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("first")
    return sizes.select("part", "seq", "n_tokens", first)


def stored_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


DOCUMENT_SCHEMA = "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"
DOCUMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32())]
    + [(name, pa.int64()) for name in ("doc_id", "start", "n_tokens", "ids_crc32")]
)


def _documents(batches):
    for batch in batches:
        for part, seq, doc_ids, packed in zip(*(batch.column(name) for name in ("part", "seq", "doc_ids", "shard"))):
            shard = Shard(packed.as_py())
            ids, starts = shard.all().astype("<u4"), shard.starts
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            place = [np.full(len(sums), part.as_py()), np.full(len(sums), seq.as_py())]
            columns = [*place, doc_ids.as_py(), starts[:-1], np.diff(starts), sums]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, DOCUMENT_ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, schema=DOCUMENT_ARROW)


def documents(spark, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32. The shards are read in place."""
    shards = stored_shards(spark, path)
    rows = shards.mapInArrow(_documents, DOCUMENT_SCHEMA)
    places = shard_places(shards).select("part", "seq", "first")
    start = (F.col("start") + F.col("first")).alias("start")
    return rows.join(places, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32")


def _looked_up(batches):
    for batch in batches:
        found = []
        for packed, places in zip(batch.column("shard"), batch.column("places")):
            shard = Shard(packed.as_py())
            found.append([shard[place] for place in places.as_py()])
        rows = pa.table({"position": batch.column("positions"), "ids": pa.array(found, pa.list_(pa.int64()))})
        yield from rows.to_batches()


def tokens_at(spark, path: str, positions: DataFrame, cell: int = SHARD_TOKENS) -> DataFrame:
    """position, id: single ids by their place among all, without decoding shards."""
    shards = stored_shards(spark, path)
    spread = shard_places(shards).where("n_tokens > 0").select(
        "part", "seq", "first", "n_tokens",
        F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("n_tokens") - 1) / cell)))
        .alias("cell"),
    )
    wanted = positions.select("position", F.floor(F.col("position") / cell).alias("cell"))
    hits = wanted.join(spread, "cell").where("position >= first and position < first + n_tokens")
    # A look-up loads a shard once for at most this many places.
    groups = hits.groupBy("part", "seq", F.pmod(F.xxhash64("position"), F.lit(64)).alias("salt")).agg(
        F.collect_list("position").alias("positions"), F.first("first").alias("first")
    )
    loaded = groups.join(shards.select("part", "seq", "shard"), ["part", "seq"]).select(
        "positions", "shard", F.transform("positions", lambda p: p - F.col("first")).alias("places")
    )
    pairs = loaded.mapInArrow(_looked_up, "position array<long>, ids array<long>")
    return pairs.select(F.explode(F.arrays_zip("position", "ids")).alias("p")).select("p.position", F.col("p.ids").alias("id"))


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as shards to the shared folder and list the documents read back from them.

    Every row of ``docs`` gives one row, repeated rows and equal ids too. Only doc_id and text are read, whatever other
    columns are called. An empty table gives no rows.
    """
    path = work_path(docs.sparkSession, "codes")
    write_shards(docs, path, vocabulary, end_id)
    return documents(docs.sparkSession, path)
