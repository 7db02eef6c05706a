"""Documents that hold benchmark items, as they are or with other numbers and names.

Words are canonicalised: punctuation at their ends goes, numbers, units after numbers and capitalised words become
typed placeholders (slots), the rest is lower-cased. A window is ``WINDOW`` such words in a row (an item with fewer
is one window). In scripts without blanks every character is a word. Windows exist in two forms: literal, with every
word, and as a template, with placeholders for slots. Items of fewer than ``LEAST_WORDS`` words are looked for in
literal form only, and those that say too little (``LEAST_SPOKEN``) as a whole line or a whole document.

Documents' windows join the benchmark's by a hash and then by their full canonical text. Where a document follows an
item (same distance between the places in both), names must be consistent: one name of the item always becomes one
name of the document, and different names stay different. Every number and unit is a slot of its own. Templates with
any plain word join; what they tell is decided along the distance, by the plain words met there or by the share of
the item's windows met. Templates of slots only are compared along distances found so, never all with all.

Before the join, documents' windows pass a bit map of the benchmark's hashes. Its size is fixed; with a very large
benchmark it lets more windows through, and the join decides as before.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import text_of
from hitlens.session import land

WINDOW = 13
LEAST_WORDS = 5
# With fewer words, or fewer than LEAST_WORDS where characters are words, an item is met only by a whole line or text.
LEAST_SPOKEN = 3
LINE = "\n"
# Template windows count if those along one distance hold as many plain words as this share of a window, or if they
# hold any and are this share of the item's windows.
PLAIN_SHARE = 0.6
MET_SHARE = 0.5
MAP_BITS = 24

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
UNITS = (
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards "
    "mile miles g kg mg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs l ml liter "
    "liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours hr hrs day days week "
    "weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius "
    "fahrenheit kelvin watt watts volt volts amp amps joule joules newton newtons mph kph kmh hz khz mhz ghz kb mb gb tb"
).split()
DROPPED, PLAIN, NUMBER, UNIT, NAME = range(5)
MARKS = ("", "", "<number>", "<unit>", "<name>")

_edges = re.compile(r"^[\W_]+|[\W_]+$")
_number = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*(?:st|nd|rd|th|%|[a-z]{1,3})?", re.I)
_special = dict.fromkeys(NUMBER_WORDS, NUMBER) | dict.fromkeys(UNITS, UNIT)
_hash = xxhash.xxh3_64_intdigest
# One character, in UTF-8, of Thai to Tibetan, Myanmar, Khmer, CJK and kana with their punctuation and full-width forms.
_unspaced = re.compile(
    rb"\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}"
    rb"|\xef[\xa4-\xab\xbc-\xbe][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
)
_BASE = 0x9E3779B97F4A7C15


def canonical(word: str) -> tuple[str, int]:
    """Lower-case core of a written word and its kind; a unit counts only behind a number."""
    core = word if word.isalnum() else _edges.sub("", word)
    if not core:
        # A vowel sign is a word of its own where characters are.
        if len(word) == 1 and unicodedata.category(word)[0] == "M" and _unspaced.fullmatch(word.encode()):
            return word, PLAIN
        return "", DROPPED
    lower, first = core.lower(), core[0]
    if "0" <= first <= "9":
        return lower, NUMBER if _number.fullmatch(core) else PLAIN
    kind = _special.get(lower)
    if kind is None:
        kind = NAME if first.isupper() and core[1:].islower() else PLAIN
    return lower, kind


class Vocabulary(dict):
    """Numbers of written words (as bytes), with their canonical forms, for ``most`` words or so at a time."""

    def __init__(self, most: int = 600_000):
        self.most = most
        self.kinds, self.hashes = np.zeros(2**16, np.int8), np.zeros(2**16, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.cores: list[str] = []
        self._new: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        core, kind = canonical(word.decode("utf-8"))
        number = self[word] = len(self.cores)
        self.cores.append(core)
        self._new.append((kind, _hash(core)))
        return number

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, kinds and hashes of words."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._new:
            end = len(self.cores)
            if end > len(self.kinds):
                self.kinds, self.hashes = (np.concatenate([x, np.zeros(end, x.dtype)]) for x in (self.kinds, self.hashes))
            kinds, hashes = zip(*self._new)
            self.kinds[end - len(kinds) : end] = kinds
            self.hashes[end - len(kinds) : end] = np.array(hashes, np.uint64)
            self._new = []
        return numbers, self.kinds[numbers], self.hashes[numbers]


_vocabulary = Vocabulary()
_mark_hashes = np.array([_hash(mark) for mark in MARKS], np.uint64)


def _sums(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` values in a row, from hashes of 1, 2, 4, .. values."""
    count = max(0, len(values) - width + 1)
    total, offset, size, block = np.zeros(count, np.uint64), 0, 1, values
    while size <= width:
        if width & size:
            total += block[offset : offset + count] * np.uint64(pow(_BASE, offset, 2**64))
            offset += size
        block = block[:-size] + block[size:] * np.uint64(pow(_BASE, size, 2**64))
        size *= 2
    total = (total ^ total >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(29)


def spaced(raw: bytes) -> tuple[bytes, bool]:
    """The text with blanks around characters of scripts without blanks, and whether there are any."""
    if raw.isascii():
        return raw, False
    leads = np.frombuffer(raw, np.uint8)
    # E2 leads quotes and dashes.
    if not ((leads >= 0xE0) & (leads != 0xE2)).any():
        return raw, False
    raw, count = _unspaced.subn(rb" \g<0> ", raw)
    return raw, count > 0


def windows_of(raw: bytes, lengths, wanted=None, whole: bool = False, lines=()) -> list[tuple]:
    """(hash, place, window, slots, spots, count) of a text in UTF-8, in both forms, where ``wanted`` (a test of hashes)
    allows. ``spots`` are the places of the slots in the text, ``count`` is the text's number of windows of that width.

    ``whole``: only windows of the text's own length, if that is less than the longest of ``lengths``. ``lines``: numbers
    of words of which lines, and the text, are windows too, marked ``LINE``; with ``whole``, those of texts that say too
    little.
    """
    vocabulary = _vocabulary
    if len(vocabulary.cores) > vocabulary.most:
        vocabulary.forget()
    raw, unspaced = spaced(raw)
    # bytes.split knows the six white space characters of ASCII.
    numbers, kind, plain = vocabulary.of(raw.split())
    said = kind != DROPPED
    if not whole and lines:
        ends = np.cumsum([0] + [len(line.split()) for line in raw.splitlines()])
        ends = np.concatenate([[0], np.cumsum(said)])[ends]
    if not said.all():
        numbers, kind, plain = numbers[said], kind[said], plain[said]
    if whole:
        lengths, ends = [min(len(numbers), max(lengths))], np.array([0])
        if lengths[0] < (LEAST_WORDS if unspaced else LEAST_SPOKEN):
            lengths, lines = [], lines and lengths if len(numbers) else ()
        else:
            lines = ()
    found = []
    for width in lines:
        at = set(ends[:-1][np.diff(ends) == width].tolist()) | ({0} if width == len(numbers) else set())
        at = np.array(sorted(at), np.int64)
        sums = ~_sums(plain, width)[at]
        for k in np.flatnonzero(np.ones(len(sums), bool) if wanted is None else wanted(sums)).tolist():
            words = [vocabulary.cores[n] for n in numbers[at[k] : at[k] + width].tolist()]
            found.append((int(sums[k].astype(np.int64)), int(at[k]), LINE + " ".join(words), [], [], 1))
    unit = kind == UNIT
    if unit.any():
        behind = np.zeros(len(kind), bool)
        behind[1:] = kind[:-1] == NUMBER
        kind[unit & ~behind] = PLAIN
    slot = kind > PLAIN
    template = np.where(slot, _mark_hashes[kind], plain)
    slots = np.concatenate([[0], np.cumsum(slot)])
    for width in lengths:
        if width > len(numbers):
            continue
        for form, values, allowed in ((0, plain, None), (1, template, slots[width:] > slots[:-width])):
            if form and width < LEAST_WORDS:
                continue
            sums = _sums(values, width)
            hit = np.ones(len(sums), bool) if wanted is None else wanted(sums)
            for at in np.flatnonzero(hit if allowed is None else hit & allowed).tolist():
                words = [vocabulary.cores[n] for n in numbers[at : at + width].tolist()]
                held, spots = [], []
                if form:
                    for k, one in enumerate(kind[at : at + width].tolist()):
                        if one > PLAIN:
                            held.append(f"{MARKS[one]}{words[k]}")
                            spots.append(at + k)
                            words[k] = MARKS[one]
                found.append((int(sums[at].astype(np.int64)), at, " ".join(words), held, spots, len(sums)))
    return found


SCHEMA = "id long, hash long, place int, window string, slots array<string>, spots array<int>, count int"
ARROW = pa.schema(
    [("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("window", pa.string())]
    + [("slots", pa.list_(pa.string())), ("spots", pa.list_(pa.int32())), ("count", pa.int32())]
)


def _windows(lengths, bits=None, whole=False, lines=()):
    def wanted(sums):
        where = bits.value
        first, second = sums & np.uint64(2**MAP_BITS - 1), sums >> np.uint64(64 - MAP_BITS)
        return where[first.astype(np.int64)] & where[second.astype(np.int64)]

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(key, *row) for row in windows_of(raw.as_py(), lengths, bits and wanted, whole, lines)]
            columns = list(zip(*rows)) or [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return run


def _bit_map(windows: DataFrame):
    """Bits of all hashes, two each, gathered as at most 2**18 words of 64 bits."""
    low = F.col("hash").bitwiseAND(2**MAP_BITS - 1)
    high = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    places = windows.select(F.explode(F.array(low, high)).alias("bit"))
    # 63 bits a word, so that no power of two overflows.
    words = places.groupBy(F.floor(F.col("bit") / 63).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("bits")
    )
    found = np.zeros(2**MAP_BITS + 63, bool)
    for row in words.toLocalIterator():
        at = row["word"] * 63
        found[at : at + 63] |= np.array([row["bits"] >> k & 1 for k in range(63)], bool)
    return windows.sparkSession.sparkContext.broadcast(found[: 2**MAP_BITS])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, lines: bool = False) -> DataFrame:
    """One row per document and item it holds a window of: doc_id, item_id, n_windows, n_literal, n_changed.

    ``n_windows`` counts places of the item, ``n_literal`` those met word for word, ``n_changed`` slots with
    another value. ``lines``: look for items that say too little, as whole lines or documents; without it they are not
    looked for. Null or empty texts hold nothing. Repeated rows count once.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), text_of().cast("binary").alias("raw"))
    little = range(1, LEAST_WORDS) if lines else ()
    items = land(items.mapInArrow(_windows([window], whole=True, lines=little), SCHEMA), "benchmark-windows")
    # One length per item shorter than a window: at most ``window`` lengths.
    kinds = items.select(F.size(F.split("window", " ")).alias("n"), F.col("window").startswith(LINE).alias("line"))
    kinds = kinds.distinct().collect()
    lengths, little = ([row["n"] for row in kinds if row["line"] == line] for line in (False, True))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().cast("binary").alias("raw"))
    met = rows.mapInArrow(_windows(lengths, _bit_map(items), lines=little), SCHEMA)
    met = met.drop("spots", "count")

    theirs = items.select(
        "hash", "window", F.col("id").alias("item_id"), F.col("place").alias("item_place"),
        F.col("slots").alias("asked"), F.col("spots").alias("asked_spots"), F.col("count").alias("n_item"),
    )
    # Windows made of slots only, as number tables are full of, say nothing alone: where a document follows an item
    # otherwise, they are looked up at that distance, one place each.
    words = F.size(F.split("window", " "))
    bare, asked_bare = F.size("slots") == words, F.size("asked") == words
    bare_items = theirs.where(asked_bare)
    any_bare = not bare_items.isEmpty()
    if any_bare:
        met = land(met, "met-windows")  # read twice below
    spoken = met.where(~bare).join(theirs.where(~asked_bare), ["hash", "window"])
    if any_bare:
        shifts = spoken.select("id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
        along = shifts.join(bare_items, "item_id").withColumn("place", F.col("shift") + F.col("item_place"))
        along = along.withColumnRenamed("id", "doc").drop("shift")
        there = met.where(bare).join(along, ["place", "hash", "window"]).where(F.col("id").eqNullSafe(F.col("doc")))
        spoken = spoken.unionByName(there.drop("doc"))

    last = F.col("item_place") + F.size(F.split("window", " ")) - 1
    pairs = spoken.select(
        F.col("id").alias("doc_id"),
        "item_id",
        "n_item",
        "item_place",
        (F.col("place") - F.col("item_place")).alias("shift"),
        F.size("asked").alias("n_slots"),
        F.arrays_zip(F.col("asked_spots").alias("at"), F.col("asked").alias("a"), F.col("slots").alias("b")).alias("pairs"),
        F.array_except(F.sequence("item_place", last), "asked_spots").alias("plain"),
    )
    # What a group gathers is bounded by the item's own length.
    along = pairs.groupBy("doc_id", "item_id", "n_item", "shift").agg(
        F.collect_set("item_place").alias("places"),
        F.collect_set(F.when(F.col("n_slots") == 0, F.col("item_place"))).alias("literal"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.size(F.array_distinct(F.flatten(F.collect_set("plain")))).alias("n_plain"),
    )
    # Names are slots by value, numbers and units by place.
    is_name = lambda p: p["a"].startswith(MARKS[NAME])
    names = F.array_distinct(
        F.transform(F.filter("pairs", is_name), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    )
    along = along.withColumns({"names": names, "others": F.filter("pairs", lambda p: ~is_name(p))})
    one_to_one = [F.size("names") == F.size(F.array_distinct(F.col("names")[side])) for side in "ab"]
    much = F.col("n_plain") >= math.ceil(PLAIN_SHARE * window)
    most = (F.col("n_plain") > 0) & (F.size("places") >= MET_SHARE * F.col("n_item"))
    along = along.withColumn("follows", one_to_one[0] & one_to_one[1] & (much | most))
    told = along.withColumn("places", F.when(F.col("follows"), F.col("places")).otherwise(F.col("literal")))
    told = told.where(F.size("places") > 0)
    changed = sum(F.size(F.filter(slots, lambda p: p["a"] != p["b"])) for slots in ("names", "others"))
    return told.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("literal")))).cast("long").alias("n_literal"),
        F.min(F.when(F.col("follows"), changed).otherwise(0)).cast("long").alias("n_changed"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a benchmark item; a row without an id stays."""
    found = land(leaks(docs, benchmark, lines=True).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
