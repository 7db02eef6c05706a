"""Secrets in texts, with guess costs for values that follow a credential's name.

Three fixed patterns give the base spans. Beside them, every value in the context of a credential is priced: the
cheapest way to put it together from known words, dates, repeats, walks on a keyboard and single characters
(brute force), by dynamic programming over its characters. A value whose cheapest way costs ``MIN_BITS`` or more
is a secret, unless a base span holds it whole; placeholders (``password: changeme123``) are cheap.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import text_of

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

# Names of credentials, the base ones included; what follows may be any characters up to a blank or the quote.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credentials?|"""
    r"""(?:private|access|signing|encryption|client|account|auth|master)[_-]?key|bearer|auth)"""
    r"""["']?[\x20\t]*(?:[:=]|=>)[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>]+))""",
    re.I | re.A,
)
# A bearer's value follows a blank.
BEARER = re.compile(r"""bearer[\x20\t]+(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>]+))""", re.I | re.A)
CONTEXT_HINT = re.compile("pass|pwd|secret|token|key|credential|bearer|auth", re.I | re.A)
MIN_BITS, LEAST_VALUE = 38.0, 8

# Common parts of chosen passwords and of placeholders, the most common first; a word costs its rank.
COMMON_WORDS = (
    "password pass word admin root user login welcome change changeme default test example secret token key "
    "qwerty letmein master dragon monkey shadow sunshine princess football baseball iloveyou love hello "
    "freedom whatever trustno superman batman michael jordan hunter killer summer winter spring autumn "
    "monday friday sunday january march april june july august october november december "
    "your my the this here none null true false undefined placeholder insert enter value string text "
    "sample dummy demo temp foo bar baz abc xyz server database data backup service system public private "
    "account access auth api client app web http https www com org net local host dev prod staging"
).split()
WORD_BITS = {word: math.log2(rank + 2) for rank, word in enumerate(COMMON_WORDS)}
LONGEST_WORD = max(map(len, COMMON_WORDS))
LEET = str.maketrans("@4301!57$", "aaeoiists"[:9])
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LINES = (*KEYBOARD, "abcdefghijklmnopqrstuvwxyz", "0123456789")
STEPS = {a + b for line in LINES for a, b in zip(line, line[1:])}
STEPS |= {b + a for a, b in STEPS}
STEPS |= {a + b for upper, lower in zip(KEYBOARD, KEYBOARD[1:]) for a, b in zip(upper, lower)}
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]|[1-9])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)
DATE_BITS = {4: 7.0, 6: 15.5}
LONGEST_PERIOD = 8


def char_bits(char: str) -> float:
    """Bits to guess one character of its class."""
    if char.isdigit():
        return math.log2(10)
    if char.isalpha() and char.isascii():
        return math.log2(26) + (0.3 if char.isupper() else 0.0)
    return math.log2(33) if char.isascii() else math.log2(1000)


def guess_bits(value: str) -> float:
    """Bits of the cheapest segmentation of ``value``.

    Time follows the length: words and dates are short, a walk or a repeat is taken from its start to its end,
    and brute force goes one character at a time.
    """
    n, lower = len(value), value.lower()
    plain = lower.translate(LEET)
    if len(lower) != n:  # lower-casing may lengthen letters outside ASCII
        lower = plain = value
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    singles = [char_bits(char) for char in value]
    prefix = [0.0]
    for bits in singles:
        prefix.append(prefix[-1] + bits)
    # Where the walk, and the repeat of each period, from a place ends.
    walk = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if lower[i : i + 2] in STEPS:
            walk[i] = walk[i + 1]
    run = [[0] * (n + 1) for _ in range(LONGEST_PERIOD + 1)]
    for period in range(1, LONGEST_PERIOD + 1):
        lengths = run[period]
        for i in range(n - period - 1, -1, -1):
            if value[i] == value[i + period]:
                lengths[i] = lengths[i + 1] + 1
    for i in range(n):
        here = best[i]

        def reach(end: int, bits: float) -> None:
            if here + bits < best[end]:
                best[end] = here + bits

        reach(i + 1, singles[i])
        for end in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            bits = WORD_BITS.get(plain[i:end])
            if bits is not None:
                written = value[i:end]
                extra = 0.0 if written == lower[i:end] else 1.0 if written.istitle() or written.isupper() else end - i
                reach(end, bits + extra + (0.0 if plain[i:end] == lower[i:end] else 2.0) + 1.0)
        if walk[i] - i >= 3:
            reach(walk[i], math.log2(47) + math.log2(walk[i] - i) + 1.0)
        for period in range(1, LONGEST_PERIOD + 1):
            copies = run[period][i]
            if copies >= max(2, period):
                block = prefix[i + period] - prefix[i]
                reach(i + period + copies, block + math.log2(copies / period + 1) + 1.0)
        if "0" <= value[i] <= "9" and (found := DATE.match(value, i)):
            reach(found.end(), DATE_BITS[4] if found.end() - i == 4 else DATE_BITS[6])
    return best[n]


cached_bits = lru_cache(maxsize=10_000)(guess_bits)


def find_spans(text: str, min_bits: float = MIN_BITS) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order; base spans, and guessed ones that lie in none of them whole."""
    found = []
    for match in ASSIGN.finditer(text):
        if len(match[2]) >= LEAST_ASSIGN:
            found.append((match.start(), 0, match.end()))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if len(match[0]) >= LEAST_ACCESS:
                found.append((match.start(), 1, match.end()))
    found += [(match.start(), 2, match.end()) for match in HEX.finditer(text)]
    found.sort()
    ends, latest = [], 0
    for _, _, end in found:  # greatest end so far, for spans sorted by start
        latest = max(latest, end)
        ends.append(latest)
    base = list(found)
    if CONTEXT_HINT.search(text):
        from bisect import bisect_right

        starts = [start for start, _, _ in base]
        values = {match.span(match.lastindex) for names in (CONTEXT, BEARER) for match in names.finditer(text)}
        for start, end in values:
            value = text[start:end]
            if len(value) < LEAST_VALUE:
                continue
            before = bisect_right(starts, start)
            if before and ends[before - 1] >= end:
                continue
            price = cached_bits if len(value) <= 256 else guess_bits
            if price(value) >= min_bits:
                found.append((start, 3, end))
        found.sort()
    return [(start, KINDS[kind], end) for start, kind, end in found]


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), *((name, pa.int64()) for name in ("n_assign", "n_access", "n_hex"))]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())]
)


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find_spans(text.as_py())
            written = [(kind, f"{kind}:{start}:{end}") for start, kind, end in spans]
            base = ",".join(span for kind, span in written if kind != "guess")
            kinds = [kind for kind, _ in written]
            rows.append(
                (
                    *(kinds.count(kind) for kind in KINDS[:3]),
                    hashlib.sha256(base.encode()).hexdigest(),
                    ",".join(span for _, span in written),
                    kinds.count("guess"),
                )
            )
        columns = list(zip(*rows)) or [()] * 6
        arrays = [pa.array(values, field.type) for values, field in zip(columns, list(ARROW)[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=ARROW)


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every whole text; one row per row of ``docs``, no shuffle. A null text is empty and has none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
