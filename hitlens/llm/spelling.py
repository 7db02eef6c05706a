"""Spelling variants: words one edit apart, found by a frequency-vector trie.

A word's vector is its length and how often it has letters of each of ``GROUPS``. The trie branches on one of these
numbers after another. An edit changes a vector little: an inserted letter is a surplus of one in one group, a replaced
one a surplus in one and a deficit in another. So a search goes down the trie with a budget of one surplus and one
deficit. Of two near words the shorter one searches, or of equal length the one whose vector has the first deficit, so
a pair is met once.

Nodes of more than ``LEAF`` words are branched by Spark, a level at a time: every word goes to its own child, as a
searching word also to the children its budget reaches. Where all groups are used up (anagrams), a node branches by
halves: an edit leaves the first or the last half of the longer word as it is. The nodes that are left are searched in
tasks, depth first, for up to ``SEARCHES`` words at a time; what a leaf holds is verified letter by letter.
"""

from __future__ import annotations

from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import shuffle_partitions, text_of
from hitlens.llm.grouping import groups
from hitlens.session import broadcast_if_small, land

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
DELETE_EVERY = 97
# Letters of a level each; all others are one more.
GROUPS = "e a i o n t s r lu dc mpgb fhvwkjxyzq".split()
LEVELS = len(GROUPS) + 2
LEAF, SEARCHES = 4096, 16384
# Pairs whose vectors a task compares at a time, words of a node that need no more branching, letters compared in rows.
CELLS, FEW, WIDTH = 2**18, 32, 64


def words(docs: DataFrame, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, n: words of all texts with at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences.

    A run of letters is lower-cased (A-Z only); one whose checksum, taken with the row's id (null: none), is divisible
    by ``delete_every`` loses a letter. A null or empty text has no words, repeated rows count each.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("doc"), F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS)
    lower = runs.select("doc", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    marked = lower.withColumn("sum", F.crc32(F.concat_ws(":", "doc", "run")))
    place = F.pmod(F.col("sum"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    word = F.when(F.col("sum") % delete_every == 0, cut).otherwise(F.col("run"))
    counts = marked.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def vector(word: Column) -> Column:
    """Length, letters of each group, other letters."""
    counts = [F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS]
    rest = F.length(F.translate(word, "".join(GROUPS), ""))
    return F.array(F.length(word), *counts, rest)


# Where a word is in its search: an entry of the trie; same length: nothing used, a surplus, both; one longer: nothing, a surplus.
ENTRY, SAME, SAME_MORE, SAME_BOTH, LONGER, LONGER_MORE = range(6)


def children(level: int) -> Column:
    """Children (at, path) of a row with vector, at and path, for its number on ``level``."""
    own = F.get("vector", F.lit(level))

    def child(at: int, more: int) -> Column:
        return F.struct(F.lit(at).alias("at"), F.concat_ws("/", "path", own + more).alias("path"))

    if level == 0:
        search = F.array(child(SAME, 0), child(LONGER, 1))
    else:
        less = F.when(own > 0, F.array(child(SAME_MORE, 0), child(SAME_BOTH, -1)))
        search = (
            F.when(F.col("at") == SAME, F.array(child(SAME, 0), child(SAME_MORE, 1)))
            .when(F.col("at") == SAME_MORE, F.coalesce(less, F.array(child(SAME_MORE, 0))))
            .when(F.col("at") == SAME_BOTH, F.array(child(SAME_BOTH, 0)))
            .when(F.col("at") == LONGER, F.array(child(LONGER, 0), child(LONGER_MORE, 1)))
            .otherwise(F.array(child(LONGER_MORE, 0)))
        )
    return F.when(F.col("at") == ENTRY, F.array(child(ENTRY, 0))).otherwise(search)


def halves() -> Column:
    """Children by the first and the last half of the longer word, for nodes with all groups used."""
    longer = F.col("at").isin(LONGER, LONGER_MORE)
    length = F.length("word") + F.when(longer, 1).otherwise(0)
    first = F.floor(length / 2).cast("int")
    last = (length - first).cast("int")
    parts = {"p": F.col("word").substr(F.lit(1), first), "s": F.right("word", last)}
    return F.array(*(F.struct("at", F.concat_ws("/", "path", F.lit(k), v).alias("path")) for k, v in parts.items()))


def nodes(found: DataFrame, leaf: int = LEAF) -> DataFrame:
    """path, at, word, n: every word as an entry of its node, and as a search in the nodes its budget reaches."""
    rows = found.select("word", "n", vector(F.col("word")).alias("vector"), F.lit("").alias("path"))
    open_rows = rows.withColumn("at", F.explode(F.array(F.lit(ENTRY), F.lit(SAME))))
    done = None
    if found.count() <= leaf:
        return open_rows.select("path", "at", "word", "n")
    for level in range(LEVELS + 1):
        by = children(level) if level < LEVELS else halves()
        step = open_rows.withColumn("child", F.explode(by)).drop("path", "at").select("*", "child.*").drop("child")
        step = land(step, "spelling-level")
        sizes = step.where(F.col("at") == ENTRY).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        sizes = land(sizes, "spelling-nodes")
        last = level == LEVELS
        # A node without words ends the searches that reach it.
        placed = step.join(broadcast_if_small(sizes), "path")
        closed = placed if last else placed.where(F.col("size") <= leaf)
        closed = closed.select("path", "at", "word", "n")
        done = closed if done is None else done.unionByName(closed)
        large = sizes.where(F.col("size") > leaf)
        if last or large.isEmpty():
            return done
        open_rows = step.join(broadcast_if_small(large.select("path")), "path", "left_semi")


# Search of a node


def vectors(found: list[bytes]) -> np.ndarray:
    """One row per word (Latin-1): length, letters of each group, others."""
    level = np.full(256, LEVELS - 1)
    for k, letters in enumerate(GROUPS):
        level[list(letters.encode())] = k + 1
    sizes = np.array([len(one) for one in found], np.int64)
    owner = np.repeat(np.arange(len(found)), sizes)
    letters = np.frombuffer(b"".join(found), np.uint8)
    counts = np.bincount(owner * LEVELS + level[letters], minlength=len(found) * LEVELS).reshape(-1, LEVELS)
    counts[:, 0] = sizes
    return counts.astype(np.int32)


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or a letter longer, is exactly one edit away."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    place = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[place:] == b[place + 1 :]


def letters(found: list[bytes], width: int) -> np.ndarray:
    """The first ``width`` letters of each word, filled up with zeros."""
    return np.frombuffer(b"".join(one[:width].ljust(width, b"\0") for one in found), np.uint8).reshape(-1, width)


def one_edit_rows(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """``one_edit`` of words as rows of ``letters``; ``longer`` where b has a letter more."""
    differ = a != b
    first = differ.argmax(axis=1)
    shifted = (a[:, :-1] != b[:, 1:]) & (np.arange(a.shape[1] - 1) >= first[:, None])
    return np.where(longer, ~shifted.any(axis=1), differ.sum(axis=1) == 1)


def leaf_pairs(entries: np.ndarray, entry_rows: np.ndarray, searches: np.ndarray, search_rows: np.ndarray):
    """Places of searches and entries whose vectors are within the budget."""
    step = max(1, CELLS // len(entry_rows))
    for start in range(0, len(search_rows), step):
        own = search_rows[start : start + step]
        far = np.zeros((len(own), len(entry_rows)), np.int32)
        for level in range(1, LEVELS):
            far += np.abs(searches[own, level][:, None] - entries[entry_rows, level][None, :])
        longer = entries[entry_rows, 0][None, :] - searches[own, 0][:, None]
        a, b = np.nonzero(((longer == 0) & (far <= 2)) | ((longer == 1) & (far == 1)))
        yield own[a], entry_rows[b]


def depth_first(entries: np.ndarray, searches: np.ndarray):
    """Leaf pairs of the trie of ``entries`` that ``searches`` reach with a surplus and a deficit of one."""
    none = np.zeros(len(searches), np.int8)
    todo = [(np.arange(len(entries)), np.arange(len(searches)), none, none, 0)]
    while todo:
        entry_rows, search_rows, surplus, deficit, level = todo.pop()
        if not len(search_rows):
            continue
        if level == LEVELS or len(entry_rows) <= FEW:
            yield from leaf_pairs(entries, entry_rows, searches, search_rows)
            continue
        own, wanted = entries[entry_rows, level], searches[search_rows, level]
        for value in np.unique(own):
            more = value - wanted
            if level == 0:
                goes = (more == 0) | (more == 1)
                after = surplus[goes], deficit[goes]
            else:
                after = surplus + (more > 0), deficit + (more < 0)
                goes = (np.abs(more) <= 1) & (after[0] <= 1) & (after[1] <= 1)
                after = after[0][goes], after[1][goes]
            todo.append((entry_rows[own == value], search_rows[goes], *after, level + 1))


LINK_SCHEMA = "word string, near string, near_n long"
LINK_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _links(batches):
    """Both directions of every link of a node."""
    for rows in groups(batches, ("cell", "salt")):
        path = rows["path"].to_pylist()
        # Two nodes of one hash are searched one by one.
        for node in sorted(set(path)):
            part = rows if len(set(path)) == 1 else rows.filter(pa.array([one == node for one in path]))
            is_entry = part["at"].to_numpy() == ENTRY
            found, n = part["word"].to_pylist(), part["n"].to_pylist()
            sides = [np.flatnonzero(side) for side in (is_entry, ~is_entry)]
            if not all(len(side) for side in sides):
                continue
            raw = [one.encode("latin-1") for one in found]
            tables = [vectors([raw[k] for k in side.tolist()]) for side in sides]
            width = min(WIDTH, max(map(len, raw)))
            rows_of = letters(raw, width)
            # A pair that both halves bring together counts by its first half.
            by_last = "/s/" in node
            links = []
            for a, b in depth_first(*tables):
                vector_a, vector_b = tables[1][a], tables[0][b]
                apart = vector_a != vector_b
                places, first = np.arange(len(a)), apart.argmax(axis=1)
                longer = vector_b[:, 0] > vector_a[:, 0]
                rising = vector_a[places, first] < vector_b[places, first]
                x, y = sides[1][a], sides[0][b]
                # Of the same vector the pair is met from both sides.
                once = np.where(apart.any(axis=1), rising, True)
                short = vector_b[:, 0] <= width
                near = np.ones(len(a), bool)
                near[short] = one_edit_rows(rows_of[x[short]], rows_of[y[short]], longer[short])
                for place in np.flatnonzero(once & near).tolist():
                    word, other = found[x[place]], found[y[place]]
                    if not (short[place] or one_edit(word, other)) or (not apart[place].any() and word >= other):
                        continue
                    half = len(other) // 2
                    if not (by_last and word[:half] == other[:half]):
                        links += [(word, other, n[y[place]]), (other, word, n[x[place]])]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links), LINK_ARROW)], schema=LINK_ARROW)


def links(found: DataFrame, leaf: int = LEAF, searches: int = SEARCHES) -> DataFrame:
    """word, near, near_n: every two words of ``found`` (word, n) that are one edit apart, in both directions."""
    rows = nodes(found, leaf)
    is_entry = F.col("at") == ENTRY
    rows = land(rows.withColumn("cell", F.xxhash64("path")), "spelling-cells")
    loads = rows.groupBy("cell").agg(F.count_if(~is_entry).alias("searching"), F.count_if(is_entry).alias("entries"))
    loads = loads.where("searching > 0 and entries > 0").select("cell", F.ceil(F.col("searching") / searches).alias("salts"))
    placed = rows.join(broadcast_if_small(land(loads, "spelling-loads")), "cell")
    own = F.array(F.pmod(F.xxhash64("word"), F.col("salts")))
    salts = F.when(is_entry, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(own)
    placed = placed.withColumn("salt", F.explode(salts)).select("cell", "salt", "path", "at", "word", "n")
    dealt = placed.repartition(shuffle_partitions(found.sparkSession), "cell", "salt").sortWithinPartitions("cell", "salt")
    return dealt.mapInArrow(_links, LINK_SCHEMA)


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word, root: where the forms (word, form) lead. Every round doubles the steps taken."""
    up = land(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = up.join(broadcast_if_small(further), "root", "left")
        after = land(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        up = after.select("word", "root")
        if after.where("moved").isEmpty():
            return up
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; an empty table, or one without words, gives no rows.

    ``form`` is the near word of the largest n, by code points the smallest of several, if its n is at least
    ``ratio`` times the word's (above one, so that forms end). Extra columns of ``docs`` are not read.
    """
    found = land(words(docs), "spelling-words")
    best = links(found).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best")
    )
    joined = found.join(best, "word", "left")
    has_form = -F.col("best.least") >= ratio * F.col("n")
    joined = joined.select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.least")).alias("form_n"),
    )
    joined = land(joined, "spelling-forms")
    ends = roots(joined.where("form is not null"))
    joined = joined.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
