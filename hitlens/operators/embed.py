"""Path embeddings: word vectors of path tokens from their co-occurrences, averaged per request.

Word vectors are the leading singular vectors of the tokens' association matrix. Its entries are aggregates over all
paths; the matrix stays a table of entries, and a product with it is a join and a sum. The leading subspace is found by
a randomised range finder (Halko, Martinsson and Tropp, 2011) whose start is a hash of each token, so vectors do not
depend on partitions or cores. The driver holds matrices of ``size + OVERSAMPLED`` rows and columns, no vocabulary.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.functions import tokens
from hitlens.session import MAX_BROADCAST_ROWS, broadcast_if_small, land

WINDOW, OVERSAMPLED, ROUNDS = 5, 10, 2
# Directions whose square is this much smaller than the largest are rounding noise.
NOISE = 1e-13


def add_path_tokens(requests: DataFrame, output: str = "url_features") -> DataFrame:
    url = tokens.url_tokens(F.col("clean_path"), F.col("clean_query_list"))
    return requests.withColumn(output, tokens.classify_tokens(url))


def cooccurrences(df: DataFrame, terms: str, window: int = WINDOW, min_count: int = 5) -> DataFrame:
    """word, near, n: how often two tokens are within ``window`` places of each other, both ways round.

    A token also is near itself, once per occurrence. Tokens of fewer than ``min_count`` occurrences are left out.
    Equal lists are counted once, with their number.
    """
    lists = land(df.groupBy(F.col(terms).alias("terms")).agg(F.count(F.lit(1)).alias("n")), "token-lists")
    places = lists.select("n", "terms", F.posexplode("terms").alias("place", "word"))
    counts = places.groupBy("word").agg(F.sum("n").alias("n"))
    common = land(counts.where(F.col("n") >= min_count), "words")
    nearby = F.slice("terms", F.col("place") + 2, F.lit(window))
    pairs = places.select("n", "word", F.explode(nearby).alias("near")).groupBy("word", "near").agg(F.sum("n").alias("n"))
    both = pairs.unionByName(pairs.select("n", F.col("near").alias("word"), F.col("word").alias("near")))
    both = both.unionByName(common.select("word", F.col("word").alias("near"), "n"))
    known = broadcast_if_small(common.select("word"))
    both = both.join(known, "word", "left_semi").join(known.withColumnRenamed("word", "near"), "near", "left_semi")
    return both.groupBy("word", "near").agg(F.sum("n").alias("n"))


def associations(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """word, near, value: ``ln(1 + ratio / shift)`` of the counts' ratio to chance; symmetric, never negative."""
    counts = land(counts, "cooccurrences")
    margins = land(counts.groupBy("word").agg(F.sum("n").alias("total")), "margins")
    whole = margins.agg(F.sum("total")).first()[0] or 0
    margins = broadcast_if_small(margins)
    joined = counts.join(margins, "word").join(
        margins.select(F.col("word").alias("near"), F.col("total").alias("near_total")), "near"
    )
    ratio = F.col("n") / F.col("total") * (F.lit(float(whole)) / F.col("near_total"))
    return joined.select("word", "near", F.log1p(ratio / shift).alias("value"))


def _vectors_if_small(vectors: DataFrame, width: int) -> DataFrame:
    """``vectors`` for a join: broadcast only where they hold no more numbers than a narrow table that is."""
    return broadcast_if_small(vectors, MAX_BROADCAST_ROWS // max(width, 1))


def _sums(values: Column, width: int, weight: Column | None = None) -> Column:
    terms = [F.get(values, F.lit(k)) for k in range(width)]
    return F.array(*(F.sum(term if weight is None else term * weight) for term in terms))


def product(matrix: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """word, x: the symmetric ``matrix`` (word, near, value) times ``vectors`` (word, x)."""
    near = _vectors_if_small(vectors, width).withColumnRenamed("word", "near")
    sums = _sums(F.col("x"), width, F.col("value"))
    return land(matrix.join(near, "near").groupBy("word").agg(sums.alias("x")), "vectors")


def _matrix(column) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _inner(left: str, right: str, batches):
    """One task's part of the inner products of the columns of two arrays."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = _matrix(batch.column(left)).T @ _matrix(batch.column(right))
            total = part if total is None else total + part
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i, j, total)], names=["i", "j", "v"])


def inner(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Inner products of the columns of two array columns: as many rows as their widths multiply to."""
    parts = df.select(left, right) if left != right else df.select(left)
    parts = parts.mapInArrow(partial(_inner, left, right), "i long, j long, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    width = max((row.i for row in found), default=-1) + 1
    result = np.zeros((width, max((row.j for row in found), default=-1) + 1))
    for row in found:
        result[row.i, row.j] = row.v
    return result


def _mapped(matrix: np.ndarray, batches):
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x")) @ matrix
            values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), values], names=["word", "x"])


def mapped(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""
    return vectors.select("word", "x").mapInArrow(partial(_mapped, matrix), "word string, x array<double>")


def orthonormal(vectors: DataFrame, times: int = 1) -> tuple[DataFrame, int]:
    """An orthonormal basis of the columns, and how many it has. One time loses digits, the second restores them."""
    for _ in range(times):
        squares, turn = np.linalg.eigh(inner(vectors, "x", "x"))
        kept = squares > NOISE * squares.max(initial=0)
        vectors = land(mapped(vectors, turn[:, kept] / np.sqrt(squares[kept])), "basis")
    return vectors, int(kept.sum())


def start(words: DataFrame, width: int, seed: int) -> DataFrame:
    """Normal numbers from each word's hash."""
    unit = [
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "word"), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        for k in range(2 * width)
    ]
    normal = [F.sqrt(-2 * F.log(unit[2 * k])) * F.cos(2 * np.pi * unit[2 * k + 1]) for k in range(width)]
    return words.select("word", F.array(*normal).alias("x"))


def word_vectors(matrix: DataFrame, size: int = 100, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """word, vector: ``U sqrt(S)`` of the leading ``size`` singular vectors, turned to a fixed basis. Stored.

    Singular vectors are only known up to their signs, and to rotations where values are equal. They are turned as near
    as possible to the start vectors, which takes that choice away. Narrower spaces are filled up with zeros.
    """
    matrix = land(matrix, "associations")
    width = size + OVERSAMPLED
    words = matrix.select("word").distinct()
    first = land(start(words, width, seed), "start")
    if first.isEmpty():
        return first.select("word", F.col("x").alias("vector"))
    basis = first
    for k in range(rounds + 1):
        basis, width = orthonormal(product(matrix, basis, width), 2 if k == rounds else 1)
    image = product(matrix, basis, width).withColumnRenamed("x", "y")
    middle = inner(basis.join(image, "word"), "x", "y")
    values, turn = np.linalg.eigh((middle + middle.T) / 2)
    leading = np.argsort(-np.abs(values), kind="stable")[:size]
    values, turn = values[leading], turn[:, leading]
    towards = turn.T @ inner(basis.join(first.withColumnRenamed("x", "s"), "word"), "x", "s")[:, : len(leading)]
    left, _, right = np.linalg.svd(towards)
    final = turn * np.sqrt(np.abs(values)) @ (left @ right)
    final = np.hstack([final, np.zeros((len(final), size - final.shape[1]))])
    return land(mapped(basis, final).withColumnRenamed("x", "vector"), "word-vectors")


def fit_path_embedding(
    df: DataFrame, terms: str = "url_features", size: int = 100, min_count: int = 5, window: int = WINDOW, seed: int = 1
) -> DataFrame:
    """word, vector of the tokens in ``terms``; rows without tokens are passed over, an empty table gives no words."""
    return word_vectors(associations(cooccurrences(df, terms, window, min_count)), size, seed=seed)


def embed_paths(
    df: DataFrame, vectors: DataFrame, terms: str = "url_features", size: int = 100, output: str = "url_embedding"
) -> DataFrame:
    """``df`` with the mean vector of its tokens, unknown ones counting as zero. Equal lists are computed once."""
    lists = df.select(F.col(terms).alias("_terms")).where(F.size(terms) > 0).distinct()
    parts = lists.select("_terms", F.explode("_terms").alias("word")).join(_vectors_if_small(vectors, size), "word")
    sums = parts.groupBy("_terms").agg(_sums(F.col("vector"), size).alias("_sum"))
    means = land(sums.select("_terms", F.transform("_sum", lambda x: x / F.size("_terms")).alias("_mean")), "path-vectors")
    joined = df.join(_vectors_if_small(means, size), df[terms] == means["_terms"], "left")
    none = F.array_repeat(F.lit(0.0), size)
    return joined.withColumn(output, array_to_vector(F.coalesce("_mean", none))).drop("_terms", "_mean")
