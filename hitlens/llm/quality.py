"""Quality by a regularised quadratic discriminant.

Every text gives a vector of transformed statistics (shares as square roots, ratios as logarithms). The two
classes' means and covariances come from sums over all labelled training rows. A covariance is shrunk to the
pooled one, the more the fewer rows its class has, and gets a small ridge. The score of a text is the logistic
value of the difference of the two log densities (Mahalanobis distance and log determinant, both from the inverse
of a Cholesky factor that is computed once) and of the class sizes.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import WORD_PATTERN, text_of
from hitlens.session import land

FEATURES = [
    "log_word_length",
    "upper",
    "punctuation",
    "symbols",
    "exclamations",
    "digits",
    "pipes",
    "beyond_ascii",
    "log_words_per_line",
    "repeated_lines",
    "vocabulary",
    "commonest_word",
    "short_words",
    "stops",
]
THRESHOLD = 0.7
LEAST_SHRINKAGE, RIDGE = 0.05, 0.02
HELD_OUT_FOLD, FOLDS = 2, 4

_words = re.compile(WORD_PATTERN).findall
_is = np.zeros((8, 256))
for _kind, _chars in enumerate(
    (
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"abcdefghijklmnopqrstuvwxyz",
        b"0123456789",
        b".,;:!?'\"()-",
        b"#$%&*<>^~\\{}[]@=+_/`",
        b"!",
        b"|",
        bytes(range(0xC2, 0xF5)),  # first bytes of letters beyond ASCII
    )
):
    _is[_kind, list(_chars)] = 1.0


def statistics(text: str) -> list[float]:
    """The features of one whole text; an empty one has values too."""
    raw = text.encode("utf-8", "replace")
    upper, lower, digits, marks, symbols, shouts, pipes, beyond = _is @ np.bincount(
        np.frombuffer(raw, np.uint8), minlength=256
    )
    words = _words(text)
    lines = [line for line in text.split("\n") if line]
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    # Usual values stand for the first 300 characters, 50 words or 10 lines, so that short texts are not outliers.
    letters = upper + lower
    share = lambda part, whole, usual, more: ((part + usual * more) / (whole + more)) ** 0.5
    return [
        np.log((chars + 300) / (n + 50)),
        share(upper, letters, 0.03, 300),
        share(marks, chars, 0.02, 300),
        share(symbols, chars, 0.0, 300),
        share(shouts, chars, 0.0, 300),
        share(digits, chars, 0.001, 300),
        share(pipes, n, 0.0, 50),
        share(beyond, chars, 0.01, 300),
        np.log((n + 50) / (len(lines) + 3)),
        share(len(lines) - len(set(lines)), len(lines), 0.0, 10),
        np.log1p(len(counts) + 10) / np.log1p(len(words) + 10),
        share(max(counts.values(), default=0), n, 0.05, 50),
        share(sum(len(word) < 4 for word in counts), len(counts), 0.3, 50),
        share(raw.count(b".") + raw.count(b"?"), n, 0.08, 50),
    ]


def _features(batches):
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column(batch.num_columns - 1)]
        values = np.array(rows).reshape(-1, len(FEATURES))
        columns = [pa.array(values[:, k], pa.float64()) for k in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; null text is the empty text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES)
    return rows.mapInArrow(_features, schema)


def held_out():
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD
    return F.coalesce(fold, F.lit(False))


@dataclass
class Model:
    """Scores vectors. Without rows of both classes it gives every text the (smoothed) share of label 1."""

    rows: tuple[int, int]
    means: np.ndarray = None
    whitened: list = field(default_factory=list)  # inverse Cholesky factor of each class
    constants: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        bad, good = self.rows
        if not self.whitened:
            return np.full(len(x), (good + 1) / (bad + good + 2))
        density = [
            constant - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, constant in zip(self.means, self.whitened, self.constants)
        ]
        return np.round(1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))), 9)


def discriminant(rows, sums, products) -> Model:
    """Model of two classes from their row counts, sums and sums of products."""
    rows = np.array(rows, dtype=float)
    counts = (int(rows[0]), int(rows[1]))
    if min(counts) < 1:
        return Model(counts)
    means = np.array(sums) / rows[:, None]
    scatter = np.array(products) - rows[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / rows.sum()
    size = len(pooled)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whitened, constants = [], []
    for n, own in zip(rows, scatter):
        weight = max(LEAST_SHRINKAGE, size / (n + size))
        covariance = ((1 - weight) * own / n + weight * pooled) / scale[:, None] / scale
        factor = np.linalg.cholesky(covariance + RIDGE * np.eye(size))
        whitened.append(np.linalg.inv(factor) / scale)
        constants.append(np.log(n / rows.sum()) - np.log(np.diag(factor)).sum() - np.log(scale).sum())
    return Model(counts, means, whitened, tuple(constants))


def fit(table: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the rows of ``table`` (features) with a label 0 or 1 that are not held out.

    A document labelled twice counts twice; null labels and labels without a document do not count.
    """
    names = [(a, b) for k, a in enumerate(FEATURES) for b in FEATURES[k:]]
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("class label"))
    train = table.where(~held_out()).join(known, "doc_id")
    found = (
        train.groupBy("class label")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.array(*[F.sum(name) for name in FEATURES]).alias("sums"),
            F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in names]).alias("products"),
        )
        .collect()
    )
    rows, size = [0, 0], len(FEATURES)
    sums, products = np.zeros((2, size)), np.zeros((2, size, size))
    for row in found:
        rows[row[0]], sums[row[0]] = row["rows"], row["sums"]
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = row["products"]
        products[row[0]] = upper + np.triu(upper, 1).T
    return discriminant(rows, sums, products)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. A null id is not held out."""
    table = land(features(docs), "quality-features")
    model = fit(table, labels)

    def score(batches):
        for batch in batches:
            values = model.score(batch[FEATURES].to_numpy())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "score": values, "predicted": (values >= threshold).astype("int32")}
            )

    # The id goes through pandas as text, where a missing one stays missing.
    scored = table.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        score, "doc_id string, score double, predicted int"
    )
    scored = scored.withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of ``threshold`` or more; their columns are unchanged."""
    model = fit(land(features(docs), "quality-features"), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(-1, len(FEATURES))))

    return docs.where(score(text_of()) >= threshold)
