import random

import pytest
from pyspark.sql import functions as F

# Names that operators use for columns of their own.
CLASHING = (
    "norm hash salt start size row block slot digest signature label node raw doc part spans score predicted kept "
    "keep_id n_words first shard places window id"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c",
    "one",
    " one  two\tthree ",
    "one two three",
    "one two three",
    "One Two three",
    "a b  c é \U0001f600 \x1c",
    "long " * 30_000,
    "x" * 100_000,
]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) or (id, text, source), with extra columns of clashing names."""

    def make(rows, clashing=True):
        full = [(*row, *("src1",)[: 3 - len(row)]) for row in rows]
        full = [(key, text, "en", source, len(text or "")) for key, text, source in full]
        table = spark.createDataFrame(full, SCHEMA)
        return table.withColumns({name: F.lit("other") for name in CLASHING}) if clashing else table

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, rows without id or source."""
    rows = [(k, text, f"src{k % 3}") for k, text in enumerate(EDGE_TEXTS)]
    return [*rows, rows[5], rows[5], (None, "one two three", None), (None, "alone", None), (-4, "one two three", "src1")]


@pytest.fixture(scope="session")
def prose():
    """Random texts of words; the same for the same seed."""

    def make(seed, words, vocabulary=400):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))

    return make
