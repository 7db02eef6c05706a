"""Feature operators on the toy inputs."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hitlens.functions import tokens
from hitlens.operators import embed, features, similar

TOY = [(1, "/api/v1/student/1234"), (2, "/api/v1/student/1233"), (3, "/api/v1/teacher/5678")]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "id int, clean_path string")


def test_ngrams(spark, toy):
    rows = features.add_path_ngrams(toy, n=4).collect()
    for row in rows:
        text = row.clean_path
        assert row.path_ngrams == [" ".join(text[i : i + 4]) for i in range(len(text) - 3)]
    short = spark.createDataFrame([("/a",)], "clean_path string")
    assert features.add_path_ngrams(short, n=4).first().path_ngrams == []


def test_hashed_counts(toy):
    hashed = features.hash_terms(features.add_path_ngrams(toy, n=4), "path_ngrams", "v", 100)
    for row in hashed.withColumn("a", vector_to_array("v")).collect():
        assert len(row.a) == 100 and sum(row.a) == len(row.path_ngrams)


def test_minhash_estimates_similarity_and_keeps_empty_rows(spark, toy):
    table = toy.union(spark.createDataFrame([(4, "/api/v1/student/1234"), (5, "")], toy.schema))
    table = table.withColumn("c", F.filter(tokens.characters("clean_path"), lambda c: c != ""))
    signed = similar.minhash_signatures(table, "c", tables=5, buckets=100)
    rows = {r.id: tuple(r[f"min{i}"] for i in range(5)) for r in signed.collect()}
    assert rows[1] == rows[4]
    assert rows[5] == (None,) * 5
    equal = lambda a, b: sum(x == y for x, y in zip(rows[a], rows[b]))
    assert equal(1, 2) >= equal(1, 3)


def test_embedding(spark):
    rows = [(f"/api/v1/{'student' if i % 2 else 'teacher'}/{i}", []) for i in range(60)]
    table = spark.createDataFrame(rows, "clean_path string, clean_query_list array<string>")
    worded = embed.add_path_tokens(table)
    words = embed.fit_path_embedding(worded, size=8)
    assert words.count() == 6
    vectors = embed.embed_paths(worded, words, size=8).select("clean_path", vector_to_array("url_embedding").alias("v"))
    by_kind = {}
    for row in vectors.collect():
        by_kind.setdefault(row.clean_path.split("/")[3], set()).add(tuple(row.v))
    assert all(len(v) == 1 and len(next(iter(v))) == 8 for v in by_kind.values())


def test_agent_hashes(spark):
    table = spark.createDataFrame([("Mozilla/5.0 (X11) Gecko",)], "user_agent string")
    words = table.withColumn("agent", tokens.agent_tokens(F.col("user_agent")))
    row = features.hash_terms(words, "agent", "v", 32).select(vector_to_array("v").alias("v")).first()
    assert len(row.v) == 32 and sum(row.v) == 3


def _token_rows():
    return [([f"w{k % 7}", f"w{k % 11}", "the", *(["rare"] if k == 3 else [])],) for k in range(400)] + [([],)]


def test_word_vectors_do_not_depend_on_partitions(spark):
    table = spark.createDataFrame(_token_rows(), "url_features array<string>")
    vectors = [
        {r.word: r.vector for r in embed.fit_path_embedding(table.repartition(n), size=5).collect()} for n in (1, 8)
    ]
    assert vectors[0].keys() == vectors[1].keys() and "rare" not in vectors[0]
    assert all(np.allclose(vectors[0][word], vectors[1][word], atol=1e-6) for word in vectors[0])


def test_word_vectors_equal_a_dense_decomposition(spark):
    """Counts, associations and inner products of the vectors against NumPy over the whole matrix."""
    rows = _token_rows()
    table = spark.createDataFrame(rows, "url_features array<string>")
    total = {}
    for (row,) in rows:
        for i, word in enumerate(row):
            total[word] = total.get(word, 0) + 1
    got = {(r.word, r.near): r.n for r in embed.cooccurrences(table, "url_features", window=1).collect()}
    words = sorted(word for word, n in total.items() if n >= 5)
    want = {}
    for (row,) in rows:
        for i, word in enumerate(row):
            want[word, word] = want.get((word, word), 0) + 1
            if i + 1 < len(row):
                for pair in ((word, row[i + 1]), (row[i + 1], word)):
                    want[pair] = want.get(pair, 0) + 1
    assert got == {pair: n for pair, n in want.items() if pair[0] in words and pair[1] in words}
    dense = np.array([[got.get((a, b), 0) for b in words] for a in words], float)
    margin = dense.sum(axis=1)
    dense = np.log1p(dense * margin.sum() / np.outer(margin, margin))
    found = {r.word: r.vector for r in embed.fit_path_embedding(table, size=20, window=1).collect()}
    vectors = np.array([found[word] for word in words])
    left, values, _ = np.linalg.svd(dense)
    assert np.allclose(vectors @ vectors.T, left * values @ left.T, atol=1e-6)
    # Fewer dimensions: the nearest words are those of the truncated decomposition.
    found = {r.word: r.vector for r in embed.fit_path_embedding(table, size=6, window=1).collect()}
    small, whole = np.array([found[word] for word in words]), left[:, :6] * np.sqrt(values[:6])
    for vectors in (small, whole):
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.abs(small @ small.T - whole @ whole.T).max() < 0.02


def test_agent_ngrams(spark):
    table = spark.createDataFrame([("a b c",), ("a",)], "user_agent string")
    got = [r.agent_ngrams for r in features.add_agent_ngrams(table, n=2).collect()]
    assert got == [["a b", "b c"], []]


def test_wide_vectors_are_broadcast_by_their_numbers(spark, monkeypatch):
    made = []
    monkeypatch.setattr(embed, "land", lambda df, name: made.append(df) or df)
    for count in (2_000, 20):
        words = spark.range(count).select(F.col("id").cast("string").alias("word"))
        vectors = words.select("word", F.array_repeat(F.lit(1.0), 110).alias("x"))
        embed.product(words.select("word", F.col("word").alias("near"), F.lit(2.0).alias("value")), vectors, 110)
    hinted = ["broadcast" in df._jdf.queryExecution().logical().toString() for df in made]
    assert hinted == [False, True]
