"""Queries of the subpackage against their SQL, and over edge cases stored as tables."""

import duckdb
import pytest
from check import same_rows, tables
from conftest import SMALL

from llm_fixtures import documents, edge_rows  # noqa: F401

from hitlens.llm.oracle import ORACLE
from hitlens.llm.queries import QUERIES


def test_names():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    assert same_rows(got, tables(SMALL).sql(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_cases_and_empty_tables(spark, name, documents, edge_rows, tmp_path):
    conversations = [(1, 0, None, None), (1, 1, "assistant", ""), (None, None, "user", "x"), (1, 0, None, None)]
    vectors = [(50, [0.5, 0.5], 1), (50, [0.5, 0.5], 1), (None, None, None), (1, [0.4, None], 2), (2, [0.4, 0.4], 2), (3, [0.5], 1)]
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>a")]
    for kind in ("full", "empty"):
        folder = tmp_path / kind
        parts = {
            "documents": documents(edge_rows),
            "labels": spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int"),
            "benchmark": spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "")], "item_id long, text string"),
            "conversations": spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string"),
            "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
            "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        }
        for table, rows in parts.items():
            (rows if kind == "full" else rows.limit(0)).write.parquet(str(folder / f"{table}.parquet"))
        got = QUERIES[name](spark, str(folder)).collect()
        if kind == "empty":
            assert len(got) == (1 if name.startswith("op9") else 0)
        elif name[:4] in ("op1_", "op2_", "op4_", "op6_", "op7_", "op8_", "op10"):
            assert len(got) == len(edge_rows)


@pytest.mark.parametrize("system_words", [1, 200, 300, 600, 1000, 1100])
def test_chat_equals_sql_whatever_the_system_turn(spark, system_words, tmp_path):
    rows = []
    for conv in range(6):
        rows.append((conv, 0, "system" if conv else "user", "s " * system_words))
        rows += [(conv, k, ("user", "assistant")[k % 2], f"w{k} " * (1 + 97 * k * (conv + 1) % 700)) for k in range(1, 30)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    got = QUERIES["op9_chat"](spark, str(tmp_path)).toPandas()
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert same_rows(got, base.sql(ORACLE["op9_chat"]).df()) == ""
