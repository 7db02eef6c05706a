"""Pipelines of stages, stored and loaded."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hitlens.operators import embed, stages

REQUESTS = "id int, clean_path string, clean_query_list array<string>"


def requests(spark):
    rows = [(k, f"/shop/{k % 3}/item{k % 5}", [f"page={k}", "sort=up"][: k % 3]) for k in range(60)]
    return spark.createDataFrame([*rows, (60, "", []), (61, "/never/seen/before", None)], REQUESTS)


def test_embedding_pipeline(spark, tmp_path):
    """The chain as one object: fitted, stored and loaded, it gives what the functions give."""
    table = requests(spark)
    chain = Pipeline(
        stages=[
            stages.PathTokens(),
            stages.PathVectors(size=4, minCount=2, seed=3),
            VectorAssembler(inputCols=["id", "url_embedding"], outputCol="features"),
        ]
    )
    chain.write().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(table)
    fitted.write().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    worded = embed.add_path_tokens(table)
    vectors = embed.fit_path_embedding(worded, size=4, min_count=2, seed=3)
    wanted = embed.embed_paths(worded, vectors, size=4)

    def numbers(df):
        rows = df.select("id", F.explode(vector_to_array("url_embedding"))).orderBy("id").collect()
        return [row[1] for row in rows]

    got = loaded.transform(table)
    assert got.columns == [*table.columns, "url_features", "url_embedding", "features"]
    assert got.count() == 62
    assert numbers(got) == pytest.approx(numbers(wanted), abs=1e-6)
    assert any(numbers(got))


def test_overwriting_a_stored_model(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], stages.PathVectorsModel.VECTORS)
    path = str(tmp_path / "model")
    for factor in (1.0, 3.0):
        scaled = vectors.select("word", F.transform("vector", lambda x: x * factor).alias("vector"))
        model = stages.PathVectorsModel(scaled)
        model.set(model.size, 2)
        model.write().overwrite().save(path)
    with pytest.raises(Exception, match="overwrite"):
        model.write().save(path)
    loaded = stages.PathVectorsModel.load(path)
    words = spark.createDataFrame([(["a", "b"],), ([],)], "url_features array<string>")
    found = loaded.transform(words).select(vector_to_array("url_embedding")).collect()
    assert sorted(row[0] for row in found) == [[0.0, 0.0], [1.5, 3.0]]


def test_label_stage(spark, tmp_path):
    stage = stages.SiteLabel(labels=["x", "y"], threshold=0.5, dropped=["gone"])
    stage.write().save(str(tmp_path / "stage"))
    stage = stages.SiteLabel.load(str(tmp_path / "stage"))
    rows = spark.createDataFrame([([0.4, 0.6], 1), ([0.5, 0.5], 2)], "p array<double>, gone int")
    rows = rows.select(array_to_vector("p").alias("probability"), "gone")
    got = stage.transform(rows)
    assert got.columns == ["probability", "prediction_domain"]
    assert sorted(r[1] for r in got.collect()) == ["other", "y"]


def test_site_terms_of_short_and_missing_paths(spark):
    rows = [(1, "/abcdefghij", ["k=v"]), (2, "/a", ["k=v", "m"]), (3, "", []), (4, None, ["k=v"]), (5, "/a", None)]
    got = stages.SiteTerms(n=9).transform(spark.createDataFrame(rows, REQUESTS)).orderBy("id").collect()
    assert [len(r.url_features) for r in got] == [4, 2, 0, 1, 0]
    assert got[0].url_features[0] == "/ a b c d e f g h" and got[0].url_features[-1] == "k"
