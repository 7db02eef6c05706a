import numpy as np
from conftest import SMALL

from llm_fixtures import documents  # noqa: F401

from hitlens.llm import quality
from hitlens.llm.common import table


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = table(spark, folder, "labels")
    scored = quality.scores(table(spark, folder, "documents"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(scored) > 50
    assert sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(1)
    size = len(quality.FEATURES)
    x = [rng.normal(size=(400, size)), rng.normal(size=(600, size)) * 1.7 + 0.8]
    model = quality.discriminant([len(c) for c in x], [c.sum(0) for c in x], [c.T @ c for c in x])
    pooled = sum((c - c.mean(0)).T @ (c - c.mean(0)) for c in x) / 1000
    scale = np.sqrt(np.diag(pooled))
    points, density = rng.normal(size=(20, size)), []
    for c in x:
        weight = max(quality.LEAST_SHRINKAGE, size / (len(c) + size))
        cov = (1 - weight) * np.cov(c.T, bias=True) + weight * pooled + quality.RIDGE * np.diag(scale**2)
        gap = points - c.mean(0)
        density.append(np.log(len(c) / 1000) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (gap @ np.linalg.inv(cov) * gap).sum(1))
    assert np.allclose(model.score(points), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-6)


def test_without_one_class(spark, documents):
    docs = documents([(1, "a b c"), (2, None), (None, "d")])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_keep_good_equals_predicted(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.scores(docs, labels).where("predicted = 1").collect()}
