"""Isolation forest: kernels, draws, scores, thresholds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.operators import forest, tree_kernels
from hitlens.plans import detect
from hitlens.session import land


def points(spark, rows=400, groups=("a", "b"), partitions=3):
    rng = np.random.default_rng(5)
    data = [
        (g, i, float(rng.normal()), float(rng.normal()), float(i % 3))
        for g in groups
        for i in range(rows)
    ]
    data.append((groups[0], rows, 50.0, 50.0, 1.0))
    return spark.createDataFrame(data, "site string, id int, x double, y double, z double").repartition(
        partitions
    )


def fit(table, trees=40, samples=64, seed=1):
    nodes = forest.fit_forest(table, "site", ["site", "id"], ["x", "y", "z"], trees, samples, seed)
    return land(nodes, "nodes")


def test_mean_path():
    got = tree_kernels.mean_path(np.array([0, 1, 2, 256]))
    gamma = 0.5772156649015329
    assert got[:2].tolist() == [0, 0]
    assert got[2] == pytest.approx(2 * gamma - 1)
    assert got[3] == pytest.approx(2 * (math.log(255) + gamma) - 2 * 255 / 256)


def test_tree_is_a_valid_partition_of_its_sample():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 5, size=(100, 4)).astype(float)
    tree = tree_kernels.grow_tree(sample, 7, np.random.default_rng(1))

    def walk(node, rows, depth):
        assert tree["size"][node] == len(rows)
        if tree["feature"][node] < 0:
            same = len(rows) < 2 or (sample[rows] == sample[rows[0]]).all()
            assert same or depth == 7
            assert tree["path_length"][node] == pytest.approx(
                depth + float(tree_kernels.mean_path(len(rows)))
            )
            return 1
        right = sample[rows, tree["feature"][node]] >= tree["threshold"][node]
        assert 0 < right.sum() < len(rows)
        left = tree["left"][node]
        return 1 + walk(left, rows[~right], depth + 1) + walk(left + 1, rows[right], depth + 1)

    assert walk(0, np.arange(100), 0) == len(tree["node"])


def test_scores_equal_a_plain_walk(spark):
    table = points(spark)
    nodes = fit(table)
    got = forest.score_forest(table, nodes, "site", ["x", "y", "z"]).toPandas()
    frame = nodes.toPandas()
    trees = {
        g: [t.set_index("node") for _, t in part.groupby("tree")]
        for g, part in frame.groupby("forest_group")
    }
    for row in got.sample(25, random_state=1).itertuples():
        total = 0.0
        for tree in trees[row.site]:
            at = 0
            while tree.feature[at] >= 0:
                value = (row.x, row.y, row.z)[tree.feature[at]]
                at = tree.left[at] + int(value >= tree.threshold[at])
            total += tree.path_length[at]
        mean = total / len(trees[row.site])
        assert row.outlierScore == pytest.approx(2 ** (-mean / float(tree_kernels.mean_path(64))))


def test_every_tree_has_its_full_sample(spark):
    roots = fit(points(spark), trees=45, samples=64).filter("node = 0").toPandas()
    assert roots.groupby("forest_group").tree.nunique().tolist() == [45, 45]
    assert set(roots["size"]) == {64}


def test_small_group_uses_all_its_rows(spark):
    roots = fit(points(spark, rows=20), trees=5, samples=64).filter("node = 0").toPandas()
    assert sorted(set(roots["size"])) == [20, 21]


def test_large_group_rows_join_at_most_one_chunk_each(spark):
    table = points(spark, rows=60_000, groups=("a",))
    drawn = forest.draw_samples(table, "site", ["site", "id"], ["x", "y", "z"], 100, 256, 1)
    frame = drawn.select("chunk", "sample_key").toPandas()
    wanted = forest.TREES_PER_CHUNK * 256
    assert frame.sample_key.is_unique
    assert set(frame.chunk) == {0, 1}  # of 100 trees
    assert frame.groupby("chunk").size().between(wanted, wanted + 20 * math.sqrt(wanted)).all()


def test_features_are_computed_for_drawn_rows_only(spark):
    def prepare(rows):
        return rows.withColumn("sum", F.col("x") + F.col("y"))

    table = points(spark)
    nodes = forest.fit_forest(table, "site", ["site", "id"], ["sum"], 5, 32, prepare=prepare)
    whole = forest.fit_forest(prepare(table), "site", ["site", "id"], ["sum"], 5, 32)
    order = ["forest_group", "tree", "node"]
    assert nodes.orderBy(order).toPandas().equals(whole.orderBy(order).toPandas())


def test_planted_outlier_ranks_first(spark):
    rows = [
        (1, 3.0, 2.0, 5.0, 10.0, 100.0),
        (2, 4.0, 3.0, 6.0, 12.0, 110.0),
        (3, 3.5, 2.5, 5.5, 11.0, 105.0),
        (4, 1e6, 1e6, 1e6, 1e6, 1e6),
        (5, 5.0, 3.5, 7.0, 14.0, 120.0),
    ]
    names = [f"feature{i}" for i in range(1, 6)]
    table = spark.createDataFrame(rows, ["id", *names]).withColumn("site", F.lit("s"))
    nodes = land(forest.fit_forest(table, "site", ["id"], names), "nodes")
    scored = land(forest.score_forest(table, nodes, "site", names), "scored")
    assert scored.orderBy(F.desc("outlierScore")).first().id == 4
    limits = forest.score_thresholds(scored, "site", contamination=0.2)
    labelled = forest.label_anomalies(scored, limits, "site")
    assert {r.id: r.anomaly for r in labelled.collect()}[4] == 1


def test_result_does_not_depend_on_partitions_or_copies(spark):
    few = fit(points(spark, partitions=1)).orderBy("forest_group", "tree", "node").toPandas()
    table = points(spark, partitions=9)
    # A hot row: thousands of copies must neither fill a tree nor change the draw's size.
    many = fit(table).orderBy("forest_group", "tree", "node").toPandas()
    assert few.equals(many)
    copies = table.filter("id = 7").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("k")
    drawn = forest.draw_samples(
        table.union(copies), "site", ["site", "id"], ["x", "y", "z"], 40, 64, 1
    )
    assert drawn.groupBy("forest_group", "chunk", "sample_key").count().filter("count > 1").isEmpty()


def test_shares_of_a_hot_group_give_the_same_scores(spark, monkeypatch):
    table = points(spark, groups=("a", "b", "c"))
    odd = [("none", 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)]
    more = land(table.union(spark.createDataFrame(odd, table.schema)), "points")
    nodes = fit(table)
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)
    monkeypatch.setattr(type(nodes), "toArrow", None)
    whole = forest.score_forest(more, nodes, "site", ["x", "y", "z"])
    shared = forest.score_forest(more, nodes, "site", ["x", "y", "z"], rows_per_task=30)
    assert whole.columns == [*more.columns, "outlierScore"]
    key = ["site", "id"]
    left = whole.orderBy(key).collect()
    assert left == shared.orderBy(key).collect() and len(left) == more.count()
    assert all((row.outlierScore is None) == (row.site in ("none", None)) for row in left)
    assert all(0 < row.outlierScore <= 1 for row in left if row.outlierScore)


def test_many_groups_are_scored_in_one_pass(spark):
    table = points(spark, rows=4, groups=tuple(f"site{k}" for k in range(150)))
    nodes = fit(table, trees=3)
    scored = forest.score_forest(land(table, "points"), nodes, "site", ["x", "y", "z"]).toPandas()
    assert scored.outlierScore.notna().all() and scored.site.nunique() == 150


def test_vectors_and_a_forest_without_rows(spark):
    table = points(spark)
    nodes = fit(table)
    vectors = table.select("site", "id", F.expr("array(x, y, z)").alias("v"))
    from pyspark.ml.functions import array_to_vector

    vectors = vectors.select("site", "id", array_to_vector("v").alias("features"))
    scored = forest.score_forest(vectors.where("site = 'a'"), nodes, "site")
    assert scored.columns == ["site", "id", "outlierScore"]
    plain = forest.score_forest(table.where("site = 'a'"), nodes, "site", ["x", "y", "z"])
    key = ["site", "id"]
    assert scored.orderBy(key).collect() == plain.select(scored.columns).orderBy(key).collect()
    assert forest.score_forest(vectors, nodes.limit(0), "site").where("outlierScore IS NOT NULL").isEmpty()


@pytest.mark.parametrize("buckets", [4, 4096])
def test_threshold_is_the_exact_order_statistic(spark, buckets):
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.random(999),
        "ties": np.repeat([0.1, 0.5, 0.9], 100),
        "near": 0.5 + rng.random(500) * 1e-14,
        "hot": np.concatenate([np.full(700, 0.3), rng.random(300)]),
        "one": np.array([0.25]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    table = land(spark.createDataFrame(rows, "site string, outlierScore double"), "scores")
    for part in (0.02, 0.05, 0.5):
        limits = forest.score_thresholds(table, "site", contamination=part, buckets=buckets)
        got = {r.forest_group: r.threshold for r in limits.collect()}
        within = forest.score_thresholds(
            table, "site", contamination=part, buckets=buckets, bounds=(0.0, 1.0)
        )
        assert got == {r.forest_group: r.threshold for r in within.collect()}
        wanted = {
            g: float(np.sort(v)[max(1, math.ceil((1.0 - part) * len(v))) - 1])
            for g, v in groups.items()
        }
        assert got == wanted


def test_threshold_error_is_kept(spark):
    values = np.random.default_rng(4).random(20_000)
    table = land(
        spark.createDataFrame([("s", float(v)) for v in values], "site string, outlierScore double"),
        "scores",
    )
    limit = forest.score_thresholds(table, "site", contamination=0.05, error=0.01, buckets=16)
    share = (values >= limit.first().threshold).mean()
    assert 0.04 <= share <= 0.06


def test_detectors_on_requests(spark, extracted):
    table, sites = extracted
    small = detect.Detector(trees=40, samples=64, buckets=64)
    found, nodes = detect.detect(table, small)
    assert found.columns == detect.OUTPUT_COLUMNS
    assert found.count() == table.count()
    shares = found.groupBy("domain_category").agg(
        F.count("*").alias("n"), F.avg(F.col("anomaly_bool").cast("int")).alias("share")
    )
    # More are allowed only as ties of the lowest anomalous score.
    lowest = found.filter("anomaly_bool").groupBy("domain_category").agg(F.min("outlierScore").alias("low"))
    beyond = found.join(lowest, "domain_category").groupBy("domain_category")
    above = {
        r.domain_category: r.n
        for r in beyond.agg(F.count_if(F.col("outlierScore") > F.col("low")).alias("n")).collect()
    }
    for row in shares.collect():
        assert row.share >= 0.05 - 0.01
        assert above[row.domain_category] <= (0.05 + 0.01) * row.n
    assert nodes.select("forest_group").distinct().count() == len(sites) + 1
    assert dict(found.dtypes)["anomaly_bool"] == "boolean"
    again, _ = detect.detect(table, small, forest=nodes)
    key = ["dec_req_uri", "es_time", "outlierScore"]
    assert found.select(key).exceptAll(again.select(key)).isEmpty()
