"""The highest scores of every group."""

import random

import pytest

from conftest import plan_of
from hitlens.operators import listing


def scored(spark, rows, partitions):
    return spark.createDataFrame(rows, "site string, score double, name string").repartition(partitions)


def brute_force(rows, k):
    found = []
    for site in {row[0] for row in rows}:
        inside = sorted((r for r in rows if r[0] == site and r[1] is not None), key=lambda r: (-r[1], r[2]))
        found += [(*row, place) for place, row in enumerate(inside[:k], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("tasks_a_group", [1, 2, 256])
def test_equals_sorting(spark, monkeypatch, tasks_a_group):
    """Ties, repeated rows, missing scores, a hot site and one without a name, over several groups of tasks."""
    monkeypatch.setattr(listing, "TASKS_A_GROUP", tasks_a_group)
    pick = random.Random(tasks_a_group)
    rows = [
        (pick.choice(["hot", "hot", "hot", "b", "c", None]), pick.choice([None, 0.1, 0.5, 0.5, 0.9]), f"n{pick.randrange(300)}")
        for _ in range(900)
    ] + [("few", 0.2, "x"), ("few", 0.2, "x"), ("none", None, "x")]
    for partitions in (1, 7):
        got = listing.highest(scored(spark, rows, partitions), "site", "score", 5, ["name"])
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows, 5)


def test_rows_are_reduced_before_each_shuffle(spark):
    table = scored(spark, [("a", 0.1, "x")], 2)
    plan = plan_of(listing.highest(table, "site", "score", 5, ["name"]))
    assert plan.count("WindowGroupLimit") >= 4
    # Read from below: the first exchange of the windows has a reduction under it.
    assert plan.rindex("WindowGroupLimit") > plan.rindex("hashpartitioning(site")


def test_limits(spark):
    table = scored(spark, [("a", 0.1, "x")], 1)
    for k in (0, 1001):
        with pytest.raises(ValueError):
            listing.highest(table, "site", "score", k)
    assert listing.highest(table.filter("false"), "site", "score").isEmpty()
