"""The exact join of similar sets against all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hitlens.operators import similar


def joined(spark, sets, percent, partitions=3):
    rows = [(key, sorted(terms)) for key, terms in sets.items()]
    table = spark.createDataFrame(rows, "key string, terms array<string>").repartition(partitions)
    links = similar.similar_classes(similar.set_classes(table, "key"), percent)
    return table, links


def brute_force(sets, percent):
    least = {}
    for key, terms in sets.items():
        if terms:
            least[frozenset(terms)] = min(key, least.get(frozenset(terms), key))
    found = set()
    for x, y in combinations(least, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((least[x], least[y]))
            found.add((a, b, len(x & y), len(x | y)))
    return found


def near_sets(seed, count=250):
    """Sets around a few centres, some terms in nearly all of them, copies, and sets of one term."""
    pick = random.Random(seed)
    centres = [{f"t{pick.randrange(400)}" for _ in range(pick.randrange(1, 40))} for _ in range(12)]
    sets = {"empty": set(), "one": {"hot"}, "other": {"hot"}, "accent": {"ñ", "hot"}}
    for k in range(count):
        terms = {x for x in pick.choice(centres) if pick.random() < 0.93}
        terms |= {f"t{pick.randrange(400)}" for _ in range(pick.randrange(3))}
        sets[f"k{k}"] = terms | ({"hot", "warm"} if pick.random() < 0.9 else set())
    return sets


@pytest.mark.parametrize("percent", [30, 75, 80, 100])
def test_equals_all_pairs(spark, percent):
    sets = near_sets(percent)
    table, links = joined(spark, sets, percent)
    wanted = brute_force(sets, percent)
    assert {tuple(r) for r in links.collect()} == wanted
    assert links.count() == len(wanted)
    members = {r.key: r for r in similar.similar_members(table, "key", links).collect()}
    assert set(members) == set(sets)
    for key, row in members.items():
        same = [other for other in sets if sets[other] == sets[key]] if sets[key] else [key]
        assert row.least == min(same)
        assert row.n_links == sum(row.least in pair[:2] for pair in wanted)


def test_border_of_the_similarity(spark):
    """Exactly 75 percent is linked, just below is not, on either side."""
    sets = {
        "base": {f"x{k}" for k in range(8)},
        "six": {f"x{k}" for k in range(6)},
        "five": {f"x{k}" for k in range(5)},
        "more": {f"x{k}" for k in range(10)} | {"y"},
    }
    _, links = joined(spark, sets, 75)
    assert {tuple(r)[:2] for r in links.collect()} == {("base", "six"), ("five", "six")}
    assert brute_force(sets, 75) == {tuple(r) for r in links.collect()}


def test_frequent_terms_do_not_square_rows(spark):
    """Thousands of sets with the same eight common terms and four of their own meet nowhere."""
    rows = spark.range(3000).select(
        F.format_string("k%d", "id").alias("key"),
        F.concat(
            F.array(*[F.lit(f"common{k}") for k in range(8)]),
            F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.format_string("own%d-%d", "id", k)),
        ).alias("terms"),
    )
    classes = similar.set_classes(rows, "key")
    assert similar.meeting_classes(classes, 75).count() == 0


def test_empty_table(spark):
    table, links = joined(spark, {"none": set()}, 75)
    assert links.isEmpty()
    assert [tuple(r) for r in similar.similar_members(table, "key", links).collect()] == [("none", "none", 0)]
    with pytest.raises(ValueError):
        similar.similar_classes(table, 0)


def test_path_sets(spark):
    paths = spark.createDataFrame([("/abab",), ("/abab",), ("/a",), ("",), (None,)], "clean_path string")
    found = {r.clean_path: (r.requests, r.terms) for r in similar.path_sets(paths, 2).collect()}
    assert found == {"/abab": (2, ["/ a", "a b", "b a"]), "/a": (1, ["/ a"]), "": (1, [])}


@pytest.mark.parametrize("percent", [1, 10, 40, 75, 100])
def test_no_link_is_lost_at_any_percent(spark, percent):
    draw = random.Random(percent)
    sets = {f"k{n}": sorted(draw.sample("abcdefghijklmnopqrstuvwxyz", draw.choice([1, 2, 3, 5, 8, 14, 16, 17, 20, 25]))) for n in range(120)}
    classes = similar.set_classes(spark.createDataFrame(list(sets.items()), "key string, terms array<string>"), "key")
    found = {(r.a, r.b): (r.shared, r.total) for r in similar.similar_classes(classes, percent).collect()}
    least = {}
    for key, terms in sets.items():
        least[tuple(terms)] = min(key, least.get(tuple(terms), key))
    expected = {}
    for x, a in least.items():
        for y, b in least.items():
            shared, total = len(set(x) & set(y)), len(set(x) | set(y))
            if a < b and 100 * shared >= percent * total:
                expected[a, b] = (shared, total)
    assert found == expected


def test_terms_of_classes_are_numbers_from_rare_to_frequent(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["x", "y"]), ("c", ["x", "w"])]
    classes = similar.set_classes(spark.createDataFrame(rows, "key string, terms array<string>"), "key")
    found = {r.least: r.terms for r in classes.collect()}
    assert all(isinstance(term, int) for terms in found.values() for term in terms)
    z, y, x = found["a"]
    assert found["b"] == [y, x] and found["c"][1] == x and len({x, y, z, found["c"][0]}) == 4


def test_long_sets_that_share_much_but_not_enough_do_not_meet(spark):
    """Forty terms fill 64 bits; in 256 they tell such sets apart before whole sets are read."""
    draw = random.Random(5)
    rows = [(f"k{n}", [f"c{k}" for k in range(33)] + [f"{k}-{draw.randrange(3)}" for k in range(14)]) for n in range(60)]
    links = sum(100 * len(x & y) >= 75 * len(x | y) for x, y in combinations([set(terms) for _, terms in rows], 2))
    classes = similar.set_classes(spark.createDataFrame(rows, "key string, terms array<string>"), "key")
    assert links <= similar.meeting_classes(classes, 75).count() < links + 0.4 * (60 * 59 / 2 - links)
