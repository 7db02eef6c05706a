import random

import numpy as np
import pytest

from llm_fixtures import documents, edge_rows, prose  # noqa: F401

from hitlens.llm import grouping, near
from hitlens.llm.grouping import components, narrowed, stars


def brute(rows):
    """Component and set size by id, comparing every pair."""
    sets = {}
    for key, text, *_ in rows:
        words = (text or "").encode().lower().split()
        width = min(5, len(words)) or 1
        sets[key] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    label = {key: key for key in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                one, other = sorted((label[a], label[b]))
                label = {key: one if value == other else value for key, value in label.items()}
    return {key: (len(sets[key]), label[key], label[key] == key) for key in keys}


def edited(text, changes, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def check(table, rows):
    got = near.duplicates(table).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_groups_chains_and_borders(documents, prose):
    texts = [prose(k, 30 + 17 * k % 200) for k in range(40)]
    for k in range(12):  # similarities on either side of the border
        texts += [edited(texts[k], changes, k * 50 + changes) for changes in (1, 2, 3, 5, 8)]
    chain = prose(99, 120)
    for k in range(25):
        chain = edited(chain, 2, k)
        texts.append(chain)
    texts += [texts[0].upper(), texts[0], " ".join(texts[1].split()[:-1])]
    rows = [(k * 7 % 1000, text) for k, text in enumerate(texts)]
    check(documents(rows), rows)


def test_edge_cases(documents, edge_rows):
    rows = [row for row in edge_rows if row[0] is not None]
    check(documents(rows[:9] + [(-4, "one two three")]), rows[:9] + [(-4, "one two three")])
    without = near.duplicates(documents([(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in without} == {(None, None, True), (1, 1, True)}


@pytest.mark.parametrize("small", [False, True])
def test_a_large_group_and_a_common_passage(spark, documents, prose, monkeypatch, small):
    base, passage = prose(5, 150), prose(6, 60)
    texts = [edited(base, 1 + k % 4, k) for k in range(120)]
    texts += [prose(1000 + k, 80) + " " + passage + " " + prose(2000 + k, 80) for k in range(60)]
    rows = list(enumerate(texts))
    if small:
        # Branching, blocks of nodes and blocks of clusters.
        monkeypatch.setattr(near, "LEAF", 4)
        monkeypatch.setattr(near, "BLOCK", 30)
    check(documents(rows), rows)


def test_a_large_group_does_not_branch(documents, prose, monkeypatch):
    made, land = [], near.land
    monkeypatch.setattr(near, "land", lambda df, name: made.append((name, land(df, name))) or made[-1][1])
    monkeypatch.setattr(near, "LEAF", 40)
    monkeypatch.setattr(near, "BLOCK", 40)
    base = prose(7, 150)
    rows = [(k, edited(base, 1 + k % 3, k)) for k in range(160)]
    # Linked with some copies only, or with nothing.
    rows += [(1000 + k, edited(rows[k][1], 7, 500 + k)) for k in range(10)]
    rows += [(2000 + k, prose(3000 + k, 60)) for k in range(30)]
    check(documents(rows), rows)
    levels = [df.count() for name, df in made if name == "near-level"]
    assert sum(levels) == 200 * near.TREES * near.ROOT_BRANCHES


def test_links_of_full_sets(prose):
    texts = [prose(1, 80), edited(prose(1, 80), 2, 1), prose(2, 300), prose(3, 6), prose(3, 6)]
    sets = [near.shingles(text.encode()) for text in texts]
    linked = near.similar_pairs(sets)
    for a in range(5):
        for b in range(5):
            shared = len(np.intersect1d(sets[a], sets[b]))
            union = len(sets[a]) + len(sets[b]) - shared
            assert linked[a, b] == (a != b and 100 * shared >= 75 * union)
    assert near.local_components(linked).tolist() == [0, 0, 2, 3, 3]
    strips = near.COLUMNS
    try:
        near.COLUMNS = 7
        assert (near.similar_pairs(sets) == linked).all()
    finally:
        near.COLUMNS = strips


def test_spanning_links_are_a_maximum_forest():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 3, (30, near.COORDINATES)).astype(np.uint32)
    values[15:] += 10
    values[:15, :40] = 1
    values[15:, :40] = 11
    links = near.spanning_links(values, np.zeros(30, int))
    assert len(links) == 28 and all((a < 15) == (b < 15) for a, b in links)
    assert len(near.spanning_links(values, np.arange(30) % 2)) == 28


def test_components_of_paths_and_stars(spark):
    rows = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(100, 180)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in [*range(100, 180), 200]}, 300: 300, 301: 300}


def test_links_that_are_stars_take_one_aggregation(spark, monkeypatch):
    made, land = [], grouping.land
    monkeypatch.setattr(grouping, "land", lambda df, name: made.append(name) or land(df, name))
    rows = [(k, k % 10) for k in range(10, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows + rows[:5] + [(7, 7)], "a long, b long")).collect()}
    assert got == {k: k % 10 for k in range(200)}
    assert made == ["links", "links-least"]


def test_stars_connect_what_links_connect():
    nodes, least = stars([5, 9, 4, 3, 20, 21, 8], [4, 8, 3, 9, 21, 22, 8])
    assert dict(zip(nodes, least)) == {4: 3, 5: 3, 8: 3, 9: 3, 21: 20, 22: 20}


def test_texts_outside_clusters_are_left_out_before_the_shuffle(spark):
    rows = spark.range(0, 100_000).withColumnRenamed("id", "doc_id")
    rows = rows.unionByName(spark.createDataFrame([(None,), (-5,)], "doc_id long"))
    ids = rows.where("doc_id % 100 = 0 or doc_id = -5")
    found = {r.doc_id for r in narrowed(rows, ids.unionByName(ids)).collect()}
    assert found >= {r.doc_id for r in ids.collect()}
    assert len(found) < 1_500
    assert narrowed(rows, ids.where("false")).count() == 0


def test_keep_one(documents, prose):
    text = prose(1, 50)
    table = documents([(5, text), (3, text.upper()), (9, prose(2, 50)), (None, text)])
    left = near.keep_one(table)
    assert left.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == ["3", "9", "None"]
