import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    """By the definition, with integers of any size."""
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    found = []
    for at, (anchor, label, own) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (-sum(x * y for x, y in zip(own, vector)), 2**63 if vec_id is None else vec_id, other == label)
            for place, (vec_id, other, vector) in enumerate(used) if place != at
        ]
        scored.sort()
        for ps, positive, _ in [one for one in scored if one[2]][:5]:
            window = [(s, k) for s, k, same in scored if not same and 50 * -ps <= 100 * -s and 100 * -s <= 95 * -ps]
            for rank, (s, k) in enumerate(window[:3]):
                found.append((anchor, None if positive == 2**63 else positive, rank + 1, None if k == 2**63 else k, -ps, -s))
    return sorted(found, key=repr)


def vectors(seed, n, width=6, labels=4, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.4, (labels, width))
    rows = []
    for k in range(n):
        label = int(draw.integers(labels))
        rows.append((k, [float(x) for x in np.float32(centres[label] + draw.normal(0, spread, width))], label))
    return rows


def got(spark, rows, **options):
    return sorted((tuple(row) for row in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    """Small blocks, pages and groups, so many are skipped and merged."""
    for name, size in {"BLOCK": 16, "PAGE": 3, "GROUP": 4}.items():
        monkeypatch.setattr(negatives, name, size)
    monkeypatch.setattr(negatives.numbered, "__defaults__", (50, 16, 4))
    monkeypatch.setattr(negatives.wanted_blocks, "__defaults__", (3,))
    rows = vectors(1, 700)
    want = brute_force(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_ties_copies_and_gaps(spark):
    rows = vectors(2, 300, width=3, labels=2)
    copies = [(k + 1000, rows[50][1], rows[50][2]) for k in range(400)]
    odd = [
        (None, rows[51][1], 0), (None, rows[52][1], 1), (50, None, 1), (100, [0.1, None, 0.2], 1), (150, [0.1, 0.2, 0.3], None),
        (200, [float("nan"), 0.0, 0.0], 1), (250, [float("inf"), 0.0, 0.0], 1), (3, rows[3][1], rows[3][2]),
        (300, [0.5], 0), (350, [], 1), (400, [0.0, 0.0, 0.0], 2), (2000, rows[50][1], 9),
    ]
    table = rows + copies + odd
    want = brute_force(table)
    assert want and got(spark, table) == want


def test_empty_and_without_anchors(spark):
    assert got(spark, []) == [] and got(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert got(spark, [(50, [0.5], 1)]) == []


def test_extra_columns(spark):
    rows = vectors(3, 120)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("other") for n in ("row", "block", "group", "vector")})
    assert sorted((tuple(r) for r in negatives.hard_negatives(table).collect()), key=repr) == brute_force(rows)


@pytest.mark.parametrize("width, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_neighbours(width, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
    keys = negatives.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    draw = np.random.default_rng(4)
    anchors, block = draw.integers(-200, 200, (30, 5)), draw.integers(-200, 200, (40, 5))
    low, high = negatives.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = anchors @ block.T
    assert (low <= scores.min(axis=1)[:, None]).all() and (high >= scores.max(axis=1)[:, None]).all()
    one = negatives.bounds(anchors, block[:1], block[:1])
    assert (one[0] == scores[:, :1]).all() and (one[1] == scores[:, :1]).all()


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**26 - 1] * 8], np.int64)
    assert negatives.products(a, a)[0, 0] == 8 * (2**26 - 1) ** 2


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Clusters far apart: most blocks of other labels cannot meet a window."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(2000):
        cluster = k % 8
        centre = [3.0 if place == cluster else 0.0 for place in range(8)]
        rows.append((k, [c + float(x) for c, x in zip(centre, draw.normal(0, 0.05, 8))], cluster))
    monkeypatch.setattr(negatives.numbered, "__defaults__", (50, 32, 8))
    used = negatives.usable(spark.createDataFrame(rows, SCHEMA))
    measured = negatives.spread(used)
    candidates = negatives.blocks(negatives.numbered(used, measured), 8)
    anchors = candidates.mapInArrow(lambda b: negatives._anchors(8, 5, b), negatives.ANCHOR_SCHEMA)
    first = negatives.packed(anchors.withColumns({"lows": F.array("low"), "highs": F.array(F.lit(negatives.NO_ID))}))
    read = negatives.wanted_blocks(first, candidates, 8, same=True).count()
    assert read < 0.5 * first.count() * candidates.count()
