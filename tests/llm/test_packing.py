import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import documents, edge_rows, prose  # noqa: F401

from hitlens.llm import packing
from hitlens.llm.queries import vocabulary_path


def lengths(sequences):
    return [sum(length for *_, length in parts) for parts in sequences]


def covered(sequences, sizes):
    """Whether every token is in one part."""
    found = sorted(part for parts in sequences for part in parts)
    seen = [np.zeros(size, int) for size in sizes]
    for item, start, length in found:
        assert length > 0
        seen[item][start : start + length] += 1
    return all((one == 1).all() for one in seen)


def padding(sequences, capacity):
    return sum(capacity - n for n in lengths(sequences) if n & (n - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_plan_holds_every_token_once(sizes):
    sequences = packing.plan(np.array(sizes), 64)
    assert covered(sequences, sizes) and max(lengths(sequences)) <= 64


@pytest.mark.parametrize(
    "sizes",
    [[1300], [2049] * 300, [1400] * 300, [4096] * 3, np.random.default_rng(2).integers(1, 4097, 500), range(3, 900)],
    ids=["one", "over a half", "over a third", "full", "random", "small"],
)
def test_little_padding(sizes):
    sizes = np.array(sizes)
    sequences = packing.plan(sizes, 4096)
    assert covered(sequences, sizes)
    assert padding(sequences, 4096) <= 0.02 * sizes.sum()


def test_differencing_is_near_equal():
    """Within a percent of the even share, and never worse than filling the emptiest window in turn."""
    draw = np.random.default_rng(7)
    for _ in range(20):
        sizes, k = draw.integers(1, 1000, 200), 12
        window = packing.difference(sizes, k)
        sums = np.bincount(window, sizes, k)
        greedy = np.zeros(k)
        for size in -np.sort(-sizes):
            greedy[greedy.argmin()] += size
        assert np.ptp(sums) <= np.ptp(greedy)
        assert np.ptp(sums) <= 0.01 * sums.mean()
    # The textbook case: 8, 7, 6, 5, 4 differ by 2 after differencing.
    assert np.ptp(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == 2


def test_windows_rise_with_capacity():
    window, k = packing.near_equal(np.array([3, 3, 3, 3]), 5, float("inf"))
    assert k == 4 and sorted(window) == [0, 1, 2, 3]
    assert packing.near_equal(np.array([3, 3, 3, 3]), 5, 3) is None


@pytest.mark.parametrize("capacity, group", [(4096, 256), (64, 2)])
def test_round_trip(spark, documents, edge_rows, prose, capacity, group):
    rows = [*edge_rows, *((100 + k, prose(k, 1 + 37 * k % 500)) for k in range(40))]
    path = vocabulary_path()
    found = packing.pieces(documents(rows), path, capacity=capacity, group=group).toPandas()
    encode = Tokenizer.from_file(path).encode
    want = sorted(
        [(-1 if key is None else key, (*encode(text or "", add_special_tokens=False).ids, 2)) for key, text, *_ in rows]
    )
    found["doc_id"] = found.doc_id.fillna(-1).astype(int)
    ids = [np.frombuffer(bytes(raw), "<u4") for raw in found.ids]
    assert [len(one) for one in ids] == found.length.tolist()
    found["ids"] = [tuple(one.tolist()) for one in ids]
    # Rows of one id are documents of their own: their pieces by length of document and start.
    total = sum(len(tokens) for _, tokens in want)
    assert found.length.sum() == total
    single = {key: tokens for key, tokens in want if sum(key == other for other, _ in want) == 1}
    for key, tokens in single.items():
        own = found[found.doc_id == key].sort_values("start")
        assert sum(own.ids, ()) == tokens and set(own.doc_tokens) == {len(tokens)}
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        size = own.length.sum()
        assert size <= capacity and set(own.padded) == {size if size & (size - 1) == 0 else capacity}


def test_padding_of_a_table(spark, documents, prose):
    rows = [(k, prose(k, 10 + 53 * k % 700)) for k in range(300)]
    found = packing.padding(packing.pieces(documents(rows).coalesce(2), vocabulary_path())).first()
    assert found.tokens <= found.padded <= 1.02 * found.tokens


def test_empty_table(spark, documents):
    assert packing.pieces(documents([(1, "a")]).where(F.lit(False)), vocabulary_path()).count() == 0
