import hashlib
import re
from collections import defaultdict

from llm_fixtures import documents, edge_rows  # noqa: F401

from hitlens.llm import exact


def brute(rows):
    norm = lambda text: re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
    found = defaultdict(list)
    for key, text, *_ in rows:
        found[norm(text)].append(key)
    expected = []
    for text, keys in found.items():
        named = [key for key in keys if key is not None]
        keep = min(named, default=None)
        for key in keys:
            expected.append((key, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()))
    return expected, len(found)


def check(table, rows):
    got = exact.content_groups(table).collect()
    expected, groups = brute(rows)
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, expected))
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_edge_cases(documents, edge_rows):
    check(documents(edge_rows), edge_rows)


def test_a_third_of_all_rows_is_spread(spark, documents):
    rows = [(k, "same  text" if k % 3 == 0 else f"text {k % 400}") for k in range(3000)] + [(0, "same text")] * 5
    check(documents(rows).repartition(7), rows)


def test_common_beginning(documents):
    rows = [(k, "the same beginning of all these texts, a licence " + str(k % 50)) for k in range(200)]
    check(documents(rows), rows)


def test_drop_copies_keeps_columns(documents):
    table = documents([(3, "a b"), (1, "a  b"), (2, "c")])
    left = exact.drop_copies(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
