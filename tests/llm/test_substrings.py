import random

import pytest

from llm_fixtures import documents, edge_rows, prose  # noqa: F401

from hitlens.llm import substrings


def brute(rows):
    seen, found = set(), []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - substrings.WINDOW + 1):
            window = tuple(words[k : k + substrings.WINDOW])
            if window in seen:
                gone.update(range(k, k + substrings.WINDOW))
            seen.add(window)
        kept = b" ".join(word for k, word in enumerate(words) if k not in gone).decode()
        found.append((str(key), len(words), len(gone), kept))
    return sorted(found)


def check(table, rows):
    got = substrings.remove_repeats(table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)


def passages(prose, n=80):
    draw, texts = random.Random(4), []
    shared = [prose(500 + k, length) for k, length in enumerate((19, 20, 21, 33, 60, 200))]
    for k in range(n):
        parts = [prose(k, draw.randrange(0, 90))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(shared), prose(900 + k, draw.randrange(0, 9))]
        texts.append("\n ".join(parts))
    texts += [texts[3], texts[3] + " tail", "a b " * 50, "a b " * 70, "z " * 19, "z " * 40]
    return [(k * 13 % 997, text) for k, text in enumerate(texts)]


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_passages(documents, prose, parts):
    rows = passages(prose)
    check(documents(rows).repartition(parts), rows)


def test_edge_cases(documents, edge_rows):
    rows = [row for row in edge_rows[:11] if row[0] is not None]
    check(documents(rows), rows)


def test_rows_without_an_id_come_last(documents, prose):
    text = prose(1, 40)
    check(documents([(None, text), (7, text)]), [(None, text), (7, text)])


def test_heavy_parts_and_small_chunks(documents, prose, monkeypatch):
    rows = passages(prose, 60)
    for name, value in (("HEAVY_SAMPLE", 0.9), ("LEAST_HEAVY", 2), ("HEAVY_PER_RANGE", 10**6)):
        monkeypatch.setattr(substrings, name, value)
    table = documents(rows)
    assert len(substrings.heavy_parts(substrings._numbered(table).select("row", "doc", "raw"), 4)) > 10
    check(table, rows)
