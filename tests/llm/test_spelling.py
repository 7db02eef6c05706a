import random
import zlib
from collections import Counter

import pytest

from llm_fixtures import documents, edge_rows  # noqa: F401

from hitlens.llm import spelling


def near(a, b):
    """By the definition: one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_force(counts):
    found = {}
    for word, n in counts.items():
        others = [(-counts[b], b) for b in counts if near(word, b)]
        form = min(others, default=None)
        form = form if form and -form[0] >= 2 * n else None
        found[word] = (form[1] if form else None, n, len(others), -form[0] if form else None)
    rows = {}
    for word, (form, n, n_near, form_n) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        rows[word] = (form, root, n, n_near, form_n)
    return rows


def some_words(seed, n, letters="abcdeé", longest=8):
    draw = random.Random(seed)
    return sorted({"".join(draw.choices(letters, k=draw.randint(5, longest))) for _ in range(n)})


@pytest.mark.parametrize("leaf, searches", [(4096, 16384), (40, 16), (3, 5)])
def test_links_equal_brute_force(spark, leaf, searches):
    """Few letters, so many words share their counts: nodes branch to the last level and by halves."""
    words = some_words(leaf, 400) + ["x" * 300, "x" * 301, "x" * 299 + "y"]
    table = spark.createDataFrame([(w, k + 3) for k, w in enumerate(words)], "word string, n long")
    got = [tuple(row) for row in spelling.links(table, leaf, searches).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b, k + 3) for a in words for k, b in enumerate(words) if near(a, b)}


def test_variants_equal_brute_force(spark, documents):
    draw = random.Random(5)
    base = some_words(1, 60)
    rows, counts = [(None, None), (3, ""), (4, "aé 12 ab-cd")], Counter()
    for doc_id in range(40):
        text = []
        for _ in range(60):
            word = draw.choice(base) if draw.random() < 0.3 else base[min(len(base) - 1, int(draw.expovariate(0.2)))]
            text.append(word.upper() if draw.random() < 0.1 else word)
        rows.append((doc_id + 10, " ".join(text)))
    rows += [rows[-1], (None, rows[5][1])]
    for doc_id, text in rows:
        for run in "".join(c if c.isalpha() else " " for c in text or "").split():
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spelling.DELETE_EVERY == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}
    got = {row.word: tuple(row)[1:] for row in spelling.variants(documents(rows)).collect()}
    assert got == brute_force(counts)
    assert any(form for form, *_ in got.values())


def test_forms_lead_to_roots(spark):
    chain = [(f"w{k:03}", f"w{k + 1:03}") for k in range(40)] + [("other", "w005")]
    got = {row.word: row.root for row in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w040"} and len(got) == 41


def test_edge_cases(spark, documents, edge_rows):
    # Repeated rows count each; a run of 100,000 letters and 30,000 equal words are read whole.
    rows = [*edge_rows, (50, "x" * 100_000), (51, "x" * 100_000), (52, "words words words")]
    got = {row.word: row.n for row in spelling.variants(documents(rows)).collect()}
    assert got.pop("words", 0) == 3 and got.pop("three", 0) == 8
    assert set(got.values()) <= {3} and all(set(word) == {"x"} for word in got)
    assert spelling.variants(documents(rows).limit(0)).count() == 0
