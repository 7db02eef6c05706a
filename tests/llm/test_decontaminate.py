import random

from llm_fixtures import documents, prose  # noqa: F401

from hitlens.llm import decontaminate

ITEM = (
    "Yesterday morning Alice bought 12 apples from the old market while Bob carried 7 kg of sand, and later "
    "Alice gave 5 of them to Bob. How many apples does Alice have left at the end?"
)


def found(spark, documents, texts, items=((1, ITEM),)):
    benchmark = spark.createDataFrame(list(items), "item_id long, text string")
    rows = decontaminate.leaks(documents(list(enumerate(texts))), benchmark).collect()
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_literal, r.n_changed) for r in rows}


def test_literal_and_changed_questions(spark, documents, prose):
    changed = ITEM.replace("Alice", "Carol").replace("Bob", "David").replace("12", "31").replace("7 kg", "9 lb")
    crossed = changed.replace("does Carol", "does Erin")
    texts = [prose(1, 80) + " " + ITEM + " " + prose(2, 80), ITEM.upper(), changed, crossed, prose(3, 400), None, ""]
    got = found(spark, documents, texts)
    assert {doc for doc, _ in got} == {0, 1, 2}
    assert got[0, 1][1] == got[1, 1][1] > 10
    assert got[2, 1][1] == 0 and got[2, 1][2] == 5 and got[2, 1][0] > 5


def test_part_of_an_item(spark, documents, prose):
    words = ITEM.split()
    texts = [" ".join(words[5:18]), " ".join(words[5:17]), " ".join(words[:13]) + " " + prose(1, 9)]
    assert {doc for doc, _ in found(spark, documents, texts)} == {0, 2}


def test_short_items_are_one_window(spark, documents, prose):
    items = [(1, "what is the capital of xanadu"), (2, "too short"), (3, None)]
    texts = [prose(1, 30) + " What is the capital of Xanadu? " + prose(2, 30), "too short"]
    assert set(found(spark, documents, texts, items)) == {(0, 1)}


def test_repeated_rows_and_no_benchmark(spark, documents):
    rows = documents([(1, ITEM), (1, ITEM), (None, ITEM)])
    benchmark = spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id long, text string")
    got = decontaminate.leaks(rows, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    left = decontaminate.drop_leaks(rows, benchmark)
    assert left.columns == rows.columns and [r.doc_id for r in left.collect()] == [None]
    assert decontaminate.leaks(rows, benchmark.limit(0)).count() == 0


def brute(doc, item):
    """Counts of an item in a document, distance by distance over all places."""

    def words(text):
        said = [c for c in map(decontaminate.canonical, (text or "").split()) if c[0]]
        kinds = [k for _, k in said]
        return [
            (w, decontaminate.PLAIN if k == decontaminate.UNIT and (n == 0 or kinds[n - 1] != decontaminate.NUMBER) else k)
            for n, (w, k) in enumerate(said)
        ]

    theirs, ours, best = words(item), words(doc), []
    width = min(len(theirs), 13)
    count = len(theirs) - width + 1
    for shift in range(-len(theirs), len(ours)):
        literal, places, pairs, plain = set(), set(), set(), set()
        for at in range(count):
            if at + shift < 0 or at + shift + width > len(ours):
                continue
            both = list(zip(range(at, at + width), theirs[at : at + width], ours[at + shift : at + shift + width]))
            if all(a[0] == b[0] for _, a, b in both):
                literal.add(at)
                plain |= {k for k, _, _ in both}
            if all(a[1] == b[1] and (a[1] > decontaminate.PLAIN or a[0] == b[0]) for _, a, b in both):
                if any(a[1] > decontaminate.PLAIN for _, a, _ in both):
                    places.add(at)
                    plain |= {k for k, a, _ in both if a[1] == decontaminate.PLAIN}
                    pairs |= {(k, *a, b[0]) for k, a, b in both if a[1] > decontaminate.PLAIN}
        names = {(a, b) for _, a, kind, b in pairs if kind == decontaminate.NAME}
        follows = len({a for a, _ in names}) == len({b for _, b in names}) == len(names)
        follows = follows and (len(plain) >= 8 or bool(plain) and 2 * len(places | literal) >= count)
        changed = sum(a != b for a, b in names) + sum(a != b for _, a, kind, b in pairs if kind != decontaminate.NAME)
        if follows and places | literal or literal:
            best.append((places | literal if follows else literal, literal, changed if follows else 0))
    if best:
        return len(set().union(*(b[0] for b in best))), len(set().union(*(b[1] for b in best))), min(b[2] for b in best)


def test_questions_of_many_slots(spark, documents, prose):
    items = [
        (1, "What is 12 plus 45 minus 7"),
        (2, "Tom has 3 apples 5 pears and 7 plums Ann has 4 apples"),
        (3, "Tom bought 3 big red apples and then Ann sold 3 small pears"),
        (4, "3 4 5 6 7 8 9"),
    ]
    changed = [
        "What is 31 plus 8 minus 90",
        "Bob has 6 apples 2 pears and 9 plums Eve has 5 apples",
        "Tom bought 4 big red apples and then Ann sold 6 small pears",
        "1 2 3 4 5 6 7",
    ]
    texts = [prose(k, 20) + " " + text + " " + prose(k + 9, 20) for k, text in enumerate(changed)]
    got = found(spark, documents, texts, items)
    assert got == {(0, 1): (1, 0, 3), (1, 2): (1, 0, 6), (2, 3): (1, 0, 2)}


def test_number_dense_items_against_brute_force(spark, documents):
    draw = random.Random(5)
    kinds = (
        lambda: str(draw.randrange(30)), lambda: draw.choice(["Tom", "Ann", "Bob"]), lambda: draw.choice(["kg", "miles"]),
        lambda: draw.choice(["has", "apples", "and", "gives", "to"]),
    )
    items = [(k, " ".join(draw.choice(kinds)() for _ in range(draw.randrange(6, 40)))) for k in range(25)]
    texts = []
    for k in range(75):
        words = items[k % 25][1].split()
        renamed = dict(zip(("Tom", "Ann", "Bob"), draw.sample(["Eve", "Max", "Ann", "Zoe"], 3)))
        words = [str(draw.randrange(99)) if w.isdigit() else renamed.get(w, w) for w in words]
        if k >= 25:
            begin = draw.randrange(len(words) // 2)
            words = words[begin : begin + draw.randrange(5, 40)]
        if k >= 50:
            words[draw.randrange(len(words))] = draw.choice(["Eve", "has", "5"])
        texts.append(" ".join(["x y z", *words, "z y x"]))
    got = found(spark, documents, texts, items)
    expected = {(d, k): n for d, text in enumerate(texts) for k, item in items if (n := brute(text, item))}
    assert got == expected and {(k, k) for k in range(25)} <= set(got)


def test_short_items_and_texts_without_blanks(spark, documents, prose):
    items = [
        (1, "too short"), (2, "Who wrote Xanadu?"), (3, "中国的首都是哪里？"), (4, "小明有12个苹果，给了小红5个，还剩几个苹果？"), (5, "你好吗"),
        (6, "ประเทศไทยมีเมืองหลวงชื่ออะไร"), (7, "Why?"),
    ]
    texts = [
        "too short", prose(1, 9) + "\n Too short! \n" + prose(2, 9), prose(1, 9) + " too short " + prose(2, 9),
        prose(3, 9) + " who wrote Xanadu " + prose(4, 9), "他问：中国的首都是哪里？没有人知道。", "题目：小明有31个苹果，给了小红8个，还剩几个苹果？",
        "他说你好吗，我说好", "他说\n你好吗？\n好", "ถามว่าประเทศไทยมีเมืองหลวงชื่ออะไรครับ", "why\n", "— why — so", "中国的首都不是上海",
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(list(enumerate(texts)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark, lines=True).collect()}
    assert got == {(0, 1), (1, 1), (3, 2), (4, 3), (5, 4), (7, 5), (8, 6), (9, 7)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()} == {2, 6, 10, 11}


def test_windows_of_slots_only_count_along_an_item_alone(spark, documents):
    """Long runs of numbers: tables say nothing, a re-parameterised item is met with its whole run."""
    draw = random.Random(11)

    def numbers(n):
        return " ".join(str(draw.randrange(1, 500)) for _ in range(n))

    said = "so add all of them up and write down the sum that they have"
    items = [(0, numbers(60)), (1, f"{numbers(30)} {said}"), (2, f"{said} {numbers(25)} {said} {numbers(18)}")]
    again = [" ".join(str(draw.randrange(500)) if w.isdigit() else w for w in text.split()) for _, text in items]
    texts = [numbers(300), items[0][1], f"{numbers(40)} {again[1]} {numbers(40)}", again[2], again[0], f"{again[2]} {again[1]}"]
    got = found(spark, documents, texts, items)
    expected = {(d, k): n for d, text in enumerate(texts) for k, item in items if (n := brute(text, item))}
    assert got == expected and set(got) >= {(1, 0), (2, 1), (3, 2), (5, 1), (5, 2)} and not {0, 4} & {d for d, _ in got}


def test_number_tables_make_no_pairs(spark, documents):
    """Twenty tables of 3,000 numbers against an item of 60 would be 2.9 million pairs of windows."""
    draw = random.Random(12)
    texts = [" ".join(str(draw.randrange(500)) for _ in range(3000)) for _ in range(20)]
    benchmark = spark.createDataFrame([(1, " ".join(map(str, range(60))))], "item_id long, text string")
    leaks = decontaminate.leaks(documents(list(enumerate(texts))), benchmark)
    assert leaks.isEmpty()
    joins = [line for line in leaks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    # By hash only where a word is plain; windows of slots only meet at a known place.
    assert all("place" in line for line in joins if "eqnullsafe" in line.lower() or "<=>" in line)
    assert any("place" in line and "hash" in line for line in joins)
