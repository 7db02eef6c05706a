from collections import defaultdict

from pyspark.sql import functions as F

from llm_fixtures import documents, prose  # noqa: F401

from hitlens.llm import mixing


def filled(sizes):
    """Targets by repeated sharing, as the rule says."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, at_limit = sum(sizes.values()), {}
    while True:
        open_ones = [s for s in sizes if s not in at_limit]
        left = total - sum(at_limit.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_ones) for s in open_ones}
        over = {s: 3 * sizes[s] for s in open_ones if share[s] > 3 * sizes[s]}
        if not over:
            return share | at_limit
        at_limit |= over


def test_targets_and_words(documents, prose):
    rows, number = [], 0
    for source, count in (("a", 3), ("b", 40), ("c", 90), ("d", 2), (None, 25)):
        for _ in range(count):
            rows.append((number, prose(number, 7 + number % 60), source))
            number += 1
    rows += [(number, "", "a"), (number + 1, None, "b"), (number + 2, "", "empty"), rows[5], rows[5]]
    got = mixing.words_taken(documents(rows), least_block=16).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    source_of = {key: source for key, _, source in rows}
    for row in got:
        sizes[source_of[row.doc_id]] += row["size"]
        taken[source_of[row.doc_id]] += row.taken
        assert row.taken <= 3 * row["size"]
    expected = filled(sizes)
    for row in got:
        assert abs(row.target - expected[source_of[row.doc_id]]) < 1e-6
        assert row.source_size == sizes[source_of[row.doc_id]]
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 0.5
    again = mixing.words_taken(documents(rows), least_block=16).collect()
    order = lambda r: (r.doc_id, r.row)
    assert sorted(got, key=order) == sorted(again, key=order)


def test_every_stretch_is_mixed(documents, prose):
    rows = [(k, prose(k, 50), "abc"[k % 3]) for k in range(300)]
    line, pieces = mixing.mixed(documents(rows), least_block=32)
    assert pieces.where("length <= 0").count() == 0
    sids = line.select("row", "sid", "target").distinct()
    slots = pieces.join(sids, "row").groupBy("slot", "sid").agg(F.sum("length").alias("n")).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)
    half = slots[: len(slots) // 2]
    whole = sum(r.n for r in slots)
    for sid in (1, 2, 3):
        share = sum(r.n for r in slots if r.sid == sid) / whole
        assert abs(sum(r.n for r in half if r.sid == sid) / sum(r.n for r in half) - share) < 0.03


def test_one_source_holds_most_rows(documents, prose):
    rows = [(k, prose(k, 20), "hot" if k % 10 else "rare") for k in range(2000)]
    got = mixing.words_taken(documents(rows)).collect()
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)


def test_documents_repeat(documents):
    table = documents([(k, "a b c d e f g h i j", "x" if k < 2 else "y") for k in range(30)])
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts[0] == counts[1] == 3 and all(counts.get(k, 0) <= 1 for k in range(2, 30))


def test_scans_may_deal_rows_anew(spark, documents, prose, tmp_path, monkeypatch):
    rows = [(k, prose(k, 10 + k % 7), "ab"[k % 2]) for k in range(160)]
    documents(rows, clashing=False).repartition(8).write.parquet(str(tmp_path / "docs"))
    docs, bytes_key = spark.read.parquet(str(tmp_path / "docs")), "spark.sql.files.maxPartitionBytes"

    def counts():
        return sorted((r.doc_id, r["count"]) for r in mixing.mix_documents(docs).groupBy("doc_id").count().collect())

    expected, before, land = counts(), spark.conf.get(bytes_key), mixing.land

    def landed(df, name):
        found = land(df, name)
        spark.conf.set(bytes_key, "1k")
        return found

    monkeypatch.setattr(mixing, "land", landed)
    try:
        assert counts() == expected and len(expected) > 100
    finally:
        spark.conf.set(bytes_key, before)
