"""Parsing, cleaning and the extract plan."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, plan_of
from hitlens.functions import tokens
from hitlens.operators import categories, clean, counts, enrich, parse, runlog
from hitlens.plans.extract import extract, requests
from hitlens.plans.extract import run as run_extract
from hitlens.session import ARCHIVE, land, shared_folder, ship_package, size_shuffles, temporary_work
from hitlens.sinks.writers import write_partitioned
from hitlens.sources.readers import local_table, object_store_conf, read_log_text, read_partition
from registry.access_log import log_lines

GOOD = '1.2.3.4 - - [01/Jan/2024:10:30:00 +0000] "GET /a?k=v HTTP/1.1" 200 5 "-" "agent"'


def line(**change):
    parts = dict(
        addr="1.2.3.4", usr="-", at="01/Jan/2024:10:30:00 +0000", method="GET", uri="/a",
        http="HTTP/1.1", status="200", size="5", referer="-", agent="agent", tail="",
    )
    parts.update(change)
    return (
        '{addr} - {usr} [{at}] "{method} {uri} {http}" {status} {size} "{referer}" "{agent}"{tail}'
    ).format(**parts)


def parsed(spark, *lines):
    return parse.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_fields_equal_the_pattern(spark):
    """Each field is what the pattern's own group captures."""
    lines = [
        GOOD,
        line(addr="2001:db8::1"),
        line(http="HTTP/2.0", tail=" 7"),
        line(tail=" tail that is not a number"),
        line(usr="al/ice", uri='/q"uote', agent="a $1 \\2 b"),
        line(referer="", agent="  "),
        line(http="HTTP/2"),
        GOOD.replace('"', ""),
        " " + GOOD,
        "",
    ]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(tuple(r) for r in parse.split_lines(table).collect())
    wanted = [re.match(parse.LINE, x) for x in lines]
    assert got == sorted(tuple(g or "" for g in m.groups()) for m in wanted if m)
    assert parse.rejected_lines(table).count() == sum(m is None for m in wanted)


def test_typed_columns(spark):
    table = parsed(spark, GOOD)
    assert table.columns == (
        "remote_addr remote_usr date_time date time method req_uri http_ver status "
        "body_bytes_sent http_referer user_agent"
    ).split()
    row = table.first()
    assert (row.date, row.time, row.status, row.body_bytes_sent) == ("01/Jan/2024", "10:30:00", 200, 5)


@pytest.mark.parametrize(
    "change, kept",
    [
        ({}, True),
        ({"referer": ""}, False),
        ({"referer": "-"}, True),
        ({"agent": "NaN"}, False),
        ({"agent": " nan "}, False),
        ({"agent": "-NaN"}, False),
        ({"agent": "-nan"}, True),
        ({"agent": "nanny"}, True),
        ({"method": "NAN"}, False),
        ({"agent": "   "}, False),
        ({"size": "99999999999"}, False),
        ({"size": "2147483647"}, True),
    ],
)
def test_incomplete_rows(spark, change, kept):
    table = parsed(spark, line(**change))
    assert clean.complete_rows(table).count() == kept
    assert clean.drop_incomplete(clean.blank_to_null(table)).count() == kept


def test_nan_numbers_become_null(spark):
    table = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, y int")
    assert [tuple(r) for r in clean.blank_to_null(table).collect()] == [(None, 1), (2.0, None)]


def test_gzip_ratio_does_not_make_a_request_distinct(spark):
    table = parsed(spark, GOOD, GOOD, GOOD + " 5", line(uri="/b"))
    assert clean.distinct_requests(table).count() == 2


def test_extract_has_one_wide_shuffle_and_no_python(spark):
    plan = plan_of(extract(log_lines(spark, SMALL), ["a.example"]))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("regexp_replace(value") == 1


def test_categories_by_list_and_by_table(spark):
    table = local_table(spark, [("a",), ("b",), ("Unknown",), ("a",)], ["domain"])
    listed = enrich.add_domain_category(table, ["a"])
    joined = enrich.add_domain_category(table, local_table(spark, [("a",), ("a",)], ["domain"]))
    wanted = [("Unknown", "other"), ("a", "a"), ("a", "a"), ("b", "other")]
    assert sorted(map(tuple, listed.collect())) == wanted
    assert sorted(map(tuple, joined.collect())) == wanted
    assert enrich.add_domain_category(table, []).filter("domain_category = 'other'").count() == 4


def test_partition_filter_and_columns_reach_the_scan(spark, extracted, tmp_path):
    table, sites = extracted
    path = str(tmp_path / "by-site")
    write_partitioned(table, path, "domain_category")
    plan = plan_of(
        read_partition(spark, path, "domain_category", sites[0]).select("status").filter("status = 200")
    )
    assert re.search(r"PartitionFilters: \[isnotnull\(domain_category.*= " + re.escape(sites[0]), plan)
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,200)]" in plan
    assert "ReadSchema: struct<status:int>" in plan
    assert spark.read.parquet(path).count() == table.count()


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, site string")
    write_partitioned(one, path, "site")
    with pytest.raises(Exception, match="already exists"):
        write_partitioned(one, path, "site")
    assert spark.read.parquet(path).count() == 2
    write_partitioned(one, path, "site", mode="append")
    assert spark.read.parquet(path).count() == 4
    write_partitioned(one.filter("id = 1"), path, "site", keep_others=True)
    assert spark.read.parquet(path).count() == 3
    write_partitioned(one, path, "site", mode="overwrite")
    assert spark.read.parquet(path).count() == 2


def test_two_days_in_sequence(spark, tmp_path):
    outcomes = [{}, {}]
    for day in (1, 2):
        methods = ("GET", "POST")
        lines = [
            line(at=f"0{day}/Jan/2024:10:30:0{k} +0000", method=methods[k % 2], referer=f"http://{"ab"[k % 2]}/x")
            for k in range(5)
        ] * 2
        lines += [line(at="31/Feb/2024:10:30:00 +0000"), line(agent="NaN"), "none"]
        (tmp_path / str(day)).mkdir()
        (tmp_path / str(day) / "x.log").write_text("\n".join(lines) + "\n")
        logs, output = str(tmp_path / str(day)), str(tmp_path / "out")
        report = str(tmp_path / f"report{day}")
        run_extract(spark, logs, output, str(tmp_path / "meta"), report, ["a", "b"], "append")
        log = spark.read.option("header", "true").csv(report).collect()
        outcomes[day - 1] = {r.Metric: r.Value for r in log}
    table = spark.read.parquet(output)
    assert table.count() == 10 and table.filter("fabstime IS NULL").isEmpty()
    assert sorted(r.date for r in table.select("date").distinct().collect()) == ["01/Jan/2024", "02/Jan/2024"]
    for log in outcomes:
        assert log["Volume"] == "5, 21"
        assert (log["Rejected"], log["Incomplete"], log["Bad dates"]) == ("1", "1", "1")
    with pytest.raises(Exception, match="already exists"):
        run_extract(spark, logs, output, str(tmp_path / "meta"), report, ["a", "b"])
    assert spark.read.parquet(output).count() == 10


def test_appending_a_file_twice_adds_nothing(spark, extracted, tmp_path):
    logs, output = str(tmp_path / "logs"), str(tmp_path / "out")
    log_lines(spark, SMALL).write.text(logs)

    def run(mode="append", name="r"):
        run_extract(spark, logs, output, str(tmp_path / "meta"), str(tmp_path / name), extracted[1], mode)
        log = spark.read.option("header", "true").csv(str(tmp_path / name)).collect()
        return {r.Metric: r.Value for r in log}["Volume"]

    first = run()
    rows = spark.read.parquet(output)
    once = rows.count()
    assert first == f"{once}, 21" and once == rows.select(parse.REQUEST_KEY).distinct().count()
    assert run() == "0, 21"
    again = spark.read.parquet(output)
    assert again.count() == once and again.exceptAll(rows).isEmpty()
    # A run that was cut short: what is missing comes back, the rest is not doubled.
    kept = land(rows.filter("crc32(remote_addr) % 3 > 0"), "kept")
    write_partitioned(kept, output, "domain_category", mode="overwrite")
    assert run() == f"{once - kept.count()}, 21"
    assert spark.read.parquet(output).count() == once


def test_unseen_rows_read_the_days_in_question_only(spark, tmp_path):
    path = str(tmp_path / "stored")
    for day in (1, 2, 3, 9):
        rows = extract(spark.createDataFrame([(line(at=f"0{day}/Jan/2024:23:59:59 +0000"),)], "value string"), ["a"])
        rows.coalesce(1).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    new = land(
        extract(
            spark.createDataFrame(
                [(line(at=f"0{day}/Jan/2024:23:59:59 +0000", agent=agent),) for day in (2, 9) for agent in ("agent", "new")],
                "value string",
            ),
            ["a"],
        ),
        "new",
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    found = clean.unseen_rows(new, stored, parse.REQUEST_KEY, "dateunixtimest")
    assert sorted((r.date, r.user_agent) for r in found.collect()) == [("02/Jan/2024", "new"), ("09/Jan/2024", "new")]
    start, day = 1_704_067_200, 86_400
    scan = next(x for x in plan_of(found).splitlines() if "FileScan" in x and f"{path}]" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for first, end in ((1, 2), (8, 9)):
        assert f"GreaterThanOrEqual(dateunixtimest,{start + first * day})" in scan
        assert f"LessThan(dateunixtimest,{start + end * day})" in scan
    assert "clean_path" not in scan.split("ReadSchema")[1]
    assert found.columns == new.columns
    assert clean.unseen_rows(new.filter("false"), stored, parse.REQUEST_KEY, "dateunixtimest").isEmpty()
    assert clean.unseen_rows(new, stored.filter("false"), parse.REQUEST_KEY, "dateunixtimest").count() == 4


def test_many_days_become_one_range(spark, monkeypatch):
    monkeypatch.setattr(clean, "MOST_SPANS", 2)
    rows = [(day, day * 86_400 + 50) for day in (-3, 1, 2, 5, 9, 20)]
    table = spark.createDataFrame(rows, "id int, t bigint")
    left = clean.unseen_rows(table, table.filter("id in (2, 9)"), ["id"], "t")
    assert sorted(r.id for r in left.collect()) == [-3, 1, 5, 20]


def test_recursive_text(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.log").write_text("one\ntwo\n")
    (tmp_path / "a" / "b" / "y.log").write_text("three\n")
    assert sorted(r.value for r in read_log_text(spark, str(tmp_path)).collect()) == ["one", "three", "two"]


def test_token_classes(spark):
    words = ["123456789012345678901234", "abcdef012345678901234567", "42", "v1", "", "42x"]
    table = spark.createDataFrame([(words,)], "w array<string>")
    got = table.select(tokens.classify_tokens(F.col("w"))).first()[0]
    assert got == ["MONGOID", "MONGOID", "DIGIT", "v1", "", "42x"]


def test_query_values(spark):
    table = spark.createDataFrame([(["a=b=c", "=v", "k="],)], "p array<string>")
    row = table.select(
        tokens.query_keys(F.col("p")), tokens.query_values(F.col("p")), tokens.query_values_cut(F.col("p"))
    ).first()
    assert list(row) == [["a", "", "k"], ["b=c", "v", ""], ["b", "v", ""]]


def test_weighted_and_plain_sizes(spark):
    table = spark.createDataFrame([("/a",), ("/a/b/c",)], "clean_path string")
    weighted = counts.token_profile(table).first()
    assert (weighted.unique_words, weighted.avg_array_length) == (4, 20 / 6)
    assert counts.path_size_profile(table).first().avg_array_length == 3.0
    assert counts.token_profile(table, approximate=True).first().unique_words == 4


def test_category_index_is_the_indexer_order(spark):
    values = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["d"]
    table = local_table(spark, [(v,) for v in values], ["method"]).repartition(3)
    ranked = {r.label: r["index"] for r in categories.category_index(table, "method").collect()}
    assert ranked == {"c": 0, "a": 1, "b": 2, "d": 3}
    from pyspark.ml.feature import StringIndexer

    own = categories.fit_indexer(table, "method")
    assert own.labels == StringIndexer(inputCol="method", outputCol="i").fit(table).labels
    with pytest.raises(ValueError, match="more than 2"):
        categories.fit_indexer(table, "method", max_labels=2)


def test_row_numbers_are_global_under_many_partitions(spark):
    table = spark.range(5000).selectExpr("id % 700 AS v", "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = categories.number_rows(table, F.desc("v"), F.asc("id"), name="n").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbered = numbered.sort_values(["v", "id"], ascending=[False, True])
    assert numbered.n.tolist() == list(range(5000))


def test_run_log_and_stored_rows(spark, tmp_path):
    path = str(tmp_path / "ten")
    assert runlog.stored_rows(spark, path) == 0
    spark.range(10).write.parquet(path)
    assert runlog.stored_rows(spark, path) == 10
    log = runlog.run_log(spark, [("Volume", runlog.volume_text(10, 1)), ("Accuracy", 0.5)])
    assert [tuple(r) for r in log.collect()] == [("Volume", "10, 1"), ("Accuracy", "0.5")]


def test_session_zone_is_checked(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Mexico_City")
    try:
        with pytest.raises(ValueError, match="UTC"):
            requests(spark.createDataFrame([(GOOD,)], "value string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_temporary_work_deletes_only_its_own(spark):
    outer = land(spark.range(3), "outer")
    with temporary_work(spark):
        inner = land(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3
    assert not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))


def test_package_is_shipped_once(spark):
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext._python_includes.count(ARCHIVE) == 1

    def places(batches):
        import sys

        for batch in batches:
            yield batch.assign(found=any(path.endswith(ARCHIVE) for path in sys.path))

    assert spark.range(1).mapInPandas(places, "id long, found boolean").first().found


def test_shuffle_partitions_follow_the_input(spark, tmp_path):
    (tmp_path / "day").mkdir()
    (tmp_path / "day" / "x.log").write_text("x" * 10_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, str(tmp_path)) == int(before)
        assert size_shuffles(spark, str(tmp_path / "*"), 2.0, partition_bytes=1000) == 20
        assert size_shuffles(spark, str(tmp_path)) == 20
        assert size_shuffles(spark, str(tmp_path), partition_bytes=1) == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("master", ["spark://somewhere:7077", "local-cluster[3,2,1024]"])
def test_missing_shared_folder_is_an_error_on_a_cluster(master):
    class Context:
        def getCheckpointDir(self):
            return None

    Context.master = master

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_object_store_settings():
    conf = object_store_conf("http://store:9000", "key", "secret")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true" and len(conf) == 4
