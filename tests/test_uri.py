"""URI expressions against urllib, which defines their results."""

import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from hitlens.functions import times, uri

URIS = [
    "/a+b%20c%zz%C3%B1%ff",
    "/p%3Fk=v%23f",
    "/x;s=1?k=v",
    "/x;a/y;b",
    "//host/p?k=1",
    "http://h/p",
    "http://h/p;x=1?y=2",
    "android-app://a.b/p;x",
    "/p?k=&j&=v&a=b=c&d=%2526",
    "/p?a+b=c+d&e=%26f%3D&g=%zz",
    "/a%0Ab?c=d",
    "%20/lead?x=1",
    "%09//h%20x/p",
    "/a",
    "*",
    "",
    "host:443",
    "/p?==&a==b&&&x=1#f?z=2",
    "/p#f?x=1",
    "/%",
    "/%4",
    "/café%C3%A9",
    "/x?y=ñ&%C3%B1=%F0%9F%98%80",
    "/a;b;c",
    "/;",
]
REFERERS = [
    "-",
    "",
    "//-/x",
    "http://u:p@H.example:8080/x",
    "android-app://a.b/",
    "https://a.example",
    "https://a.example?x",
    "https://a.example#x",
    "http:///p",
    "not a url",
    " https://lead.example/",
    "1http://h/x",
    "//h.example/x",
]


def expected(raw):
    decoded = urllib.parse.unquote(raw)
    parsed = urllib.parse.urlparse(decoded)
    pairs = [f"{k}={v}" for k, v in urllib.parse.parse_qsl(parsed.query)]
    return decoded, parsed.path, pairs


def computed(spark, raw):
    table = spark.createDataFrame([(u,) for u in raw], "raw string")
    table = table.withColumn("dec", uri.decode_uri(F.col("raw")))
    table = table.withColumns(
        {"path": uri.uri_path(F.col("dec")), "pairs": uri.uri_query_pairs(F.col("dec"))}
    )
    return {r.raw: (r.dec, r.path, r.pairs) for r in table.collect()}


def test_edge_cases(spark):
    got = computed(spark, URIS)
    assert {u: got[u] for u in URIS} == {u: expected(u) for u in URIS}


def test_random_uris(spark):
    rng = random.Random(7)
    alphabet = list("ab/?#&=;:+.%") + ["%20", "%3B", "%26", "%2B", "%C3%B1", "%25", "//", "http:"]
    wanted = {}
    while len(wanted) < 1500:
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
        try:
            wanted[text] = expected(text)
        except ValueError:
            continue
    assert computed(spark, list(wanted)) == wanted


def test_null_uri(spark):
    row = spark.createDataFrame([(None,)], "raw string").select(
        uri.decode_uri(F.col("raw")).alias("dec"),
        uri.uri_path(F.col("raw")).alias("path"),
        uri.uri_query_pairs(F.col("raw")).alias("pairs"),
        uri.referer_domain(F.col("raw")).alias("domain"),
    )
    assert tuple(row.first()) == (None, None, [], "Unknown")


def test_referer_domain(spark):
    table = spark.createDataFrame([(r,) for r in REFERERS], "raw string")
    got = {r.raw: r.d for r in table.select("raw", uri.referer_domain(F.col("raw")).alias("d")).collect()}

    def wanted(referer):
        netloc = urllib.parse.urlparse(referer).netloc
        return netloc if netloc not in ("", "-") else "Unknown"

    assert got == {r: wanted(r) for r in REFERERS}


@pytest.mark.parametrize(
    "text, epoch, hour, day",
    [
        ("01/Jan/2024:10:30:00 +0000", 1704105000, 10.5, 2),
        ("07/Jan/2024:23:59:59 +0000", 1704671999, 23 + 59 / 60, 1),
        ("01/Jan/2024:10:30:00 -0600", 1704126600, 16.5, 2),
        ("31/Feb/2024:10:30:00 +0000", None, None, None),
        ("rubbish", None, None, None),
    ],
)
def test_times(spark, text, epoch, hour, day):
    table = spark.createDataFrame([(text,)], "t string")
    stamp = table.withColumn("ts", times.log_timestamp(F.col("t")))
    row = stamp.select(
        times.epoch_seconds(F.col("ts")),
        times.fractional_hour(F.col("ts")),
        times.day_of_week(F.col("ts")),
    ).first()
    assert tuple(row) == (epoch, hour, day)
