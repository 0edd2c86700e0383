import datetime

import pytest
from pyspark.sql import functions as F

from textmill.functions import ratelimit, text, urls, vectors


def one(spark, column, **values):
    """The value of a column expression over one row of these values."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "https://WIKI.Harbour.TEST/Boats": "https://wiki.harbour.test/Boats",
        "https://wiki.harbour.test/tide#noon": "https://wiki.harbour.test/tide",
        "https://wiki.harbour.test/tide//": "https://wiki.harbour.test/tide",
        "http://wiki.harbour.test/find?ship=9&berth=4": "http://wiki.harbour.test/find?berth=4&ship=9",
        "https://wiki.harbour.test": "https://wiki.harbour.test/",
        "FTP://wiki.harbour.test/": "ftp://wiki.harbour.test/",
        "HTTPS://Wiki.HARBOUR.test/Log/Day/?w=3&k=1#end": "https://wiki.harbour.test/Log/Day?k=1&w=3",
        "https://wiki.harbour.test/log?": "https://wiki.harbour.test/log",
        "https://wiki.harbour.test/log?k=7&k=5": "https://wiki.harbour.test/log?k=5&k=7",
        "https://me:secret@wiki.harbour.test:9000/x%20y//?q=m+n&r": "https://wiki.harbour.test:9000/x%20y?q=m+n&r=",
        "https://h/t?k-z=1&k=2": "https://h/t?k=2&k-z=1",
        "https://h/t+u": "https://h/t+u",
        "no link at all": None,
    }
    assert many(spark, urls.normalize_url, cases) == list(cases.values())


def test_url_to_filepath(spark):
    base = "https://wiki.harbour.test"
    cases = {f"{base}/boats/rig": "boats/rig", f"{base}/": "index", base: "index", f"{base}/boats/": "boats/index", f"{base}/k/l/m": "k/l/m", f"{base}/k/./l/../m?q=1": "k/m"}
    assert many(spark, lambda c: urls.url_to_filepath(base, c), cases) == list(cases.values())
    assert many(spark, lambda c: urls.url_to_filepath("https://harbour.test/log", c), ["https://harbour.test/log/week/one"]) == ["week/one"]
    with pytest.raises(ValueError):
        urls.url_to_filepath("://nothing", F.lit("x"))


def test_url_to_filename(spark):
    assert many(spark, urls.url_to_filename, ["https://a.b/c?d=1", "http://x/", "https://"]) == ["a_b_c_d_1", "x", "doc"]


def test_resolve_url(spark):
    df = spark.createDataFrame([("https://h/a/b", x) for x in ("c", "../d#f", "/e", "//o/p", "?q=1", "mailto:x@y", None)], "b string, r string")
    assert [r[0] for r in df.select(urls.resolve_url(F.col("b"), F.col("r"))).collect()] == ["https://h/a/c", "https://h/d", "https://h/e", "https://o/p", "https://h/a/b?q=1", None, None]


@pytest.mark.parametrize(
    ("glob", "path", "ok"),
    [("/api/*", "/api/auth", True), ("/api/*", "/api/a/b", False), ("/a?c", "/abc", True), ("/a?c", "/a/c", False), ("/[a-c]x", "/bx", True), ("/[^a-c]x", "/bx", False), (r"/\*", "/*", True), ("/a.b", "/axb", False)],
)
def test_glob(glob, path, ok):
    import re

    assert bool(re.search(urls.glob_to_regex(glob), path)) is ok


def test_malformed_globs():
    assert [urls.glob_to_regex(g) for g in ("[a", "[]", "a\\", "[a-]")] == [None] * 4


def test_tokens(spark):
    cases = {"": 0, "tide": 2, "high tide": 3, "one two three four five six seven eight nine": 12, "w " * 100: 130, " \n\t ": 0, "  high   tide  ": 3}
    assert many(spark, text.estimate_tokens, cases) == list(cases.values())
    assert many(spark, text.estimate_tokens, [None]) == [0]
    assert (text.words_for_tokens(512), text.words_for_tokens(50)) == (393, 38)
    assert one(spark, text.ascii_tokens(F.lit("Café ÀB-12"))) == ["caf", "b", "12"]
    assert one(spark, text.index_tokens(F.lit("Café ÀB-12 straße"))) == ["cafe", "ab", "12", "straße"]


def test_chunk_id(spark):
    assert one(spark, text.chunk_id(F.lit("https://wiki.harbour.test/log"), F.array(F.lit("A"), F.lit("B")), F.lit(0))) == "2d103d721bea66bc"


def test_snippet(spark):
    assert many(spark, text.snippet, ["é" * 200, "é" * 201]) == ["é" * 200, "é" * 200 + "…"]


def test_vectors(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(a(1, 0), a(1, 1, 1))) == 0
    assert one(spark, vectors.cosine(a(0, 0), a(1, 1))) == 0
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), a(1))) == 0
    assert one(spark, vectors.l2_normalize(a(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(a(0, 0))) == [0, 0]
    assert vectors.from_bytes(vectors.to_bytes([0.5, -2.0])) == [0.5, -2.0]


NOW = datetime.datetime(2024, 3, 5, tzinfo=datetime.UTC)


@pytest.mark.parametrize(
    ("headers", "found", "limit", "remaining", "retry"),
    [
        ({}, False, None, None, 0),
        ({"X-RateLimit-Limit": ["72"], "X-RateLimit-Remaining": ["31"]}, True, 72, 31, 0),
        ({"RateLimit-Limit": ["18"]}, True, 18, None, 0),
        ({"X-RateLimit-Limit": ["72"], "RateLimit-Remaining": ["4"]}, True, 72, None, 0),
        ({"Retry-After": ["17"]}, True, None, None, 17),
        ({"Retry-After": ["Tue, 05 Mar 2024 00:01:30 GMT"]}, True, None, None, 90),
        ({"Retry-After": ["Mon, 04 Mar 2024 00:01:00 GMT"]}, True, None, None, 0),
        ({"Retry-After": ["later"]}, True, None, None, 0),
    ],
)
def test_rate_headers(spark, headers, found, limit, remaining, retry):
    df = spark.createDataFrame([(headers, NOW)], "h map<string,array<string>>, now timestamp")
    r = df.select(ratelimit.parse(F.col("h"), F.col("now")).alias("i")).first()["i"]
    assert (r["found"], r["limit"], r["remaining"], r["retry_after_s"]) == (found, limit, remaining, retry)


@pytest.mark.parametrize(
    ("limit", "remaining", "reset", "rate"),
    [(80, 48, 12, 4.0), (80, 6, 12, 0.25), (12, 12, None, 12.0), (0, 6, 12, 0.0), (12, 0, 900, 0.1), (12, 6, 1709596900, 0.1)],
)
def test_header_rate(spark, limit, remaining, reset, rate):
    h = {"X-RateLimit-Limit": [str(limit)], "X-RateLimit-Remaining": [str(remaining)]} | ({"X-RateLimit-Reset": [str(reset)]} if reset else {})
    df = spark.createDataFrame([(h, NOW)], "h map<string,array<string>>, now timestamp")
    assert df.select(ratelimit.header_rate(ratelimit.parse(F.col("h"), F.col("now")), F.col("now"))).first()[0] == pytest.approx(rate)


@pytest.mark.parametrize(("explicit", "header", "delay", "default", "rate"), [(9.0, 6.0, 1.0, 3.0, 9.0), (None, 6.0, 1.0, 3.0, 6.0), (None, 0.0, 0.25, 8.0, 4.0), (None, None, None, 8.0, 8.0), (None, None, None, None, 5.0)])
def test_resolve_rate(spark, explicit, header, delay, default, rate):
    c = [F.lit(x).cast("double") for x in (explicit, header, delay, default)]
    assert one(spark, ratelimit.resolve_rate(*c)) == rate
