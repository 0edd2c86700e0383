"""Every query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from textmill.plans import catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert a == b


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def against_sql(spark, name, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.ORACLES[name])
    a = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert a == sorted(map(repr, want.fetchall()))
    return a


def test_pages_that_share_a_url_keep_their_own_links(spark, tmp_path):
    rows = [(1, "http://a.org/x", '<a href="/one">1</a>'), (2, "http://a.org/x", '<a href="/two">2</a>'), (2**60 + 1, "http://b.org/", '<a href="/one">1</a>'), (None, "http://c.org/", '<a href="/one">1</a>')]
    assert len(against_sql(spark, "page_links", tmp_path, rows)) == 4


LOOSE = [(1, "http://a.org/", "<title>a &lt;b&gt; &amp;amp; c&amp;&amp</title><h1>x &amp;lt; &amp;&amp</h1>"), (2, "http://a.org/", "<title>R&D &ampc</title><h2>R&D &quot;&amp</h2><h3>y</h3>")]


def test_headings_keep_references_without_a_semicolon(spark, tmp_path):
    assert len(against_sql(spark, "page_headings", tmp_path, LOOSE)) == 2


def test_titles_keep_references_without_a_semicolon(spark, tmp_path):
    assert len(against_sql(spark, "page_title", tmp_path, LOOSE)) == 2
