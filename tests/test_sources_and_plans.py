import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textmill.functions import ratelimit
from textmill.operators.store import Store
from textmill.plans import catalogue, pipelines
from textmill.sources import embedders, fetch
from textmill.sources.config import Config, load_yaml, template
from textmill.streaming.ingest import ingest_stream, page_stream


def test_config():
    assert Config(seed_url="https://h/").validate().workers == 10
    with pytest.raises(ValueError) as e:
        Config(workers=0, rate_limit=-1, embedder="x").validate()
    assert len(str(e.value).splitlines()) == 4
    cfg = load_yaml("source:\n  url: https://h/\ncrawl:\n  max_depth: 3\n  workers: 0\n  timeout: 5s\n  include: ['/a/*']\n", rate_limit=2.0)
    assert (cfg.seed_url, cfg.max_depth, cfg.workers, cfg.timeout_s, cfg.includes, cfg.rate_limit) == ("https://h/", 3, 10, 5.0, ("/a/*",), 2.0)
    text = "source:\n  url: https://h/\ncrawl:\n  includes: ['/a/*']\n  excludes: ['/b']\n  timeout_sec: 7\n  resume: true\nembedding:\n  embedder: tfidf\n  model: m\n  batch: 9\noutput:\n  dir: ./o\n  verbose: true\n"
    cfg2 = load_yaml(text)
    assert (cfg2.includes, cfg2.excludes, cfg2.timeout_s, cfg2.resume, cfg2.embedder, cfg2.embedding_model, cfg2.embedding_batch, cfg2.output_dir, cfg2.verbose) == (("/a/*",), ("/b",), 7.0, True, "tfidf", "m", 9, "./o", True)
    with pytest.warns(UserWarning):
        assert load_yaml("ingest:\n  x: 1\ncrawl:\n  y: 2\n") == Config()
    assert "dir: ./docs-example-com-docs" in template("https://www.docs.example.com/")
    assert load_yaml(template("https://h/")).max_depth == 3
    assert cfg.with_(workers=4).workers == 4


def test_retries():
    answers, waits = iter([(429, {}, b""), (503, {}, b""), (200, {}, b"ok")]), []
    assert fetch.with_retries(lambda u: next(answers), "u", waits.append)[2] == b"ok"
    assert waits == [0.5, 1.0] == [ratelimit.backoff_s(1), ratelimit.backoff_s(2)]
    with pytest.raises(ValueError):
        fetch.with_retries(lambda u: (500, {}, b""), "u", waits.append)
    assert fetch.with_retries(lambda u: (404, {}, b"gone"), "u")[0] == 404
    with pytest.raises(ValueError):
        fetch.with_retries(lambda u: (200, {}, b"x" * (fetch.MAX_BODY + 1)), "u")


def test_http_fetcher(spark):
    def get(url):
        return (200, {"content-type": ["text/html"]}, url.encode()) if "good" in url else (500, {}, b"")

    rows = spark.createDataFrame([("http://good/", 0), ("http://bad/", 1)], "url string, depth int")
    got = {r["url"]: r for r in fetch.HttpFetcher(1e6, get=get, workers=1).fetch(rows).collect()}
    assert bytes(got["http://good/"]["body"]) == b"http://good/" and got["http://good/"]["content_type"] == "text/html"
    assert got["http://bad/"]["status"] is None and "500" in got["http://bad/"]["error"]
    assert fetch.route([fetch.HttpFetcher()], "http://x").name == "http"
    with pytest.raises(ValueError):
        fetch.route([fetch.HttpFetcher()], "ftp://x")


def test_table_fetcher(spark):
    pages = spark.createDataFrame([("https://h/a", "<p>x")], "url string, html string")
    asked = spark.createDataFrame([("https://H/a/", 0), ("https://h/b", 0)], "url string, depth int")
    assert {r["url"]: r["status"] for r in fetch.TableFetcher(pages).fetch(asked).collect()} == {"https://H/a/": 200, "https://h/b": 404}


def test_embedders(spark):
    sizes = []

    def post(url, body, headers):
        texts = body.get("input") or body.get("texts")
        sizes.append(len(texts))
        v = [[float(len(t))] for t in texts]
        if "/v1/" in url:
            return {"data": [{"index": i, "embedding": x} for i, x in reversed(list(enumerate(v)))]}
        return {"embeddings": {"float": v} if "/v2/" in url else v}

    for name in ("ollama", "openai", "cohere"):
        s = embedders.Service(name, "http://h", "m", "k", 2, post)
        assert s.embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    assert sizes == [2, 1] * 3
    assert embedders.create("auto", env={}, alive=lambda u: False).name == "tfidf"
    assert embedders.create("auto", env={"COHERE_API_KEY": "k"}, alive=lambda u: False).name == "cohere"
    assert embedders.create("auto", env={}, alive=lambda u: True).name == "ollama"
    with pytest.raises(ValueError):
        embedders.create("openai", env={})


SITE = {
    "https://h.example/": '<title>Home</title><body><h1>Home</h1><p>welcome<a href="/start">s</a><a href="/api/auth">a</a><a href="https://o.example/">o</a></body>',
    "https://h.example/start": "<title>Start</title><body><h1>Start</h1><p>install the tool</body>",
    "https://h.example/api/auth": "<title>Auth</title><body><h2>Tokens</h2><p>use a token</body>",
    "https://h.example/start2": "<title>Start</title><body><h1>Start</h1><p>install the tool</body>",
}


def test_ingest_and_crawl(spark, tmp_path):
    pages = spark.createDataFrame(list(SITE.items()), "url string, body string")
    cfg = Config(seed_url="https://h.example/", embedder="tfidf").validate()
    store = pipelines.ingest(spark, cfg, pages, Store(spark, str(tmp_path / "s")))
    assert {r["source_url"] for r in store.table("chunks").collect()} == set(list(SITE)[:3])
    assert [r["source_url"] for r in store.search("token").collect()] == ["https://h.example/api/auth"]
    assert store.table("embeddings").count() == store.table("chunks").count()
    files = {r["path"]: r["meta"] for r in pipelines.crawl(spark, cfg, pages).collect()}
    assert set(files) == {"index", "start", "api/auth"} and '"title" : "Auth"' in files["api/auth"]
    scoped = pipelines.documents(spark, cfg.with_(includes=("/api/*",)), pages)
    assert {r["url"] for r in scoped.collect()} == {"https://h.example/", "https://h.example/api/auth"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, u, h) for i, (u, h) in enumerate(SITE.items())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for part in (pages.filter("page_id < 2"), pages.filter("page_id >= 1")):  # one page comes twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):  # a second run finds nothing new
        ingest_stream(page_stream(spark, str(tmp_path / "in"), 1), store, str(tmp_path / "cp")).awaitTermination()
    from textmill.operators import chunking, extract

    batch = chunking.heading_chunks(extract.extract(pages.select("url", F.col("html").alias("body"))))
    assert {r["id"] for r in store.table("chunks").collect()} == {r["id"] for r in batch.collect()}


def test_every_query_has_a_schema(spark):
    known = __spark_entry__.queries()
    assert set(catalogue.QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).columns == ["id", "score", "rank"]
