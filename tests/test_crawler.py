"""A crawl of a small site served here, through the commands."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from textmill.__main__ import main, parser, settings
from textmill.functions import ratelimit
from textmill.operators import export, extract
from textmill.operators.store import Store
from textmill.plans import crawler, protocols
from textmill.sources import embedders, fetch, sinks
from textmill.sources.config import Config

PAGES = {
    "/robots.txt": "User-agent: *\nDisallow: /hidden\n",
    "/": '<title>Home</title><main><h1>Harbour</h1><p>Ships come in. <a href="/tide">t</a> <a href="/hidden/x">h</a> <a href="/gone">g</a> <a href="/busy">b</a></main>',
    "/tide": '<title>Tide</title><main><h2>Tables</h2><p>High water at noon. <a href="/deep#x">d</a></main>',
    "/deep": "<title>Deep</title><main><h2>Depths</h2><p>Soundings in fathoms.</main>",
    "/copy": "<title>Deep</title><main><h2>Depths</h2><p>Soundings in fathoms.</main>",
    "/hidden/x": "<title>no</title>secret",
    "/busy": "<title>Busy</title><main><p>Back again.</main>",
}


@pytest.fixture
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            pages = PAGES | {"/sitemap.xml": f"<urlset><url><loc>{base}/copy</loc></url></urlset>"}
            status = 503 if self.path == "/busy" and asked.count("/busy") < 2 else 200 if self.path in pages else 500 if self.path == "/gone" else 404
            body = pages.get(self.path, "").encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    base = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield base, asked
    server.shutdown()


def test_crawl_writes_pages_and_resumes(spark, site, tmp_path):
    base, asked = site
    out = io.StringIO()
    folder = tmp_path / "out"
    assert main(["crawl", f"{base}/", "-o", str(folder), "--rate-limit", "200", "--workers", "4"], spark, out) == 0
    names = {str(p.relative_to(folder / "pages")) for p in (folder / "pages").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert names == {f"{n}{end}" for n in ("index", "tide", "busy", "copy") for end in (".md", ".meta.json")}  # /deep repeats /copy, which has less depth
    assert "High water" in (folder / "pages/tide.md").read_text()
    assert json.loads((folder / "pages/tide.meta.json").read_text())["title"] == "Tide"
    summary = json.loads((folder / "manifest.json").read_text())
    assert summary["errors"] == 1 and summary["seed_url"] == f"{base}/"
    assert not any(p.startswith("/hidden") for p in asked) and asked.count("/busy") == 2 and asked.count("/gone") == 3
    # a crawl that lost its last levels goes on from there
    levels = sorted((folder / "state").glob("level=*"))
    (levels[-2] / "_SUCCESS").unlink()
    (levels[-1] / "_SUCCESS").unlink()
    before = len(asked)
    job = crawler.Crawl(Config(f"{base}/", str(folder), rate_limit=200.0, workers=4, resume=True))
    pages = job.run(spark)
    assert {r["norm_url"].removeprefix(base): r["depth"] for r in pages.collect()} == {"/": 0, "/copy": 0, "/tide": 1, "/gone": 1, "/busy": 1, "/deep": 2}
    assert "/" not in asked[before:] and "/tide" not in asked[before:] and "/deep" in asked[before:]


def test_ingest_search_export_discover(spark, site, tmp_path, capsys):
    base, _ = site
    folder, out = str(tmp_path / "kb"), io.StringIO()
    (tmp_path / "c.yaml").write_text(f"source:\n  url: {base}/\ncrawl:\n  rate_limit: 200\n  excludes: ['/busy', '/gone']\nembedding:\n  embedder: tfidf\noutput:\n  dir: {folder}\n")
    assert main(["ingest", "--config", str(tmp_path / "c.yaml")], spark, out) == 0
    assert out.getvalue() == f"3 chunks in {folder}/index\n"
    out = io.StringIO()
    main(["search", "soundings", "--source", folder, "--format", "json"], spark, out)
    found = json.loads(out.getvalue())
    assert [(r["rank"], r["url"], r["heading_path"]) for r in found] == [(1, f"{base}/copy", ["Depths"])]
    out = io.StringIO()
    main(["search", "noon", "--source", folder], spark, out)
    assert out.getvalue().startswith("1. [") and "Tables" in out.getvalue()
    out = io.StringIO()
    main(["search", "nothing", "--source", folder], spark, out)
    assert not out.getvalue() and "No results" in capsys.readouterr().err
    out = io.StringIO()
    main(["export", "--source", folder, "--include-vectors"], spark, out)
    rows = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["source_url"] for r in rows] == sorted(f"{base}{p}" for p in ("/", "/copy", "/tide")) and all(r["vector"] for r in rows)
    out = io.StringIO()
    main(["export", "--source", folder, "--format", "csv"], spark, out)
    assert out.getvalue().splitlines()[0] == ",".join(export.CSV_COLUMNS)
    (tmp_path / "md").mkdir()
    main(["export", "--source", folder, "--format", "markdown", "-o", str(tmp_path / "md")], spark, out)
    assert len([p for p in (tmp_path / "md").iterdir() if p.suffix == ".md"]) == 3
    out = io.StringIO()
    main(["discover", f"{base}/"], spark, out)
    assert out.getvalue() == f"{base}/copy\n\nTotal URLs found: 1\n"


def test_init_and_settings(tmp_path):
    at, out = str(tmp_path / "x.yaml"), io.StringIO()
    assert main(["init", "https://wiki.harbour.test/", "-o", at], out=out) == 0 and main(["init", "https://wiki.harbour.test/", "-o", at], out=out) == 1
    assert main(["init", "https://www.harbour.test/"], out=out) == 0 and "dir: ./harbour-test-docs" in out.getvalue() and main(["init", "harbour"], out=out) == 1
    cfg = settings(parser().parse_args(["ingest", "--config", at, "--max-depth", "7", "--include", "/a/*,/b/*", "--include", "/c"]))
    assert (cfg.seed_url, cfg.max_depth, cfg.includes, cfg.excludes) == ("https://wiki.harbour.test/", 7, ("/a/*", "/b/*", "/c"), ("**/changelog/**",))
    assert main(["crawl", ""]) == 1


def test_pace():
    now, waits = [100.0], []

    def wait(s):
        waits.append(round(s, 3))
        now[0] += s

    pace = fetch.Pace(clock=lambda: now[0], wait=wait)
    for _ in range(3):
        pace.turn()
    assert waits == [0.2, 0.2]  # the default rate
    pace.heard(200, {"X-RateLimit-Limit": ["2"], "X-RateLimit-Remaining": ["1"]})
    pace.turn()
    pace.turn()
    assert waits[-1] == 0.5
    pace.heard(429, {"Retry-After": ["30"]})
    pace.turn()
    assert waits[-1] == 30
    assert fetch.Pace(explicit=4, crawl_delay_s=9).rate() == 4 and fetch.Pace(crawl_delay_s=2).rate() == 0.5


@pytest.mark.parametrize("headers", [
    {}, {"X-RateLimit-Limit": ["72"], "X-RateLimit-Remaining": ["31"], "X-RateLimit-Reset": ["10"]}, {"RateLimit-Limit": ["18"]}, {"X-RateLimit-Limit": ["72"], "RateLimit-Remaining": ["4"]},
    {"X-RateLimit-Limit": ["72"], "X-RateLimit-Remaining": ["2"], "X-RateLimit-Reset": ["1709596900"]}, {"RateLimit-Limit": ["0"], "RateLimit-Remaining": ["4"]}, {"Retry-After": ["17"]},
    {"Retry-After": ["Tue, 05 Mar 2024 00:01:30 GMT"]}, {"Retry-After": ["later"], "RateLimit-Limit": ["x"]}, {"Retry-After": ["-3"]},
])
def test_rates_agree_with_the_column_form(spark, headers):
    import datetime

    now = datetime.datetime(2024, 3, 5, tzinfo=datetime.UTC)
    df = spark.createDataFrame([(headers, now)], "h map<string,array<string>>, now timestamp").withColumn("i", ratelimit.parse(F.col("h"), F.col("now")))
    r = df.select("i.found", ratelimit.header_rate(F.col("i"), F.col("now")).alias("rate"), "i.retry_after_s").first()
    assert tuple(r) == pytest.approx(fetch.rate_of(headers, now.timestamp()))


def test_a_bad_page_is_a_row(spark, monkeypatch):
    assert extract.document("u", b"<p>x")[-1] is None
    monkeypatch.setattr(extract, "parse", lambda text: 1 / 0)
    row = extract.document("u", b"<p>x")
    assert row[3] == "" and row[-1].startswith("ZeroDivisionError")


def test_parts_fit_their_protocols(spark, tmp_path):
    cfg = Config("https://h/")
    for part, kind in (
        (crawler.SitemapDiscoverer(cfg, fetch.HttpFetcher()), protocols.Discoverer), (fetch.HttpFetcher(), protocols.Fetcher), (crawler.HtmlExtractor(), protocols.Extractor),
        (sinks.MarkdownWriter(str(tmp_path), "https://h/"), protocols.Writer), (crawler.WordChunker(cfg), protocols.Chunker), (embedders.TfIdf(), protocols.Embedder), (Store(spark, str(tmp_path)), protocols.Indexer),
    ):
        assert isinstance(part, kind)
