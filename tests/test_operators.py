import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import bm25, chunking, dedup, export, extract, frontier, tfidf, vector_search
from textmill.operators.scope import Scope
from textmill.operators.store import Store
from textmill.sources import robots, sitemap


def docs(spark, *markdowns):
    return spark.createDataFrame([(f"https://h/{i}", f"T{i}", m) for i, m in enumerate(markdowns)], "url string, title string, markdown string")


def sections(spark, md, n=500):
    return [r.asDict() for r in chunking.heading_chunks(docs(spark, md), n).orderBy("chunk_index").collect()]


def test_heading_chunks(spark):
    rows = sections(spark, "Only this.\n\nAnd that.")
    assert [(r["heading_path"], r["chunk_index"], r["total_chunks"]) for r in rows] == [([], 0, 1)]
    rows = sections(spark, "## Tides\n\na\n\n## Winds\n\nb")
    assert [r["heading_path"] for r in rows] == [["Tides"], ["Winds"]]
    rows = sections(spark, "## P\n\nx\n\n### A\n\ny\n\n### B\n\nz\n\n## Q\n\nw\n\n### C\nv")
    assert [r["heading_path"] for r in rows] == [["P"], ["P", "A"], ["P", "B"], ["Q"], ["Q", "C"]]
    assert {r["total_chunks"] for r in rows} == {5}
    rows = sections(spark, "## Listing\n\n```\n## no\n### no\n```\n\nend")
    assert [r["heading_path"] for r in rows] == [["Listing"]]
    assert sections(spark, "### Lone\nx")[0]["heading_path"] == ["Lone"]
    assert sections(spark, " \n ") == []


def test_oversize_sections_are_packed(spark):
    part = " ".join(["word"] * 13)
    rows = sections(spark, "## Big\n\n" + "\n\n".join([part] * 20), 50)
    assert len(rows) > 1 and {tuple(r["heading_path"]) for r in rows} == {("Big",)}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(r["token_count"] <= 52 for r in rows)
    assert "\n\n".join(r["content"] for r in rows) == "## Big\n\n" + "\n\n".join([part] * 20)


def reference_sections(md):
    """A plain reading of the sectioning rules."""
    out, open_, inside, last = [], None, False, ""
    for line in md.split("\n"):
        fence = line.strip().startswith("```")
        if fence:
            inside = not inside
        if not fence and not inside and line.startswith("### "):
            open_ = ([last, line[4:]] if last else [line[4:]], [line])
            out.append(open_)
        elif not fence and not inside and line.startswith("## "):
            last = line[3:]
            open_ = ([last], [line])
            out.append(open_)
        elif open_ is not None:
            open_[1].append(line)
        elif not fence and not inside:
            open_ = ([], [line])
            out.append(open_)
    return [(p, "\n".join(x).strip()) for p, x in out if "\n".join(x).strip()]


def test_sections_of_random_markdown(spark):
    rng = random.Random(5)
    lines = ["## A", "## B", "### c", "### d", "```", "  ```x", "text", "", "#### deep", "## ", "# top"]
    mds = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    got = {}
    for r in chunking.heading_sections(docs(spark, *mds)).orderBy("source_url", "section").collect():
        got.setdefault(r["source_url"], []).append((r["heading_path"], r["content"]))
    for i, md in enumerate(mds):
        assert got.get(f"https://h/{i}", []) == reference_sections(md), md


@pytest.mark.parametrize(("n", "size", "overlap", "count"), [(300, 100, 20, 5), (200, 50, 0, 6), (393, 512, 50, 2), (0, 512, 50, 0), (1, 1, 1, 1)])
def test_fixed_chunks(spark, n, size, overlap, count):
    rows = chunking.fixed_chunks(docs(spark, " ".join(f"w{i}" for i in range(n))), size, overlap).orderBy("chunk_index").collect()
    assert len(rows) == count and all(r["heading_path"] is None and r["total_chunks"] == count for r in rows)
    assert {w for r in rows for w in r["content"].split()} == {f"w{i}" for i in range(n)}


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, "x"), "sentence")


PREFIX = "https://docs.example.com"


@pytest.mark.parametrize(
    ("scope", "url", "depth", "ok"),
    [
        (Scope(max_depth=3), f"{PREFIX}/a", 3, True), (Scope(max_depth=3), f"{PREFIX}/a", 4, False), (Scope(), f"{PREFIX}/a", 99, True),
        (Scope("https://DOCS.Example.COM"), f"{PREFIX}/page", 0, True), (Scope(PREFIX + "/docs"), f"{PREFIX}/docs-old", 0, True),
        (Scope(PREFIX + ":8080", same_domain=True), f"{PREFIX}/a", 0, False), (Scope(PREFIX, same_domain=True), "https://other.com/a", 0, False),
        (Scope(includes=("/api/*",)), f"{PREFIX}/api/auth", 0, True), (Scope(includes=("/api/*",)), f"{PREFIX}/blog", 0, False),
        (Scope(includes=("/api/*",), excludes=("/api/internal",)), f"{PREFIX}/api/internal", 0, False), (Scope(includes=("[",)), f"{PREFIX}/x", 0, False),
    ],
)
def test_scope(spark, scope, url, depth, ok):
    df = spark.createDataFrame([(url, depth)], "u string, d int")
    assert df.select(scope.allows(F.col("u"), F.col("d"))).first()[0] is ok


ROBOTS = "User-agent: testbot\nDisallow: /private/\nDisallow: /admin/\nAllow: /public/\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /secret/\n"


@pytest.mark.parametrize(
    ("text", "agent", "path", "ok"),
    [(ROBOTS, "testbot", "/private/data", False), (ROBOTS, "testbot", "/docs/guide", True), (ROBOTS, "testbot", "/secret/x", True), (ROBOTS, "otherbot", "/secret/file", False), (ROBOTS, "otherbot", "/public/page", True), ("", "x", "/a", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "x", "/a/b/c", True), ("User-agent: *\nDisallow: /*.pdf$", "x", "/d/e.pdf", False)],
)
def test_robots(spark, text, agent, path, ok):
    df = spark.createDataFrame([(PREFIX + path,)], "u string")
    assert df.select(robots.parse(text, agent).allows(F.col("u"))).first()[0] is ok


def test_robots_responses():
    assert robots.parse(ROBOTS, "testbot").crawl_delay_s == 2
    assert robots.from_response(404, ROBOTS, "testbot").rules == ()


def test_sitemap(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = [
        (200, f"<urlset {ns}><url><loc>{PREFIX}/a</loc></url><url><loc>{PREFIX}/b?x=1&amp;y=2</loc></url><url><loc>{PREFIX}/blog/c</loc></url></urlset>"),
        (200, f"<sitemapindex {ns}><sitemap><loc>{PREFIX}/s1.xml</loc></sitemap></sitemapindex>"),
        (404, f"<urlset><url><loc>{PREFIX}/no</loc></url></urlset>"), (200, f"<urlset><url><loc>{PREFIX}/broken</loc>"), (200, None),
    ]
    df = spark.createDataFrame(bodies, "status int, body string")
    assert sorted(r["url"] for r in sitemap.discover(df, Scope(excludes=("/blog/*",))).collect()) == [f"{PREFIX}/a", f"{PREFIX}/b?x=1&y=2", f"{PREFIX}/s1.xml"]
    assert sitemap.sitemap_url(PREFIX + "/deep/page") == PREFIX + "/sitemap.xml"


PAGE = """<html><head><title> Guide </title><meta name="description" content=" About "><script>var a="</p><h1>no</h1>";</script></head>
<body><nav><h6>Nav</h6><a href="/x#f">X</a></nav><main><h1>Top</h1><p>One <b>bold</b> word.<ul><li>i1<li>i2</ul><pre>code  here</pre></main>
<footer><a href="mailto:a@b">m</a><a href="#top">t</a><a href=" y ">Y</a><a href="/x">X2</a><a href="javascript:void(0)">j</a></footer></body></html>"""


def test_extract(spark):
    df = spark.createDataFrame([("https://h/d/p", PAGE), ("https://h/e", "<h1>Only</h1>"), ("https://h/n", None)], "url string, body string")
    got = {r["url"]: r for r in extract.extract(df).collect()}
    r = got["https://h/d/p"]
    assert (r["title"], r["description"]) == ("Guide", "About")
    assert [(h["level"], h["text"]) for h in r["headings"]] == [(6, "Nav"), (1, "Top")]
    assert r["links"] == ["https://h/x", "https://h/d/y"]
    assert "# Top" in r["markdown"] and "**bold**" in r["markdown"] and "- i1\n- i2" in r["markdown"] and "code  here" in r["markdown"] and "Nav" not in r["markdown"]
    assert r["word_count"] == len(r["markdown"].split())
    assert got["https://h/e"]["title"] == "Only"
    assert (got["https://h/n"]["markdown"], got["https://h/n"]["word_count"]) == ("", 0)
    picked = {r["url"]: r["markdown"] for r in extract.extract(df, "footer").collect()}
    assert "One" not in picked["https://h/d/p"] and "Only" in picked["https://h/e"]


def test_tfidf(spark):
    rows = [("d", "a", "hello world foo bar", 0), ("e", "b", "x x y", 0), ("e", "c", "y z", 1), ("e", "n", "", 2)]
    c = spark.createDataFrame(rows, "source_url string, id string, content string, chunk_index int")
    w = {(r["chunk_id"], r["term"]): r["weight"] for r in tfidf.sparse(c).collect()}
    assert all(w["a", t] == pytest.approx(0.5) for t in "hello world foo bar".split())
    assert w["b", "x"] ** 2 + w["b", "y"] ** 2 == pytest.approx(1)
    d = {r["chunk_id"]: r["vector"] for r in tfidf.dense(c).collect()}
    assert d["b"][0] == pytest.approx(w["b", "x"], abs=1e-6) and d["c"][0] == 0 and d["n"] == [0, 0, 0] and len(d["a"]) == 4


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, title string, source_url string, heading_path array<string>")


def test_search_grammar(spark):
    c = chunk_table(spark, [("1", "A warm red kettle whistles", "A", "u", None), ("2", "Cold lamp hums quietly", "kettle", "u", ["Kettle"]), ("3", "warm lamp café", "B", "u", [])])
    hits = lambda q: {r["id"] for r in bm25.search(c, q).collect()}
    assert hits("warm") == {"1", "3"} and hits("warm kettle") == {"1"} and hits("kettle OR lamp") == {"1", "2", "3"} and hits("warm NOT kettle") == {"3"}
    assert hits('"warm red"') == {"1"} and hits('"red warm"') == set() and hits("quiet*") == {"2"} and hits("title:kettle") == {"2"}
    assert hits("heading_path:kettle") == {"2"} and hits("cafe") == {"3"} and hits("(warm OR cold) lamp") == {"2", "3"}
    assert [r["rank"] for r in bm25.search(c, "kettle OR lamp", 2).orderBy("rank").collect()] == [1, 2]
    for bad in ("", "what is it?", "won't", "url:x", "(a", "a OR"):
        with pytest.raises(ValueError):
            bm25.search(c, bad)


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [0.9, 0.1, 0.0, 0.0]), ("b", [0.0, 0.0, 0.9, 0.1]), ("c", [1.0])], "chunk_id string, vector array<float>")
    q = [0.95, 0.05, 0.0, 0.0]
    assert [r["chunk_id"] for r in vector_search.search(v, q, 9).orderBy("rank").collect()][0] == "a"
    assert vector_search.search(v.limit(0), q).count() == 0
    many = vector_search.search_many(v, [("q", q), ("r", q[::-1])], 1, block=1).collect()
    assert {r["query"]: r["chunk_id"] for r in many} == {"q": "a", "r": "b"}


def test_first_by(spark):
    f = spark.createDataFrame([("u1", "n", 2, "link"), ("u2", "n", 1, "link"), ("u3", "n", 1, "sitemap"), ("u4", "m", 0, "seed")], "url string, norm_url string, depth int, source string")
    assert sorted(r["url"] for r in dedup.distinct_urls(f).collect()) == ["u3", "u4"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.search("x").count() == 0
    c = chunking.fixed_chunks(docs(spark, "alpha beta", "gamma delta"))
    s.index(c, tfidf.dense(c))
    s.index(c.filter("source_url = 'https://h/0'").withColumn("title", F.lit("new")))
    assert {(r["source_url"], r["title"]) for r in s.table("chunks").collect()} == {("https://h/0", "new"), ("https://h/1", "T1")}
    assert s.table("embeddings").count() == 1
    assert [r["source_url"] for r in s.search("delta").collect()] == ["https://h/1"]
    assert len(s.vector(c.filter("source_url = 'https://h/1'").first()["id"])) == 2
    with pytest.raises(KeyError):
        s.vector("none")
    s.delete_source("https://h/1")
    assert s.table("chunks").count() == 1 and s.search("delta").count() == 0
    s.set_meta("k", "1")
    s.set_meta("k", "2")
    assert s.meta("k") == "2" and s.meta("z") is None
    assert s.with_vectors().filter("vector is null").count() == 1


def same_search(store, query):
    """A search of the store, and one of its chunks without stored postings."""
    rows = lambda d: [(r["rank"], r["id"], round(r["score"], 9)) for r in d.orderBy("rank").collect()]
    return rows(store.search(query)) == rows(bm25.search(store.table("chunks"), query))


def test_store_after_many_writes(spark, tmp_path):
    """Random upserts, prunes and deletes against a dictionary; one compaction falls among them."""
    rng = random.Random(7)
    store, model = Store(spark, str(tmp_path / "s"), compact_at=3), {}
    names = ["id", "content", "source_url", "title", "heading_path", "chunk_index", "total_chunks", "token_count", "content_hash"]
    for step in range(7):
        if step in (3, 6):
            gone = rng.sample(["u0", "u1", None], 2)
            store.delete_sources(spark.createDataFrame([(g,) for g in gone], "source_url string"))
            model = {k: v for k, v in model.items() if v[0] not in gone}
        else:
            prune, urls = rng.random() < 0.5, rng.sample(["u0", "u1", "u2", None], 2)
            rows = {f"{u}-{k}": (u, " ".join(rng.choice(["ant", "bee", "cow"]) for _ in range(4))) for u in urls for k in rng.sample(range(4), 2)}
            df = spark.createDataFrame([(k, text, u, f"t{step}", None, 0, 1, 4, "h") for k, (u, text) in rows.items()], "id string, content string, source_url string, title string, heading_path array<string>, chunk_index int, total_chunks int, token_count int, content_hash string")
            store.index(df.select(*names), prune=prune)
            model = {k: v for k, v in model.items() if not (prune and v[0] is not None and v[0] in urls)} | rows
        assert {r["id"]: (r["source_url"], r["content"]) for r in store.table("chunks").collect()} == model
        m = store.manifest()
        assert m["chunks"] == len(model) and len(m["segments"]) < 3
        assert same_search(store, "ant bee") and same_search(store, '"bee cow" OR ant')


def test_store_survives_a_torn_manifest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.index(chunking.fixed_chunks(docs(spark, "one")))
    old = s.manifest()
    (tmp_path / "s" / "manifests" / f"{old['next']:020d}.json").write_text('{"segments": [')  # a crash in the middle of the write
    assert s.table("chunks").count() == 1
    with pytest.raises(Exception, match="already exists|exist"):  # who began before it can't take its number
        s._commit(old)
    s.index(chunking.fixed_chunks(docs(spark, "one", "two")))
    assert s.table("chunks").count() == 2
    s.compact()
    assert s.vacuum(1) > 0 and s.table("chunks").count() == 2 and same_search(s, "two")


def test_documents_of_one_url_are_kept_apart(spark):
    d = docs(spark, "## A\none", "## B\ntwo", "## A\none").withColumn("url", F.lit("https://h/")).withColumn("title", F.lit("t"))
    rows = chunking.heading_chunks(d).orderBy("chunk_index").collect()
    assert sorted(r["content"] for r in rows) == ["## A\none", "## B\ntwo"] and [r["chunk_index"] for r in rows] == [0, 1]


def test_export(spark, tmp_path):
    c = chunking.heading_chunks(docs(spark, '## Intro\n\nsaid "hi", ok')).withColumn("vector", F.array(F.lit(0.5).cast("float")))
    import json

    line = json.loads(export.jsonl_rows(c).first()["line"])
    assert "vector" not in line and line["heading_path"] == ["Intro"]
    assert json.loads(export.jsonl_rows(c, True).first()["line"])["vector"] == [0.5]
    for form in export.FORMATS:
        export.export(c, str(tmp_path / form), form, True)
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).first()["content"] == c.first()["content"]
    md = "".join(p.read_text() for p in sorted((tmp_path / "markdown").glob("part-*")))
    assert md == '# Intro\n\n**Source:** https://h/0\n\n## Intro\n\nsaid "hi", ok\n\n---\n\n'
    with pytest.raises(ValueError):
        export.export(c, str(tmp_path / "x"), "docx")
    clash = docs(spark, "a", "b").withColumn("source_url", F.when(F.col("title") == "T0", "https://h/a_b").otherwise("https://h/a/b")).select("source_url", F.lit(0).alias("chunk_index"), "title", F.lit(None).cast("array<string>").alias("heading_path"), F.col("markdown").alias("content"))
    assert len({r["name"] for r in export.markdown_files(clash).collect()}) == 2


def test_frontier(spark):
    edges = spark.createDataFrame([("https://h/", "https://h/a"), ("https://h/", "https://h/a/#x"), ("https://h/a", "https://h/b"), ("https://h/b", "https://h/"), ("https://h/b", "https://o/z"), ("https://h/b", "https://h/c")], "src string, dst string")
    got = frontier.traverse(frontier.seeds(spark, "https://h"), edges, Scope("https://h", max_depth=2, same_domain=True))
    assert {r["norm_url"]: r["depth"] for r in got.collect()} == {"https://h/": 0, "https://h/a": 1, "https://h/b": 2}
