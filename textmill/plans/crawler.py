"""A live crawl: level by level, each level fetched, written and mined for links; a crawl that stopped goes on from its last level.

State is a folder of Parquet tables, one of fetched pages for each level. A level counts once its writer has marked it
complete, so a crash repeats at most one level. URLs seen so far are those tables' own keys, so nothing is kept on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.urls import normalize_url
from textmill.operators import chunking, export, extract, frontier
from textmill.operators.dedup import distinct_urls
from textmill.operators.store import Store
from textmill.sources import embedders, fetch, robots, sitemap, sinks
from textmill.sources.config import Config

from . import pipelines, protocols

PAGES = f"{fetch.FETCHED}, norm_url string, source string"


@dataclass
class HtmlExtractor:
    selector: str | None = None
    name: str = "html"

    def extract(self, fetched: DataFrame) -> DataFrame:
        return extract.extract(fetched, self.selector)


@dataclass
class WordChunker:
    """Any of the chunk strategies."""

    cfg: Config
    name: str = "chunker"

    def chunk(self, documents: DataFrame) -> DataFrame:
        return chunking.chunk(documents, self.cfg.chunk_strategy, self.cfg.max_tokens, self.cfg.overlap_tokens)


@dataclass
class SitemapDiscoverer:
    """URLs of the seed's sitemap; none if it can't be fetched."""

    cfg: Config
    fetcher: protocols.Fetcher
    name: str = "sitemap"

    def discover(self, spark: SparkSession, seed: str) -> DataFrame:
        got = self.fetcher.fetch(spark.createDataFrame([(sitemap.sitemap_url(seed), 0)], "url string, depth int"))
        return sitemap.discover(got.filter("error is null").select("status", F.col("body").cast("string").alias("body")), pipelines.scope_of(self.cfg))


def read_robots(spark: SparkSession, cfg: Config, fetcher: protocols.Fetcher) -> robots.Robots:
    """Rules for our agent; a robots.txt that can't be fetched restricts nothing."""
    at = sitemap.sitemap_url(cfg.seed_url).replace("/sitemap.xml", "/robots.txt")
    row = fetcher.fetch(spark.createDataFrame([(at, 0)], "url string, depth int")).first()
    if row is None or row["error"] or row["status"] is None:
        return robots.Robots()
    return robots.from_response(row["status"], bytes(row["body"] or b"").decode("utf-8", "replace"), cfg.user_agent)


@dataclass
class Crawl:
    """The parts of a crawl; each may be replaced by another with the same protocol."""

    cfg: Config
    fetcher: protocols.Fetcher | None = None
    discoverers: list[protocols.Discoverer] | None = None
    extractor: protocols.Extractor = field(default_factory=HtmlExtractor)

    def __post_init__(self) -> None:
        cfg = self.cfg
        self.fetcher = self.fetcher or fetch.HttpFetcher(cfg.rate_limit, cfg.user_agent, cfg.timeout_s, workers=cfg.workers)
        if self.discoverers is None:
            self.discoverers = [SitemapDiscoverer(cfg, self.fetcher)]
        self.state = f"{cfg.output_dir.rstrip('/')}/state"

    # --- levels

    def _files(self, spark: SparkSession, path: str) -> tuple:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _complete(self, spark: SparkSession, level: int) -> bool:
        fs, p = self._files(spark, f"{self.state}/level={level}/_SUCCESS")
        return fs.exists(p)

    def _levels(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """One scan, however many levels."""
        found = spark.read.schema(PAGES).parquet(*(f"{self.state}/level={k}" for k in range(first, last + 1)))
        return found.select(*(c.split()[0] for c in PAGES.split(", ")))

    def discover(self, spark: SparkSession) -> DataFrame:
        """The frontier to begin with: the seed, and what the discoverers find in scope."""
        found = frontier.seeds(spark, self.cfg.seed_url)
        for d in self.discoverers:
            found = found.unionByName(d.discover(spark, self.cfg.seed_url).withColumn("norm_url", normalize_url(F.col("url"))).select(*found.columns))
        return distinct_urls(found.filter("norm_url is not null"))

    def run(self, spark: SparkSession) -> DataFrame:
        """All fetched pages, failures included."""
        cfg, scope = self.cfg, pipelines.scope_of(self.cfg)
        if not cfg.resume:
            fs, p = self._files(spark, self.state)
            fs.delete(p, True)
        rules = read_robots(spark, cfg, self.fetcher)
        if rules.crawl_delay_s and isinstance(self.fetcher, fetch.HttpFetcher):
            self.fetcher.crawl_delay_s = rules.crawl_delay_s
        level = 0
        while True:
            if not self._complete(spark, level):
                if not level:
                    asked = self.discover(spark)
                else:
                    edges = extract.link_edges(self._levels(spark, level - 1, level - 1).filter("error is null").select("url", "body"))
                    asked = edges.select(F.col("dst").alias("url"), normalize_url(F.col("dst")).alias("norm_url"), F.lit(level).alias("depth"), F.lit("link").alias("source"))
                    asked = asked.filter("norm_url is not null").filter(scope.allows(F.col("url"), F.col("depth")))
                    asked = distinct_urls(asked).join(self._levels(spark, 0, level - 1).select("norm_url"), "norm_url", "left_anti")
                allowed = asked.filter(rules.allows(F.col("url")))
                got = self.fetcher.fetch(allowed.select("url", "depth"))
                keys = allowed.select("url", "norm_url", "source")
                got.join(keys, "url").select(*(c.split()[0] for c in PAGES.split(", "))).write.mode("overwrite").parquet(f"{self.state}/level={level}")
            if self._levels(spark, level, level).isEmpty():
                return self._levels(spark, 0, level)
            level += 1

    # --- documents

    def documents(self, pages: DataFrame) -> DataFrame:
        """Documents of the pages, one for each content; bad pages have an error."""
        kept = pipelines.fetched_pages(pages)
        return self.extractor.extract(kept).join(kept.select("url", F.col("fetched_at").alias("crawled_at")), "url")

    def summary(self, pages: DataFrame, documents: DataFrame) -> DataFrame:
        """One row: times, documents written, and pages that failed at fetching or extraction."""
        bad = documents.filter("error is not null").select("url", F.lit(True).alias("bad"))
        judged = pages.join(bad, "url", "left").withColumn("failed", F.col("error").isNotNull() | F.coalesce("bad", F.lit(False)))
        return export.manifest(judged, self.cfg.seed_url, F.col("failed"))


def crawl(spark: SparkSession, cfg: Config, writer: protocols.Writer | None = None, **parts: object) -> DataFrame:
    """Fetches the site and writes its pages below the output folder; returns the manifest's row."""
    job = Crawl(cfg, **parts)
    pages = job.run(spark)
    docs = job.documents(pages)
    writer = writer or sinks.MarkdownWriter(cfg.output_dir, cfg.seed_url)
    writer.write(extract.whole(docs))
    summary = job.summary(pages, docs)
    writer.close(summary)
    return summary


def store_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/index"


def ingest(spark: SparkSession, cfg: Config, store: protocols.Indexer | None = None, chunker: protocols.Chunker | None = None, embedder: protocols.Embedder | None = None, **parts: object) -> protocols.Indexer:
    """Fetches the site, and indexes its chunks and vectors."""
    job = Crawl(cfg, **parts)
    docs = extract.whole(job.documents(job.run(spark)))
    chunks = (chunker or WordChunker(cfg)).chunk(docs)
    vectors = (embedder or embedders.create(cfg.embedder, cfg.embedding_model, cfg.embedding_batch)).transform(chunks)
    store = store or Store(spark, store_path(cfg.output_dir))
    store.index(chunks, vectors)
    return store
