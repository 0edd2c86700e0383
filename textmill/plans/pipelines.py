"""The two pipelines: crawl to documents, and ingest to a searchable store; each stage is a DataFrame function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.urls import normalize_url
from textmill.operators import chunking, export, extract, frontier
from textmill.operators.dedup import distinct_content
from textmill.operators.scope import Scope
from textmill.operators.store import Store
from textmill.sources import embedders
from textmill.sources.config import Config
from textmill.sources.robots import Robots


def scope_of(cfg: Config) -> Scope:
    return Scope(cfg.seed_url, tuple(cfg.includes), tuple(cfg.excludes), cfg.max_depth, same_domain=True)


def fetched_pages(found: DataFrame, body: str = "body") -> DataFrame:
    """Fetched rows without errors and oversized bodies, one for each content, the least depth first."""
    ok = found.filter(F.col(body).isNotNull()).filter(extract.small_enough(body))
    if "error" in ok.columns:
        ok = ok.filter("error is null")
    hashed = ok.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(F.col(body).cast("binary"), 256))).withColumn("norm_url", normalize_url(F.col("url")))
    return distinct_content(hashed, "content_hash", ["depth", "norm_url"])


def documents(spark: SparkSession, cfg: Config, pages: DataFrame, sitemap: DataFrame | None = None, robots: Robots = Robots()) -> DataFrame:
    """pages: url, body of all that can be fetched -> documents reached from the seed. Duplicates still lend their links."""
    start = frontier.seeds(spark, cfg.seed_url)
    if sitemap is not None:
        start = start.unionByName(sitemap.withColumn("norm_url", normalize_url(F.col("url"))))
    reached = frontier.traverse(start, extract.link_edges(pages), scope_of(cfg)).filter(robots.allows(F.col("url")))
    bodies = pages.select(normalize_url(F.col("url")).alias("norm_url"), "body").dropDuplicates(["norm_url"])
    return extract.whole(extract.extract(fetched_pages(reached.join(bodies, "norm_url").drop("content_hash"))))


def crawl(spark: SparkSession, cfg: Config, pages: DataFrame, **more: object) -> DataFrame:
    """path, markdown, meta of every page, ready to be written below the output folder."""
    return export.page_files(documents(spark, cfg, pages, **more), cfg.seed_url)


def ingest(spark: SparkSession, cfg: Config, pages: DataFrame, store: Store, **more: object) -> Store:
    """Documents to chunks, vectors and postings in the store."""
    docs = documents(spark, cfg, pages, **more)
    chunks = chunking.chunk(docs, cfg.chunk_strategy, cfg.max_tokens, cfg.overlap_tokens)
    vectors = embedders.create(cfg.embedder, cfg.embedding_model, cfg.embedding_batch).transform(chunks)
    store.index(chunks, vectors)
    return store
