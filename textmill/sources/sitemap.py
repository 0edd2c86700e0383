"""Sitemaps as a source of URLs."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.scope import Scope


def sitemap_url(seed: str) -> str:
    at = urlsplit(seed)
    return f"{at.scheme}://{at.netloc}/sitemap.xml"


def locations(body: Column, status: Column) -> Column:
    """loc texts of a urlset; if it has none, of a sitemap index, whose entries are taken as pages. Bad XML or status: none."""
    def locs(outer: str) -> Column:
        return F.regexp_extract_all(body, F.lit(rf"(?is)<(?:\w+:)?{outer}\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>([^<]*)<"), F.lit(1))

    whole = body.rlike(r"(?is)</(?:\w+:)?(urlset|sitemapindex)\s*>\s*$")
    pages = locs("url")
    found = F.when(F.size(pages) > 0, pages).otherwise(locs("sitemap"))
    plain = F.transform(found, lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return F.when(whole & (status == 200), plain).otherwise(F.array().cast("array<string>"))


def discover(fetched: DataFrame, scope: Scope) -> DataFrame:
    """fetched: status, body (text of sitemaps) -> url, depth, source, discovered_by; in scope at depth 0, not distinct."""
    urls = fetched.select(F.explode(locations(F.col("body").cast("string"), F.col("status"))).alias("url"))
    rows = urls.select("url", F.lit(0).alias("depth"), F.lit("sitemap").alias("source"), F.lit("sitemap").alias("discovered_by"))
    return rows.filter(scope.allows(F.col("url"), F.col("depth")) & F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
