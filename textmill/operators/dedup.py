"""Exact de-duplication with a stated survivor, and keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which source a URL is credited to when found at one depth by several.
SOURCE_ORDER = {"seed": 0, "sitemap": 1, "link": 2}


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the least by `order`.

    A partial aggregate of the least row of each task, so that a hot key is one row per task and no window sorts it.
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = df.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min_by(F.struct(*df.columns), rank).alias("_row"))
    return best.select("_row.*")


def distinct_urls(frontier: DataFrame, norm: str = "norm_url") -> DataFrame:
    """One row for each normal form: the least depth, then seed before sitemap before link, then the URL."""
    source = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for s, n in SOURCE_ORDER.items()), F.lit(9))
    return first_by(frontier, [norm], [F.col("depth"), source, F.col("url")])


def distinct_content(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    return first_by(df, [digest], [F.col(c) for c in order])


def crawl_stats(urls: DataFrame, norm: str, failed: Column) -> DataFrame:
    """One row: distinct URLs, duplicates, failures."""
    return urls.agg(
        F.count_distinct(norm).alias("urls_seen"), (F.count(norm) - F.count_distinct(norm)).alias("duplicates"), F.sum(failed.cast("long")).alias("errors")
    )


def upsert(existing: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of `new` replace those of `existing` with the same key; of several new rows the highest version stays."""
    if version:
        new = first_by(new, key, [-F.col(version)])
    return existing.join(new.select(*key), key, "left_anti").unionByName(new.select(*existing.columns))
