"""The crawl frontier: level by level from the seeds along links, each URL once, at its least depth."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.urls import normalize_url

from .dedup import distinct_urls
from .scope import Scope

FRONTIER = "url string, norm_url string, depth int, source string, discovered_by string"


def seeds(spark: object, url: str) -> DataFrame:
    """The seed is admitted whatever the scope."""
    row = spark.createDataFrame([(url, 0, "seed", "seed")], "url string, depth int, source string, discovered_by string")
    return row.withColumn("norm_url", normalize_url(F.col("url"))).select("url", "norm_url", "depth", "source", "discovered_by")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine it may be unset, and is set here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    at = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def traverse(start: DataFrame, edges: DataFrame, scope: Scope) -> DataFrame:
    """start: frontier rows; edges: src, dst (URLs). All that is reached in scope, with its depth.

    A level is an equi-join of the newest URLs with the edges and an anti-join with all seen. Levels are written to the
    shared folder, so that plans don't grow with depth; the loop ends with a level that adds nothing.
    """
    spark = start.sparkSession
    at = scratch_dir(spark, "frontier")
    pairs = edges.select(normalize_url(F.col("src")).alias("norm_url"), F.col("dst").alias("url")).filter("norm_url is not null").distinct()
    pairs = pairs.withColumn("dst_norm", normalize_url(F.col("url")))

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{at}/level={k}")
        return spark.read.schema(FRONTIER).parquet(f"{at}/level={k}")

    def all_levels() -> DataFrame:
        return spark.read.schema(FRONTIER).parquet(at).select(*start.columns)  # one scan, however many levels

    level, k = keep(distinct_urls(start).select(*start.columns), 0), 0
    while not level.isEmpty():
        k += 1
        out = level.select("norm_url", "depth").join(pairs, "norm_url").select("url", F.col("dst_norm").alias("norm_url"), (F.col("depth") + 1).alias("depth"), F.lit("link").alias("source"), F.lit("link-follower").alias("discovered_by"))
        out = out.filter("norm_url is not null").filter(scope.allows(F.col("url"), F.col("depth"))).join(all_levels().select("norm_url"), "norm_url", "left_anti")
        level = keep(distinct_urls(out).select(*start.columns), k)
    return all_levels()
