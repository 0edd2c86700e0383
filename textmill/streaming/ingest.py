"""Incremental ingest: pages as a stream, chunks upserted in micro-batches; the checkpoint makes it resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.urls import normalize_url
from textmill.operators import chunking, extract
from textmill.operators.store import Store


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """page files (url, html) as they arrive; the limit bounds a micro-batch."""
    raw = spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select("url", F.col("html").alias("body")).withColumn("norm_url", normalize_url(F.col("url")))


def ingest_stream(pages: DataFrame, store: Store, checkpoint: str, strategy: str = "heading", max_tokens: int = 512, overlap_tokens: int = 50):
    """Starts the query: each URL once (state by normal form), extracted, chunked and upserted; ends when input is used up.

    An upsert by chunk id makes a repeated micro-batch harmless.
    """

    def sink(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        docs = extract.whole(extract.extract(batch.select("url", "body")))
        store.index(chunking.chunk(docs, strategy, max_tokens, overlap_tokens))

    return pages.dropDuplicates(["norm_url"]).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
