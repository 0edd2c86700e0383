"""TF-IDF vectors, fitted on each document's chunks (or on the corpus, as an extension). Sparse rows are canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import ascii_tokens


def sparse(chunks: DataFrame, batch: str | None = "source_url", chunk: str = "id", content: str = "content") -> DataFrame:
    """batch, chunk, term, first position, weight: tf * (ln(N / df) + 1), scaled to length 1 in each chunk.

    N counts the chunks of the batch, also those without tokens. batch=None fits the whole corpus, with partial counts
    before each exchange. For a batch (the chunks of one document) the chunks are brought together once, and all else
    happens there.
    """
    key = F.col(batch) if batch else F.lit(0)
    base = chunks.select(key.alias("_b"), F.col(chunk).alias("_c"), F.coalesce(content, F.lit("")).alias("_t"))
    base = (base.repartition("_b") if batch else base).withColumn("_t", ascii_tokens(F.col("_t")))
    terms = base.select("_b", "_c", F.size("_t").alias("_len"), F.posexplode("_t").alias("pos", "term"))
    counts = terms.groupBy("_b", "_c", "term").agg(F.count("*").alias("f"), F.min("pos").alias("pos"), F.first("_len").alias("_len"))
    if batch:
        df = F.count("*").over(Window.partitionBy("_b", "term"))
        n = base.groupBy("_b").agg(F.count_distinct("_c").alias("n"))
        weighed = counts.withColumn("df", df).join(n, "_b")
    else:
        n = chunks.agg(F.count_distinct(chunk).alias("n")).first()["n"]
        weighed = counts.join(counts.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("n", F.lit(n))
    raw = weighed.withColumn("_v", F.col("f") / F.col("_len") * (F.log(F.col("n") / F.col("df")) + 1))
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy("_b", "_c")))
    out = raw.select(F.col("_b").alias(batch or "batch"), F.col("_c").alias("chunk_id"), "term", "pos", (F.col("_v") / norm).alias("weight"))
    return out


def dense(chunks: DataFrame, batch: str = "source_url", chunk: str = "id", index: str = "chunk_index", content: str = "content") -> DataFrame:
    """chunk_id, vector (float), dimensions: axes by first appearance in the batch; a chunk without tokens is all zeros."""
    rows = sparse(chunks, batch, chunk, content)
    order = chunks.select(F.col(batch), F.col(chunk).alias("chunk_id"), F.col(index).alias("_i"))
    rows = rows.join(order, [batch, "chunk_id"])
    axes = rows.groupBy(batch, "term").agg(F.min(F.struct("_i", "pos")).alias("_first"))
    axes = axes.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "term"))), lambda x: x["term"]).alias("_axes"))
    weights = rows.groupBy(batch, "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_w"))
    joined = order.join(axes, batch, "left").join(weights, [batch, "chunk_id"], "left")
    vector = F.transform(F.coalesce("_axes", F.array().cast("array<string>")), lambda t: F.coalesce(F.element_at(F.col("_w"), t), F.lit(0.0)).cast("float"))
    return joined.select("chunk_id", vector.alias("vector")).withColumn("dimensions", F.size("vector"))
