"""Exact vector search, one query or many, and rank fusion with keyword search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.vectors import cosine

from .bm25 import ranked


def search(vectors: DataFrame, query: Sequence[float], k: int = 5, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """key, score, rank of the k nearest by cosine. The query is a literal; each task keeps its own k best."""
    q = F.array(*(F.lit(float(x)) for x in query))
    best = vectors.select(key, cosine(F.col(vector).cast("array<double>"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return ranked(best, key)


def search_chunks(vectors: DataFrame, chunks: DataFrame, query: Sequence[float], k: int = 5) -> DataFrame:
    """As search, with the chunk columns; content is joined to the winners only."""
    have = vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    best = search(have, query, k)
    return best.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")


def search_many(vectors: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int = 5, key: str = "chunk_id", vector: str = "vector", block: int = 256) -> DataFrame:
    """query, key, score, rank: the k nearest of each stated query. Queries go in blocks, so that what is shipped is bounded.

    One matrix product for each Arrow batch; each batch keeps k rows a query, so what is exchanged is small.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    kind = vectors.schema[key].dataType.simpleString()
    named = "string" if queries and isinstance(queries[0][0], str) else "long"
    out = None
    for at in range(0, len(queries), block):
        names = [q[0] for q in queries[at : at + block]]
        matrix = np.array([q[1] for q in queries[at : at + block]], np.float64)
        norms = np.sqrt((matrix**2).sum(axis=1))
        unit = matrix / np.where(norms > 0, norms, 1)[:, None]

        def run(batches: Iterator[pd.DataFrame], unit: np.ndarray = unit, names: list = names) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [v is not None and len(v) == unit.shape[1] for v in b[vector]]
                x = np.array([v if o else np.zeros(unit.shape[1]) for v, o in zip(b[vector], ok, strict=True)], np.float64).reshape(-1, unit.shape[1])
                n = np.sqrt((x**2).sum(axis=1))
                score = (x @ unit.T) / np.where(n > 0, n, 1)[:, None]
                keys = b[key].to_numpy()
                for j, name in enumerate(names):
                    top = np.lexsort((keys, -score[:, j]))[:k]
                    if len(top):
                        yield pd.DataFrame({"query": [name] * len(top), key: keys[top], "score": score[top, j]})

        part = vectors.select(key, vector).mapInPandas(run, f"query {named}, `{key}` {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 5, key: str = "id", damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked results (an extension)."""
    both = keyword.select(key, "rank").unionByName(vector.select(F.col(vector.columns[0]).alias(key), "rank"))
    best = both.groupBy(key).agg(F.sum(1 / (damping + F.col("rank"))).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return ranked(best, key)
