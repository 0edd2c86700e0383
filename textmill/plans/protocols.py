"""What a part of a crawl or ingest must offer to stand in for the built-in one. Every part works on whole DataFrames."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class Discoverer(Protocol):
    """Finds URLs from a seed: url, depth, source, discovered_by."""

    name: str

    def discover(self, spark: SparkSession, seed: str) -> DataFrame: ...


@runtime_checkable
class Fetcher(Protocol):
    """url, depth -> fetched rows (sources.fetch.FETCHED); what fails is a row with an error."""

    name: str

    def can_fetch(self, url: str) -> bool: ...

    def fetch(self, frontier: DataFrame) -> DataFrame: ...


@runtime_checkable
class Extractor(Protocol):
    """url, body -> documents (operators.extract.DOCUMENT); what fails is a row with an error."""

    name: str

    def extract(self, fetched: DataFrame) -> DataFrame: ...


@runtime_checkable
class Writer(Protocol):
    """Documents to storage; `close` adds what sums the run up."""

    name: str

    def write(self, documents: DataFrame) -> None: ...

    def close(self, summary: DataFrame) -> None: ...


@runtime_checkable
class Chunker(Protocol):
    """Documents -> chunks (operators.chunking.CHUNK_COLUMNS)."""

    name: str

    def chunk(self, documents: DataFrame) -> DataFrame: ...


@runtime_checkable
class Embedder(Protocol):
    """Chunks -> chunk_id, vector, dimensions."""

    name: str

    def transform(self, chunks: DataFrame) -> DataFrame: ...


@runtime_checkable
class Indexer(Protocol):
    """Keeps chunks and vectors, and answers queries."""

    def index(self, chunks: DataFrame, embeddings: DataFrame | None = None, prune: bool = True) -> None: ...

    def search(self, query: str, k: int = 5) -> DataFrame: ...
