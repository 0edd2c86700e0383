"""Files as a sink: one Markdown file and one sidecar a page, a manifest, and Markdown files by source.

Executors write the files of their own rows, through pyarrow's file systems, so the folder may be any that those reach
(a shared folder, HDFS, an object store). A task that runs again writes the same files again.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import export


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), str(Path(folder).resolve())


def put(system: fs.FileSystem, path: str, text: str) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(text.encode())


def write_files(files: DataFrame, folder: str) -> int:
    """files: path (below the folder), text. Returns how many were written."""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                put(system, f"{base}/{path}", text or "")
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


class MarkdownWriter:
    """pages/<path>.md and pages/<path>.meta.json for each document, and manifest.json."""

    name = "markdown"

    def __init__(self, folder: str, seed_url: str):
        self.folder, self.seed_url, self.pages = folder, seed_url, 0

    def write(self, documents: DataFrame) -> None:
        found = export.page_files(documents, self.seed_url)
        both = F.explode(F.array(F.struct(F.lit(".md").alias("end"), F.col("markdown").alias("text")), F.struct(F.lit(".meta.json").alias("end"), F.col("meta").alias("text")))).alias("f")
        files = found.select("path", both).select(F.concat(F.lit("pages/"), "path", "f.end").alias("path"), "f.text")
        self.pages += write_files(files, self.folder) // 2

    def close(self, summary: DataFrame) -> None:
        """summary: one row, see export.manifest."""
        line = summary.select(F.to_json(F.struct("seed_url", "started_at", "completed_at", "duration_seconds", "pages_crawled", "errors"), {"pretty": "true"}).alias("x")).first()["x"]
        system, base = file_system(self.folder)
        put(system, f"{base}/manifest.json", line + "\n")


def write_markdown_folder(chunks: DataFrame, folder: str) -> int:
    """One file for each source, its chunks in order."""
    return write_files(export.markdown_files(chunks).select(F.col("name").alias("path"), "text"), folder)
