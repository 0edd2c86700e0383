"""Results as JSON lines, CSV, Markdown and Parquet, and rendered search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import join_path, rfc3339, snippet
from textmill.functions.urls import url_to_filename

ARROW = " › "
FORMATS = ("jsonl", "csv", "markdown", "parquet")


def jsonl_rows(chunks: DataFrame, with_vectors: bool = False) -> DataFrame:
    """One column, `line`. A null heading path is written as null; a vector only if asked for and there."""
    stamp = rfc3339(F.col("crawled_at")) if "crawled_at" in chunks.columns else F.lit(None).cast("string")
    fields = [F.col(c) for c in ("id", "content", "source_url", "title", "heading_path", "chunk_index", "total_chunks", "token_count")]
    base = F.struct(*fields, F.coalesce(stamp, F.lit("")).alias("crawled_at"), F.col("content_hash"))
    line = F.to_json(base, {"ignoreNullFields": "false"})
    if with_vectors:
        tail = F.concat(F.lit(',"vector":'), F.to_json("vector"), F.lit("}"))
        line = F.when(F.size("vector") > 0, F.concat(F.left(line, F.length(line) - 1), tail)).otherwise(line)
    return chunks.select(line.alias("line"))


#: The columns and their order.
CSV_COLUMNS = ("id", "source_url", "title", "heading_path", "content", "token_count", "content_hash")


def csv_rows(chunks: DataFrame) -> DataFrame:
    """The seven columns as text; the heading path joined by " > "."""
    return chunks.select("id", "source_url", "title", join_path(F.col("heading_path")).alias("heading_path"), "content", F.col("token_count").cast("string").alias("token_count"), "content_hash")


def _block() -> Column:
    """Fixed value: the layout of a chunk in Markdown."""
    head = F.when(F.size("heading_path") > 0, join_path(F.col("heading_path"), ARROW)).otherwise(F.col("title"))
    return F.concat(F.lit("# "), head, F.lit("\n\n**Source:** "), F.col("source_url"), F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n\n"))


def markdown_blocks(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_url", "chunk_index", _block().alias("block"))


def markdown_files(chunks: DataFrame) -> DataFrame:
    """name, source_url, text: one file a source. Sources whose names collide get a digest of the URL behind it."""
    parts = chunks.groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("chunk_index", _block().alias("block")))).alias("bs"))
    files = parts.select("source_url", url_to_filename(F.col("source_url")).alias("base"), F.array_join(F.transform("bs", lambda b: b["block"]), "").alias("text"))
    least = files.groupBy("base").agg(F.min("source_url").alias("_first"))
    name = F.when(F.col("source_url") == F.col("_first"), F.col("base")).otherwise(F.concat("base", F.lit("-"), F.left(F.sha2("source_url", 256), F.lit(8))))
    return files.join(least, "base").select(F.concat(name, F.lit(".md")).alias("name"), "source_url", "text")


def lines(chunks: DataFrame, form: str = "jsonl", with_vectors: bool = False) -> DataFrame:
    """One column, `line`, in order of source and index: what `export` writes in its text forms."""
    ordered = chunks.orderBy("source_url", "chunk_index")
    if form == "jsonl":
        return jsonl_rows(ordered, with_vectors)
    if form == "markdown":
        return ordered.select(F.regexp_replace(_block(), r"\n\z", "").alias("line"))
    if form == "csv":
        rows = csv_rows(ordered)
        head = ordered.sparkSession.createDataFrame([(",".join(CSV_COLUMNS),)], "line string")
        quoted = (F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in CSV_COLUMNS)
        return head.unionByName(rows.select(F.concat_ws(",", *quoted).alias("line")))
    raise ValueError(f"{form} isn't a form of text")


def export(chunks: DataFrame, path: str, form: str = "jsonl", with_vectors: bool = False) -> None:
    """Writes a folder of part files, in order of source and index within each."""
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    ordered = chunks.repartitionByRange("source_url", "chunk_index").sortWithinPartitions("source_url", "chunk_index")
    if form == "jsonl":
        jsonl_rows(ordered, with_vectors).write.mode("overwrite").text(path)
    elif form == "csv":
        csv_rows(ordered).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form == "markdown":
        # the writer ends each row with the last line break of its block
        ordered.select(F.regexp_replace(_block(), r"\n\z", "").alias("value")).write.mode("overwrite").text(path)
    else:
        (ordered if with_vectors else ordered.drop("vector")).write.mode("overwrite").parquet(path)


def page_files(documents: DataFrame, base: str) -> DataFrame:
    """path, markdown, meta (JSON) of each page; pages whose paths collide get a digest of the URL behind it."""
    from textmill.functions.urls import url_to_filepath

    meta = F.to_json(
        F.struct(
            "url", "title", "description", F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")).alias("headings"), "word_count",
            *([rfc3339(F.col("crawled_at")).alias("crawled_at")] if "crawled_at" in documents.columns else []), "content_hash",
            F.coalesce("links", F.array().cast("array<string>")).alias("links"),
        ), {"ignoreNullFields": "false", "pretty": "true"},
    )
    named = documents.withColumn("path", url_to_filepath(base, F.col("url")))
    least = named.groupBy("path").agg(F.min("url").alias("_first"))
    path = F.when(F.col("url") == F.col("_first"), F.col("path")).otherwise(F.concat("path", F.lit("-"), F.left(F.sha2("url", 256), F.lit(8))))
    return named.join(least, "path").select(path.alias("path"), "markdown", meta.alias("meta"))


def manifest(pages: DataFrame, seed_url: str, failed: Column) -> DataFrame:
    """One row: seed, first and last time, seconds between, pages and errors. pages: fetched_at and what `failed` reads."""
    start, end = F.min("fetched_at"), F.max("fetched_at")
    return pages.agg(
        F.lit(seed_url).alias("seed_url"), rfc3339(start).alias("started_at"), rfc3339(end).alias("completed_at"),
        (F.unix_micros(end) - F.unix_micros(start)).cast("double").alias("_us"), F.sum((~failed).cast("long")).alias("pages_crawled"), F.sum(failed.cast("long")).alias("errors"),
    ).withColumn("duration_seconds", F.col("_us") / 1e6).drop("_us")


def result_json(results: DataFrame) -> DataFrame:
    """One column, `line`: rank, score, title, url, heading path and snippet of each result."""
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    return results.orderBy("rank").select(F.to_json(F.struct("rank", "score", "title", F.col("source_url").alias("url"), path.alias("heading_path"), snippet(F.col("content")).alias("snippet"))).alias("line"))


def result_text(results: DataFrame) -> DataFrame:
    """One column, `line`: a result for people to read."""
    path = F.when(F.size("heading_path") > 0, join_path(F.col("heading_path"), ARROW)).otherwise(F.lit("(no heading)"))
    short = F.regexp_replace(snippet(F.col("content")), "\n", " ")
    return results.orderBy("rank").select(F.concat_ws("\n", F.format_string("%d. [%.4f] %s", "rank", "score", "title"), F.concat(F.lit("   "), path), F.concat(F.lit("   "), F.col("source_url")), F.concat(F.lit("   "), short)).alias("line"))
