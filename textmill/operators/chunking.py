"""Documents to chunks: fixed word windows, or sections by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import chunk_id, content_hash, estimate_tokens, strip, tokens_of_words, words, words_for_tokens

FENCE = "```"
CHUNK_COLUMNS = ["id", "content", "source_url", "title", "heading_path", "chunk_index", "total_chunks", "token_count", "content_hash"]


def with_identity(chunks: DataFrame, token_count: Column | None = None) -> DataFrame:
    """source_url, title, heading_path, content, chunk_index, total_chunks -> all chunk columns."""
    return chunks.withColumns({
        "id": chunk_id(F.col("source_url"), F.col("heading_path"), F.col("chunk_index")),
        "token_count": estimate_tokens(F.col("content")) if token_count is None else token_count,
        "content_hash": content_hash(F.col("content")),
    })


def fixed_chunks(docs: DataFrame, max_tokens: int = 512, overlap_tokens: int = 50) -> DataFrame:
    """Windows of words from every step-th word on, as long as one begins inside the text. docs: url, title, markdown.

    All in the row of the document: no exchange. heading_path is null. The windows are made inside the row, so that a
    chunk's row carries its own words only, and no filter makes the split run twice.
    """
    size = max(1, words_for_tokens(max_tokens))
    step = max(1, size - words_for_tokens(overlap_tokens))
    split = docs.select("*", words(F.coalesce("markdown", F.lit(""))).alias("_w"))
    n = F.size("_w")
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    one = lambda at, i: F.struct(
        i.cast("int").alias("index"), F.ceil(n / step).cast("int").alias("total"), F.least(F.lit(size), n - at).cast("int").alias("n"),
        F.array_join(F.slice("_w", at + 1, size), " ").alias("content"),
    )
    rest = [c for c in docs.columns if c not in ("url", "title", "markdown")]
    at = split.select(*rest, F.col("url").alias("source_url"), "title", F.explode(F.transform(spots, one)).alias("_x"))
    chunks = at.select(
        *rest, "source_url", "title", F.lit(None).cast("array<string>").alias("heading_path"),
        F.col("_x.index").alias("chunk_index"), F.col("_x.total").alias("total_chunks"), F.col("_x.content").alias("content"), F.col("_x.n").alias("_n"),
    )
    return with_identity(chunks, tokens_of_words(F.col("_n"))).drop("_n")


def heading_sections(docs: DataFrame) -> DataFrame:
    """source_url, title, document, section, heading_path, content of each section that isn't blank.

    A section begins at a line "## " or "### " outside a code fence; its path is [h2] or [h2, h3], [h3] before any h2,
    [] before any heading. A fence that opens before any other line is dropped. Documents of one URL are kept apart by
    their texts; equal documents give their sections once.
    """
    text = F.coalesce("markdown", F.lit(""))
    keyed = docs.select("url", "title", F.xxhash64(text, "title").alias("_d"), F.xxhash64(F.lit(1), text, "title").alias("_e"), text.alias("markdown"))
    lines = keyed.select("url", "title", "_d", "_e", F.posexplode(F.split("markdown", "\n")).alias("pos", "line")).dropDuplicates(["url", "_d", "_e", "pos"])
    run = Window.partitionBy("url", "_d", "_e").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = strip(F.col("line")).startswith(FENCE)
    lines = lines.withColumn("fence", fence).withColumn("inside", F.sum(F.col("fence").cast("int")).over(run) % 2 == 1)
    plain = ~F.col("fence") & ~F.col("inside")
    lines = lines.withColumn("h2", plain & F.col("line").startswith("## ")).withColumn("h3", plain & F.col("line").startswith("### "))
    lines = lines.withColumns({
        "section": F.sum((F.col("h2") | F.col("h3")).cast("int")).over(run),
        "last_h2": F.last(F.when(F.col("h2"), F.substring("line", 4, 1 << 30)), ignorenulls=True).over(run),
        "begun": F.max((~F.col("fence") & ~F.col("inside")).cast("int")).over(run) == 1,
    })
    parts = lines.filter("begun").groupBy("url", "_d", "_e", "section").agg(
        F.first("title").alias("title"), F.min(F.struct("pos", "line", "h2", "h3", "last_h2")).alias("top"),
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"),
    )
    sub = F.substring(F.col("top.line"), 5, 1 << 30)
    known = F.coalesce(F.col("top.last_h2"), F.lit("")) != ""
    path = (
        F.when(F.col("top.h2"), F.array("top.last_h2")).when(F.col("top.h3") & known, F.array("top.last_h2", sub)).when(F.col("top.h3"), F.array(sub))
        .otherwise(F.array().cast("array<string>"))
    )
    content = strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return parts.select(F.col("url").alias("source_url"), "title", F.col("_d").alias("document"), "section", path.alias("heading_path"), content.alias("content")).filter("content <> ''")


def paragraphs(content: Column) -> Column:
    """Runs of lines between blank lines outside fences, each stripped; computed in the row."""

    def step(a: Column, line: Column) -> Column:
        fence = strip(line).startswith(FENCE)
        inside = F.when(fence, ~a["inside"]).otherwise(a["inside"])
        cut = (strip(line) == "") & ~inside
        whole = strip(F.array_join(a["buf"], "\n"))
        done = F.when(cut & (whole != ""), F.array_append(a["done"], whole)).otherwise(a["done"])
        buf = F.when(cut, F.array().cast("array<string>")).otherwise(F.array_append(a["buf"], line))
        return F.struct(done.alias("done"), buf.alias("buf"), inside.alias("inside"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("buf"), F.lit(False).alias("inside"))
    rest = lambda a: strip(F.array_join(a["buf"], "\n"))
    return F.aggregate(F.split(content, "\n"), start, step, lambda a: F.when(rest(a) != "", F.array_append(a["done"], rest(a))).otherwise(a["done"]))


def pack(parts: Column, max_tokens: int) -> Column:
    """Greedy: a part joins the open chunk while the sum of both token counts fits; one that is too large stands alone."""

    def step(a: Column, p: Column) -> Column:
        n = estimate_tokens(p)
        full = (a["n"] + n > max_tokens) & (F.size(a["buf"]) > 0)
        return F.struct(
            F.when(full, F.array_append(a["done"], F.array_join(a["buf"], "\n\n"))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(a["buf"], p)).alias("buf"),
            F.when(full, n).otherwise(a["n"] + n).alias("n"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("buf"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["buf"]) > 0, F.array_append(a["done"], F.array_join(a["buf"], "\n\n"))).otherwise(a["done"]))


def heading_chunks(docs: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Sections, those over max_tokens cut between paragraphs; index and total run over the document."""
    s = heading_sections(docs)
    pieces = F.when(estimate_tokens(F.col("content")) <= max_tokens, F.array("content")).otherwise(pack(paragraphs(F.col("content")), max_tokens))
    cut = s.select("source_url", "title", "document", "section", "heading_path", F.posexplode(pieces).alias("piece", "content"))
    doc = Window.partitionBy("source_url")
    cut = cut.withColumn("chunk_index", (F.row_number().over(doc.orderBy("document", "section", "piece")) - 1).cast("int")).withColumn("total_chunks", F.count("*").over(doc).cast("int"))
    return with_identity(cut.drop("document", "section", "piece"))


STRATEGIES = {"heading": lambda d, n, o: heading_chunks(d, n), "": lambda d, n, o: heading_chunks(d, n), "fixed": fixed_chunks}


def chunk(docs: DataFrame, strategy: str = "heading", max_tokens: int = 512, overlap_tokens: int = 50) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy: {strategy}")
    return STRATEGIES[strategy](docs, max_tokens, overlap_tokens)
