"""Operator 6: dedup by hashed lines or passages, the earliest ranked occurrence stays.

A text is cut into pieces that follow each other without a gap: lines,
paragraphs, or clauses (up to a full stop, comma or line break). A unit is the
run of adjacent pieces from one piece on, up to the first that brings it to
`least` characters. With `least` at 1 every piece is a unit of its own; with
more, a unit is a passage that may begin and end in the middle of a line, and
short pieces that repeat by chance (headings, one-word clauses) are no evidence
by themselves. `least` counts characters, so text without spaces is treated
alike.

A unit is normalised (lower case, white space to single spaces) and digested to
128 bits. Each document sends one row for each digest, so repeats inside a
document never travel. Digests are grouped over all documents with map-side
partial counts; a row whose document isn't the least ranked is joined back, and
the pieces of its unit are cut out. All offsets are those of the original text.

Rank is doc_id (as a number if it is one, else as text), nulls last, then place
in the document.

Defined results: a null text counts as empty; an empty text has no units and
stays empty; a text of fewer than `least` characters is one unit, so that short
documents are compared whole; documents with equal ids have equal rank, so none
of them gives way to the other; equal rows are treated alike; texts are read
whole; extra columns are unused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: What ends a clause, besides the end of the text.
STOPS = "\n.!?,;:。！？，；："
CLAUSE = f"[^{STOPS}]+[{STOPS}]*|[{STOPS}]+"
LINE = "[^\n]*\n|[^\n]+"
PARAGRAPH = "[^\n]+(?:\n[^\n]+)*\n*|\n+"
#: Characters of a passage: about 33 words.
LEAST = 200
#: Units of cut documents that may be broadcast, 4 bytes each, where a row counts as so many units besides its own: under 100 MB.
BROADCAST_UNITS, ROW_UNITS = 8_000_000, 8


def pieces(text: str, by: str = CLAUSE) -> list[tuple[int, int, str]]:
    """(offset, end, normal form) of the pieces that hold more than white space, in characters."""
    found = ((m.start(), m.end(), " ".join(m[0].lower().split())) for m in re.finditer(by, text))
    return [p for p in found if p[2]]


def units(parts: list[tuple[int, int, str]], least: int) -> list[tuple[int, int]]:
    """First and last piece of each unit."""
    ends = np.cumsum([len(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
    if not len(ends) or ends[-1] < least:
        return [(0, len(ends) - 1)] if len(ends) else []
    last = np.searchsorted(ends, np.append(0, ends[:-1]) + least)
    return [(a, int(b)) for a, b in enumerate(last) if b < len(ends)]


def digests(text: str, by: str = CLAUSE, least: int = LEAST) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]], list[bytes]]:
    """Pieces, units, and the digest of each unit."""
    parts = pieces(text, by)
    spans = units(parts, least)
    normal = [p[2] for p in parts]
    return parts, spans, [xxhash.xxh3_128_digest(" ".join(normal[a : b + 1]).encode("utf-8", "surrogatepass")) for a, b in spans]


def without(text: str, by: str, least: int, late: list[int] | None) -> tuple[int, int, list[tuple[int, int]], str]:
    """Number of pieces, number of pieces that are cut, maximal spans cut, and the rest of the text.

    late: units that an earlier document has (-1 says nothing); units that repeat an earlier one of the text go as well.
    """
    if late is None:
        return len(pieces(text, by)), 0, [], text
    parts, spans, keys = digests(text, by, least)
    gone, seen = set(late), set()
    out: list[tuple[int, int]] = []
    hit = done = 0  # units begin and end in order
    for k, ((a, b), key) in enumerate(zip(spans, keys, strict=True)):
        if k in gone or key in seen:
            hit += b + 1 - max(a, done)
            done = b + 1
            start, stop = parts[a][0], parts[b][1]
            if out and start <= out[-1][1]:
                start = out.pop()[0]
            out.append((start, stop))
        seen.add(key)
    bounds = [0, *(x for s in out for x in s), len(text)]
    return len(parts), hit, out, "".join(text[x:y] for x, y in zip(bounds[::2], bounds[1::2], strict=True))


def _rank(docs: DataFrame, doc_id: str) -> Column:
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    return F.when(F.col(doc_id).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(doc_id).cast("string")))


def _digests(keyed: DataFrame, by: str, least: int) -> DataFrame:
    """rank, key, unit, d1, d2: the first unit of each digest of a document. A document that repeats itself adds a row without digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                row, unit, found = [], [], []
                for k, text in enumerate(b.column(2).to_pylist()):
                    keys = digests(text, by, least)[2]
                    first = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1), strict=True))
                    if len(first) < len(keys):
                        first[bytes(16)] = -1
                    row += [k] * len(first)
                    unit += first.values()
                    found += first
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                own, take = np.array(unit, np.int32) < 0, pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(unit, pa.int32()), *(pa.array(halves[:, i], mask=own) for i in (0, 1))], ["rank", "key", "unit", "d1", "d2"])

    return keyed.select("rank", "key", "text").mapInArrow(run, f"rank {dict(keyed.dtypes)['rank']}, key long, unit int, d1 long, d2 long")


RESULT = "n_units long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by: str = CLAUSE, least: int = LEAST) -> DataFrame:
    """Per row of docs: id, n_units (pieces), n_removed, spans (original offsets of what is cut, in characters) and the kept text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("id"), _rank(docs, doc_id).alias("rank"), F.xxhash64(t).alias("key"), t.alias("text"))
    rows = scratch.write("digests", _digests(keyed, by, least))
    first = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").drop("most")
    # written first, so that both sides of the join have an exchange of their own and a hot line can be split
    late = rows.join(scratch.write("first", first), ["d1", "d2"]).filter("rank > least")
    told = late.select("rank", "key", "unit").unionByName(rows.filter("d1 is null").select("rank", "key", "unit"))
    cuts = scratch.write("cuts", told.groupBy("rank", "key").agg(F.collect_set("unit").alias("late")))
    scratch.drop("digests", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                out = [without(x, by, least, late) for x, late in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                spans = pa.array([[{"start": x, "stop": y} for x, y in r[2]] for r in out], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)), spans, pa.array([r[3] for r in out], pa.string())], [doc_id, "n_units", "n_removed", "spans", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    # few cuts go to the texts, whose size is then known; else both meet in an exchange
    size = cuts.agg(F.coalesce(F.sum(F.size("late") + F.lit(ROW_UNITS)), F.lit(0)).alias("n")).first()["n"]
    joined = keyed.join(F.broadcast(cuts) if size <= BROADCAST_UNITS else cuts, ["rank", "key"], "left")
    return joined.select("id", "text", "late").mapInArrow(run, f"`{doc_id}` {kind}, {RESULT}")
