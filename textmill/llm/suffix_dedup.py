"""Operator 9: removes every byte of a repeated `DEPTH`-byte string, by blockwise suffix sorting with a difference cover.

Sorting the suffixes of a whole corpus in one order would ship each suffix with
its next bytes. Only suffixes that agree on DEPTH bytes matter, so suffixes are
put in buckets by content that lies inside those bytes; a bucket is then sorted
by itself (suffix_sort), with long ties resolved by cover-sample ranks.

1. `anchor_runs`: each window of DEPTH bytes has one anchor, the leftmost least
   of its GRAM-byte grams by hash. Equal windows have equal anchors at equal
   offsets. Successive windows with one anchor form a run: about one row for 77
   bytes of text, with hashes of the anchor gram and of all bytes of the run.
2. Anchors are counted over all documents (map-side partial counts, so a hot
   passage is one row per task). An anchor met once has no repeated window, and
   goes.
3. Copies are pre-aggregated: of runs with equal bytes (by a 128-bit digest),
   two stand for all. The runs that stand are cut by offset from the anchor into
   blocks of up to `SPAN` windows. A block's bucket is the digest of the bytes
   that all windows of its offsets share. Buckets with one block go, the rest is
   sorted bucket by bucket in `sort_blocks`, which compares bytes. What the
   sort finds of a run that stands for copies holds for each of them.
4. A bucket of more than `HOT_BLOCKS` blocks (a passage with that many different
   neighbours) isn't gathered. Its blocks are pre-aggregated like runs: two of
   each go through the same sort. Blocks that no other equals, with the two that
   stand for the others, are cut into pieces of 16, 4 and at last 1 windows,
   whose buckets are made, sorted and cut in the same way.
5. Repeated windows become byte ranges of their documents, and are cut out.

Whole texts take part; nothing is capped. What travels: rows of runs, the bytes
of blocks in step 3, and the texts of documents that lose something.

Defined results: a null text counts as empty; texts under DEPTH bytes and empty
tables lose nothing; equal rows (also with equal or null ids) are different
documents, so their texts are repeated; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, row_digest
from .suffix_sort import repeated

DEPTH, GRAM, SPAN, HOT_BLOCKS = 200, 48, 64, 1_000
#: Bytes that are hashed at a time; places within them fit into PLACE_BITS bits.
PIECE, PLACE_BITS = 1 << 18, 20

_ONE = np.uint64(1)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _ONE
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any byte ranges of a piece, from sums of byte values times powers of an odd base."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray, bits: int = 64):
        self.bits = bits
        if len(Hashes._up) < len(data) + 1:
            n = max(PIECE + 2 * DEPTH, len(data) + 1)
            Hashes._up, Hashes._down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * Hashes._up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * Hashes._down[start]) >> np.uint64(64 - self.bits)


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n successive entries, by doubling."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def anchor_runs(data: np.ndarray, starts: np.ndarray, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of the documents data[starts[k]:starts[k + 1]].

    Returns document, start within it, number of windows, offset of the anchor from the start, anchor hash.
    Long input is taken in pieces; where a piece ends, a run may be cut in two, which costs a row and no result.
    Hashes only choose and group: any number of `bits` gives the same result in the end.
    """
    parts = []
    grams_in = DEPTH - GRAM + 1
    at, end = int(starts[0]), int(starts[-1])
    while at + DEPTH <= end:
        stop = min(at + PIECE, end)
        piece = data[at:stop]
        h = Hashes(piece, bits)
        size = len(piece)
        gram = h.of(slice(0, size - GRAM + 1), slice(GRAM, size + 1))
        mask = np.uint64((1 << PLACE_BITS) - 1)
        key = (gram << np.uint64(64 - bits) & ~mask) | np.arange(len(gram), dtype=np.uint64)
        anchor = (_window_min(key, grams_in) & mask).astype(np.int64)  # of each window start in the piece
        first, last = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, stop, "left"))
        doc = np.repeat(np.arange(first, last), np.diff(np.clip(starts[first : last + 1], at, stop)))
        place = np.arange(len(anchor))
        ok = place + at + DEPTH <= starts[doc[: len(anchor)] + 1]
        place = place[ok]
        if len(place):
            own, mine = doc[place], anchor[place]
            new = np.ones(len(place), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (own[1:] != own[:-1])
            b = np.flatnonzero(new)
            m = np.diff(np.append(b, len(place)))
            s = place[b]
            parts.append((own[b], s + at - starts[own[b]], m, mine[b] - s, gram[mine[b]]))
        at = stop - DEPTH + 1
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def row_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, k1, k2, text: rows have equal keys only if id and text are equal."""
    key = row_digest(F.col(doc_id), F.col(text))
    return docs.select(F.col(doc_id).alias("id"), key["k1"].alias("k1"), key["k2"].alias("k2"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


RUN = "k1 long, k2 long, start int, m int, off int, fp long, s1 long, s2 long"


def _halves(found: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two numbers each."""
    both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _runs(keyed: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = _buffers(b.column(2))
            doc, start, m, off, fp = anchor_runs(data, starts, bits)
            view, begin = memoryview(data), starts[doc] + start
            own = [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), (begin + m - 1 + DEPTH).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (start, m, off)), pa.array(fp.view(np.int64)), *_halves(own)],
                ["k1", "k2", "start", "m", "off", "fp", "s1", "s2"],
            )

    return keyed.select("k1", "k2", "text").mapInArrow(run, RUN)


#: of: the copies that a run or window stands for have this digest; null if it stands for itself.
#: at: place of the first window among the SPAN that share the core.
BLOCK = "core long, k1 long, k2 long, start int, m int, of struct<s1:long,s2:long>, data binary, at int"
_OF = pa.struct([("s1", pa.int64()), ("s2", pa.int64())])
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), _OF, pa.binary(), pa.int32())
NAMES = ["core", "k1", "k2", "start", "m", "of", "data", "at"]
RANGES = "k1 long, k2 long, start int, stop int, of struct<s1:long,s2:long>"


def _blocks(with_text: DataFrame) -> DataFrame:
    """k1, k2, text, runs -> blocks of up to SPAN windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k1, k2, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                data = text.as_py().encode()
                for r in runs:
                    # the window at `start` has the anchor at offset `off`, the next at off - 1, and so on
                    i, off, last = r["start"], r["off"], r["off"] - r["m"] + 1
                    while off >= last:
                        low = max(last, off // SPAN * SPAN)
                        m = off - low + 1
                        base = off // SPAN * SPAN
                        a = i + off - base  # where the window at the least offset of the block would start
                        core = data[a : a - SPAN + 1 + DEPTH]
                        digest = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=base.to_bytes(4, "little")).digest(), "little", signed=True)
                        out.append((digest, k1, k2, i, m, r["of"], data[i : i + m - 1 + DEPTH], base + SPAN - 1 - off))
                        i, off = i + m, low - 1
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    return with_text.select("k1", "k2", "text", "runs").mapInArrow(run, BLOCK)


#: Bytes of blocks that are sorted at a time.
SORT_BYTES = 8_000_000


def _sorted_ranges(rows: list[tuple]) -> Iterator[tuple]:
    """Byte ranges of blocks whose windows are repeated among the rows: blocks of equal bytes as a whole, the rest by the sort of one of each."""
    alike: dict[bytes, list[tuple]] = {}
    for r in rows:
        alike.setdefault(r[6], []).append(r)
    text = np.frombuffer(b"".join(alike), np.uint8)
    begin = np.cumsum([0] + [len(x) for x in alike])[:-1]
    m = np.array([same[0][4] for same in alike.values()])
    at = np.repeat(begin, m) + np.concatenate([np.arange(x) for x in m])
    hit = repeated(text, at, DEPTH)
    edge = np.cumsum(np.append(0, m))
    for k, same in enumerate(alike.values()):
        own = hit[edge[k] : edge[k + 1]] | (len(same) > 1)
        if own.any():
            e = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            for r in same:
                for x, y in zip(e[::2], e[1::2], strict=True):
                    yield r[1], r[2], r[3] + int(x), r[3] + int(y) - 1 + DEPTH, r[5]


def _equal_ranges(rows: list[tuple]) -> Iterator[tuple]:
    """Of blocks of equal bytes every window is repeated."""
    for r in rows:
        yield r[1], r[2], r[3], r[3] + r[4] - 1 + DEPTH, r[5]


def sort_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks -> ranges. A bucket is gathered in one task, in order; whole buckets are sorted SORT_BYTES at a time.

    A bucket whose blocks are all equal, byte by byte, needs no sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), _OF))], ["k1", "k2", "start", "stop", "of"])

        held: list[tuple] = []
        group: list[tuple] = []
        done: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                if all(r[6] == group[0][6] for r in group[1:]):
                    done.extend(_equal_ranges(group))
                else:
                    held.extend(group)
                    size += sum(len(r[6]) for r in group)
            group.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    if size > SORT_BYTES:
                        done.extend(_sorted_ranges(held))
                        held.clear()
                        size = 0
                    if len(done) > 4096:
                        yield out(done)
                        done.clear()
                group.append(row)
        close()
        yield out([*done, *(_sorted_ranges(held) if held else ())])

    return blocks.select(*NAMES[:-1]).repartition("core").sortWithinPartitions("core").mapInArrow(run, RANGES)


def _two_of_each(rows: DataFrame, key: list[str], take: list[str]) -> DataFrame:
    """For each key its only row, or the least and the greatest of many (equal ones if the rows are); partial in each task."""
    row = F.struct(*take)
    ends = rows.groupBy(*key).agg(F.min(row).alias("a"), F.max(row).alias("b"), (F.count("*") > 1).alias("many"))
    return ends.select(*key, "many", F.explode(F.when(F.col("many"), F.array("a", "b")).otherwise(F.array("a"))).alias("r")).select(*key, "many", "r.*")


#: Windows of the pieces into which blocks of hot buckets are cut, step by step.
WIDTHS = (16, 4, 1)


def _cut(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces of at most `width` windows. Their bucket is the digest of the bytes that all windows of their places share."""
    first, last = (F.expr(f"CAST(({x}) DIV {width} * {width} AS INT)") for x in ("at", "at + m - 1"))
    one = pieces.withColumn("q", F.explode(F.sequence(first, last, F.lit(width))))
    low, high = F.greatest("at", "q"), F.least(F.col("at") + F.col("m"), F.col("q") + width)
    part = lambda start, n: F.substring(F.col("data"), (start - F.col("at") + 1).cast("int"), n)
    return one.select(
        F.xxhash64(part(F.col("q") + width - 1, F.lit(DEPTH - width + 1)), "q", F.lit(width)).alias("core"), "k1", "k2", (F.col("start") + low - F.col("at")).alias("start"),
        (high - low).alias("m"), "of", part(low, high - low - 1 + DEPTH).alias("data"), low.alias("at"), "old",
    )


def _hot_ranges(blocks: DataFrame, scratch: Scratch, hot_blocks: int) -> DataFrame:
    """Ranges of the blocks of hot buckets. Rows are pieces of many windows; single windows only where repeats begin and end.

    old: all windows of the piece are known to be repeated; it stays for others that share some of them.
    """
    half = lambda at: F.conv(F.substring(F.md5("data"), at, 16), 16, -10).cast("long")
    hot, found = blocks.withColumn("old", F.lit(False)), []
    for width in (SPAN, *WIDTHS):
        if width < SPAN:
            pieces = scratch.write(f"pieces{width}", _cut(stand.withColumn("old", F.col("old") | F.col("many")), width))
            n = pieces.groupBy("core").agg(F.count("*").alias("n"), F.bool_and("old").alias("known"))
            n = scratch.write(f"sizes{width}", n.filter("n > 1 AND NOT known").select("core", (F.col("n") > hot_blocks).alias("hot")))
            # written first, so that both sides have an exchange of their own and a hot bucket can be split
            pieces = scratch.write(f"met{width}", pieces.join(n, "core"))
            found.append(scratch.write(f"found{width}", sort_blocks(pieces.filter("NOT hot"))))
            hot = pieces.filter("hot").drop("hot")
            if hot.isEmpty():
                break
        one = scratch.write(f"hot{width}", hot.withColumns({"s1": half(1), "s2": half(17)}))
        stand = scratch.write(f"stand{width}", _two_of_each(one, ["s1", "s2"], ["core", "k1", "k2", "start", "m", "of", "data", "at", "old"]))
        sides = stand.filter("many").withColumns({"core": F.xxhash64("s1", "s2"), "of": F.struct("s1", "s2")})
        alike = scratch.write(f"alike{width}", sort_blocks(sides).select("of.s1", "of.s2").distinct())
        new = one.filter("NOT old").join(alike, ["s1", "s2"])
        found.append(scratch.write(f"equal{width}", new.select("k1", "k2", "start", (F.col("start") + F.col("m") - 1 + DEPTH).alias("stop"), "of")))
        scratch.drop(f"pieces{width}", f"sizes{width}", f"met{width}", f"hot{width}", f"alike{width}")
    return reduce(DataFrame.unionByName, found)


def repeated_ranges(keyed: DataFrame, scratch: Scratch, bits: int = 64, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """k1, k2, start, stop: byte ranges, which may overlap, made of repeated windows."""
    runs = scratch.write("runs", _runs(keyed, bits))
    met = runs.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    # written first, so that both sides of the join have an exchange of their own and a hot anchor can be split
    kept = scratch.write("kept", runs.join(scratch.write("met", met), "fp"))
    scratch.drop("runs", "met")
    stand = _two_of_each(kept, ["s1", "s2"], ["k1", "k2", "start", "m", "off"])
    of = F.when(F.col("many"), F.struct("s1", "s2"))
    leads = scratch.write("leads", stand.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "m", "off", of.alias("of"))).alias("runs")))
    blocks = scratch.write("blocks", _blocks(keyed.select("k1", "k2", "text").join(leads, ["k1", "k2"])))
    scratch.drop("leads")
    hot = blocks.groupBy("core").count().filter(F.col("count") > hot_blocks).select("core")
    hot = scratch.write("hot_cores", hot)
    any_hot = not hot.isEmpty()
    found = scratch.write("found", sort_blocks(blocks.join(hot, "core", "left_anti") if any_hot else blocks))
    if any_hot:
        found = found.unionByName(scratch.write("found_hot", _hot_ranges(blocks.join(hot, "core"), scratch, hot_blocks)))
    scratch.drop("blocks", *(f"{name}{width}" for name in ("found", "stand", "equal", "pieces", "sizes", "met") for width in (SPAN, *WIDTHS)))
    # runs that stand for copies, and that the sort has found to be repeated
    whole = found.filter("of is not null").select("of.s1", "of.s2").distinct()
    copies = kept.join(scratch.write("whole", whole), ["s1", "s2"]).select("k1", "k2", "start", (F.col("start") + F.col("m") - 1 + DEPTH).alias("stop"))
    return found.filter("of is null").select("k1", "k2", "start", "stop").unionByName(copies)


def cut_out(with_ranges: DataFrame) -> DataFrame:
    """k1, k2, text, ranges -> spans (maximal ranges), n_removed, the digest of the bytes that are kept, and these as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, ranges in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                data, spans = text.as_py().encode(), []
                for r in sorted((x["start"], x["stop"]) for x in ranges):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([*r])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((spans, len(data) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([[{"start": x, "stop": y} for x, y in r[0]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string())))],
                ["k1", "k2", "spans", "n_removed", "sha256", "kept_text"],
            )

    return with_ranges.select("k1", "k2", "text", "ranges").mapInArrow(run, "k1 long, k2 long, spans array<struct<start:int,stop:int>>, n_removed long, sha256 string, kept_text string")


def removed(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", bits: int = 64, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for each distinct (id, text) that loses bytes: k1, k2, spans, n_removed, sha256 and text of what is kept."""
    keyed = row_keys(docs, doc_id, text)
    ranges = repeated_ranges(keyed, scratch, bits, hot_blocks).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return cut_out(keyed.select("k1", "k2", "text").join(ranges, ["k1", "k2"]))


def _one_each(cut: DataFrame) -> DataFrame:
    return cut.dropDuplicates(["k1", "k2"])


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256. Texts that stay whole never leave their task."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    cut = scratch.write("cut", _one_each(removed(docs, scratch, doc_id, text, bits, hot_blocks).select("k1", "k2", "n_removed", F.size("spans").cast("long").alias("n_spans"), "sha256")))
    scratch.drop("kept", "found", "found_hot", "whole")
    rows = row_keys(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", "text")
    rows = rows.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"))
    return rows.join(cut, ["k1", "k2"], "left").select(
        F.col("id").alias(doc_id), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha256", "all_sha256").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", to: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of `text`; other columns stay.

    A cut may fall inside a character: bytes that no longer form one are decoded to U+FFFD.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    cut = scratch.write("cut", _one_each(removed(docs, scratch, doc_id, text).select("k1", "k2", "kept_text")))
    scratch.drop("kept", "found", "found_hot", "whole")
    key, kept = fresh("key", docs.columns), fresh("kept", docs.columns)
    joined = docs.withColumn(key, row_digest(F.col(doc_id), F.col(text)))
    out = joined.join(cut.select(F.struct("k1", "k2").alias(key), F.col("kept_text").alias(kept)), key, "left").withColumn(to, F.coalesce(F.col(kept), F.col(text)))
    return out.drop(key, kept)
