"""Operator 4: benchmark decontamination over a stored, distributed positional inverted index.

The index is a written table. A row is a shard: a run of whole documents of about
SHARD_WORDS words, with its terms in order and, for each, the sorted list of its
places. No posting crosses the network, no key gathers in one task, and a lost
executor costs the tasks at hand. An index serves any number of queries.

Query items go against the index in blocks of at most BLOCK_BYTES of item text;
longer items are cut into pieces that overlap, so that no window is lost. For
each block:

1. One read of the terms alone counts each query term over the whole corpus. So
   every phrase knows its terms from the rarest on.
2. In each shard the phrases whose rarest term it has are looked up there. The
   places of the rarest term, less its offset in the phrase, are intersected with
   those of the next terms, less theirs; what is left are exact occurrences.
   With `within`, terms follow each other in order, spread over at most that many
   words, the nearest place of each taken from the rarest place outwards.

The driver holds one block at a time. What a block broadcasts is its distinct
terms and, for each window, its terms, offsets and items: under 16 bytes for
each byte of text, 64 MB in all. With several blocks, the parts of a document
meet by its place in the index.

Defined results: a null or empty text has no words, and is never hit; a null or
empty item has no window; an item of fewer than `window` words is one window;
items with equal ids count once in `items`; repeated documents give repeated
rows; texts are read whole; columns other than the id and the text are unused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Fixed value: a word, after A-Z are lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WINDOW = 10
#: Bytes of item text in a block of queries, words in a shard, and starts that are intersected at a time.
BLOCK_BYTES, SHARD_WORDS, STARTS = 4_000_000, 16_384, 1 << 20


def words(text: str | None) -> list[bytes]:
    """The pattern excludes ASCII other than 0-9 and a-z; upper case is folded first. UTF-8 bytes over 0x7F are word bytes."""
    return WORD.findall((text or "").encode().translate(LOWER))


# --- the index


class Shard:
    """Postings of a run of documents: for each term, in order, the sorted word places over all documents end to end.

    One place is left free between documents, so that no phrase spans two.
    """

    def __init__(self, starts: np.ndarray, terms: list[bytes], bounds: np.ndarray, places: np.ndarray):
        self.starts, self.terms, self.bounds, self.places = starts, terms, bounds, places

    @staticmethod
    def build(texts: list[list[bytes]]) -> Shard:
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
        flat = [w for x in texts for w in x]
        terms = sorted(set(flat))
        known = {w: k for k, w in enumerate(terms)}
        ids = np.fromiter((known[w] for w in flat), np.int32, len(flat))
        order = np.argsort(ids.astype(np.uint16) if len(terms) < 1 << 16 else ids, kind="stable")
        place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(starts) - 1)
        return Shard(starts, terms, np.append(0, np.cumsum(np.bincount(ids, minlength=len(terms)))).astype(np.int64), place[order])

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def own(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """For each query term its number in this shard, or -1."""
        out = np.full(len(vocabulary), -1, np.int64)
        for k, w in enumerate(self.terms):
            q = vocabulary.get(w)
            if q is not None:
                out[q] = k
        return out


PACKED = "shard long, starts binary, terms binary, bounds binary, places binary"


def index(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index: shard, ids (of its documents), and the shard's parts as arrays of numbers in bytes."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)), *T.StructType.fromDDL(PACKED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def out(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
            nonlocal number
            s = Shard.build(texts)
            held = pa.concat_arrays(ids)
            number += 1
            parts = (s.starts.tobytes(), b" ".join(s.terms), s.bounds.astype(np.int32).tobytes(), s.places.astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)],
                ["ids", "shard", "starts", "terms", "bounds", "places"],
            )

        ids: list[pa.Array] = []
        texts: list[list[bytes]] = []
        held = 0
        for b in batches:
            begin = 0
            for k, x in enumerate(b.column(1)):
                texts.append(words(x.as_py()))
                held += len(texts[-1])
                if held >= shard_words or len(texts) >= shard_words:
                    yield out([*ids, b.column(0).slice(begin, k + 1 - begin)], texts)
                    ids, texts, held, begin = [], [], 0, k + 1
            if begin < len(b):
                ids.append(b.column(0).slice(begin))
        if texts:
            yield out(ids, texts)

    return scratch.write("postings", docs.select(doc_id, text).mapInArrow(run, kind))


# --- queries


@dataclass
class Phrases:
    """Distinct windows of one length: terms and their offsets, the rarest term first; the items of window k are of[edge[k]:edge[k + 1]]."""

    terms: np.ndarray
    offsets: np.ndarray
    of: np.ndarray
    edge: np.ndarray

    def rarest(self, count: np.ndarray) -> Phrases:
        """Ordered by these counts of the terms, and sorted by the rarest term."""
        order = np.lexsort((self.offsets, count[self.terms]), axis=1)
        terms, offsets = np.take_along_axis(self.terms, order, 1), np.take_along_axis(self.offsets, order, 1)
        by = np.argsort(terms[:, 0], kind="stable")
        size = np.diff(self.edge)[by]
        return Phrases(terms[by], offsets[by], self.of[_ranges(self.edge[by], size)], np.append(0, np.cumsum(size)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    total = np.cumsum(size)
    return np.repeat(start - np.append(0, total[:-1]), size) + np.arange(total[-1] if len(total) else 0)


@dataclass
class Queries:
    """A block of items: its terms, its item ids, and its windows by length."""

    vocabulary: dict[bytes, int]
    items: list[str]
    groups: list[Phrases]

    @staticmethod
    def build(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> Queries:
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by length: windows, and the item of each
        for item, own in items:
            name = names.setdefault(str(item), len(names))
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], np.int32)
            if size := min(window, len(ids)):
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                found.setdefault(size, []).append((windows, np.full(len(windows), name, np.int32)))
        groups = []
        for size, parts in found.items():
            every = np.ascontiguousarray(np.concatenate([x for x, _ in parts]))
            first, which = np.unique(every.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)[1:]
            terms = every[first]
            of = np.unique(which.astype(np.int64) * len(names) + np.concatenate([x for _, x in parts]))  # distinct (window, item)
            edge = np.searchsorted(of, np.arange(len(terms) + 1, dtype=np.int64) * len(names))
            groups.append(Phrases(terms, np.tile(np.arange(size, dtype=np.int16), (len(terms), 1)), (of % len(names)).astype(np.int32), edge))
        return Queries(vocabulary, list(names), groups)

    def ordered(self, count: np.ndarray) -> Queries:
        return Queries(self.vocabulary, self.items, [g.rarest(count) for g in self.groups])


def blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items, as words, in blocks of at most about `block_bytes`; the driver holds one block and one partition's rows at a time."""
    block: list[tuple[object, list[bytes]]] = []
    held = 0
    for row in items.select(item_id, text).toLocalIterator():
        own = words(row[1])
        step = max(window, block_bytes // 8)
        for at in range(0, max(1, len(own) - window + 1), step):
            piece = own[at : at + step + window - 1]
            size = sum(map(len, piece)) + len(piece)
            if held and held + size > block_bytes:
                yield block
                block, held = [], 0
            block.append((row[0], piece))
            held += size
    if block:
        yield block


def term_counts(stored: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each query term occurs in the whole corpus; one number for each term of the block comes back."""
    shared = stored.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = shared.value.get, np.zeros(len(shared.value), np.int64)
        for b in batches:
            for terms, bounds in zip(b.column(0), b.column(1), strict=True):
                found = [(q, k) for k, w in enumerate(terms.as_py().split()) if (q := get(w)) is not None]
                if found:
                    q, k = np.array(found).T
                    total[q] += np.diff(np.frombuffer(bounds.as_buffer(), np.int32))[k]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in stored.select("terms", "bounds").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    shared.unpersist()
    return out


def matches(shard: Shard, q: Queries, within: int | None = None) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of one length, and which of them occur, from which place, to which place (exclusive)."""
    own = shard.own(q.vocabulary)
    top = int(shard.starts[-1]) + 1
    keys = np.repeat(np.arange(len(shard.terms)), np.diff(shard.bounds)) * top + shard.places  # sorted: places by term
    here = np.flatnonzero(own >= 0)
    for g in q.groups:
        # windows whose rarest term is here
        low, high = np.searchsorted(g.terms[:, 0], here), np.searchsorted(g.terms[:, 0], here, "right")
        windows = _ranges(low, high - low)
        windows = windows[(own[g.terms[windows]] >= 0).all(axis=1)]
        sizes = np.diff(shard.bounds)[own[g.terms[windows, 0]]]
        edge = np.cumsum(sizes)
        begin = 0
        while begin < len(windows):
            end = max(begin + 1, int(np.searchsorted(edge, (edge[begin - 1] if begin else 0) + STARTS, "right")))
            w, n = windows[begin:end], sizes[begin:end]
            begin = end
            place = shard.places[_ranges(shard.bounds[own[g.terms[w, 0]]], n)]
            w = np.repeat(w, n)
            if within is None:
                at = place - g.offsets[w, 0]
                ok = at >= 0
                w, at = w[ok], at[ok]
                for k in range(1, g.terms.shape[1]):
                    if not len(w):
                        break
                    want = own[g.terms[w, k]] * top + at + g.offsets[w, k]
                    j = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    ok = keys[j] == want
                    w, at = w[ok], at[ok]
                yield g, w, at, at + g.terms.shape[1]
            else:
                yield g, *_near(shard, g, own, keys, top, w, place, within)


def _near(shard: Shard, g: Phrases, own: np.ndarray, keys: np.ndarray, top: int, w: np.ndarray, place: np.ndarray, within: int) -> tuple[np.ndarray, ...]:
    """From each place of the rarest term, the nearest place of each next term behind, and of each earlier one before."""
    size = g.terms.shape[1]
    in_order = np.argsort(g.offsets, axis=1)
    rows = np.arange(len(w))
    rare = g.offsets[w, 0].astype(np.int64)
    first, last = place.copy(), place.copy()
    ok = np.ones(len(w), bool)
    for step in range(1, size):
        for way in (1, -1):
            k = rare + way * step
            now = ok & (k >= 0) & (k < size)
            r = rows[now]
            term = own[g.terms[w[r], in_order[w[r], k[r]]]]
            if way == 1:
                j = np.searchsorted(keys, term * top + last[r], "right")
                good = j < shard.bounds[term + 1]
                last[r] = shard.places[np.minimum(j, len(keys) - 1)]
            else:
                j = np.searchsorted(keys, term * top + first[r], "left") - 1
                good = j >= shard.bounds[term]
                first[r] = shard.places[np.maximum(j, 0)]
            ok[r] &= good
    ok &= (last - first < within) & (shard.document(first) == shard.document(last))
    return w[ok], first[ok], last[ok] + 1


HITS = "shard long, place int, n_words bigint, hits array<struct<at:bigint,len:bigint>>, items array<string>"


def search(stored: DataFrame, q: Queries, within: int | None = None, every: bool = True) -> DataFrame:
    """Per document: id, its place in the index, n_words, hits (maximal runs of words inside occurrences) and items (ids whose windows occur).

    With every=False only documents with hits come back.
    """
    shared = stored.sparkSession.sparkContext.broadcast(q)  # at most one block, see BLOCK_BYTES

    def answer(shard: Shard) -> Iterator[tuple]:
        block = shared.value
        cover = np.zeros(int(shard.starts[-1]) + 1, np.int64)
        seen: dict[int, set[int]] = {}
        for g, w, at, end in matches(shard, block, within):
            np.add.at(cover, at, 1)
            np.add.at(cover, end, -1)
            for d, k in np.unique(np.stack([shard.document(at), w]), axis=1).T:
                seen.setdefault(int(d), set()).update(g.of[g.edge[k] : g.edge[k + 1]].tolist())
        hit = np.cumsum(cover) > 0
        for d in range(len(shard.starts) - 1) if every else sorted(seen):
            a, b = int(shard.starts[d]), int(shard.starts[d + 1]) - 1
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))) if d in seen else np.zeros(0, np.int64)
            yield d, b - a, [{"at": int(x), "len": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)], sorted(block.items[k] for k in seen.get(d, ()))

    key = stored.schema["ids"].dataType.elementType
    kind = T.StructType([T.StructField("id", key), *T.StructType.fromDDL(HITS).fields])
    span = pa.list_(pa.struct([("at", pa.int64()), ("len", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                ids = b.column(0)[k].values
                number, starts, terms, bounds, places = (b.column(i)[k] for i in range(1, 6))
                shard = Shard(np.frombuffer(starts.as_buffer(), np.int64), terms.as_py().split(), np.frombuffer(bounds.as_buffer(), np.int32).astype(np.int64), np.frombuffer(places.as_buffer(), np.int32).astype(np.int64))
                rows = list(answer(shard))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([number.as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], span), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                    ["id", "shard", "place", "n_words", "hits", "items"],
                )

    return stored.select("ids", "shard", "starts", "terms", "bounds", "places").mapInArrow(run, kind)


def _covered(hits: Column) -> Column:
    """Words in the union of runs that may overlap."""

    def step(acc: Column, h: Column) -> Column:
        end = h["at"] + h["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(h["at"], acc["end"]))).cast("long").alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda a: a["n"])


def find(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, window: int = WINDOW, within: int | None = None, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: id, n_words, hits, items, n_hit. With `within`, occurrences are in-order matches spread over at most that many words.

    Each block's answers are written, so the driver and the executors hold one block at a time.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    stored = index(docs, scratch, doc_id, text, shard_words)
    parts: list[DataFrame] = []
    for block in blocks(items, item_id, item_text, block_bytes, window):
        q = Queries.build(block, window)
        del block
        q = q.ordered(term_counts(stored, q.vocabulary))
        parts.append(scratch.write(f"part{len(parts)}", search(stored, q, within, every=not parts)))
        del q
    if not parts:
        parts = [search(stored, Queries({}, [], []))]
    found = parts[0]
    if len(parts) > 1:
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        found = every.groupBy("shard", "place").agg(
            F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.select(F.col("id").alias(doc_id), "n_words", "hits", "items").withColumn("n_hit", _covered(F.col("hits")))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
