"""Operator 1: byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its
encoding. `PrefixTable` keeps that token for every prefix, so that

* the encoding is read off backwards from the end,
* appending bytes extends the table and never revisits what is there,
* an edit recomputes from the edit until the table falls in step with the old
  one again, which happens as soon as as many entries agree as the longest
  token has bytes.

A token `t` may follow the token `p` that ends the shorter prefix if merging
`p + t` by rank stops at exactly these two tokens; `Vocabulary.follows` decides
this by walking down the merge trees on both sides of the border.

Defined results: a null text counts as empty; an empty text has no ids, and the
digests are those of the empty string; repeated rows give repeated results;
other columns are left alone unless asked for. Text of any length is encoded
whole, in time linear in its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept in a worker's cache, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS, CACHE_BORDERS = 400_000, 48, 1_000_000

#: Bytes from which a piece of an edited text keeps its prefix table.
LONG_PIECE = 256

#: Letters below U+0250, and what neither they nor ASCII (but for U+001C-1F) cover. A text without the latter is cut by
#: a plainer pattern with the standard library, which cuts it as the full pattern would, in half the time.
_LETTERS, _SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", " \\t\\n\\x0b\\x0c\\r"
ODD = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTERS}]")
QUICK = {
    public_tokenizers.PATTERN: re.compile(
        f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    ).findall
}


class Vocabulary:
    """Ranks of byte strings, with the merge that makes each of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.size = max(ranks.values()) + 1
        self.text: list[bytes] = [b""] * self.size
        for t, r in ranks.items():
            self.text[r] = t
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and (parts := self._last_merge(t, r)):
                self.halves[r] = parts
                self.joined[parts] = r
                self.usable[t] = r
        self.longest = max(map(len, self.usable))
        #: Tokens by byte: a node has a node for each next byte, and the token that ends here under -1.
        self.tree: dict = {}
        for t, r in self.usable.items():
            node = self.tree
            for x in t:
                node = node.setdefault(x, {})
            node[-1] = r
        self.known: dict[int, bool] = {}  # answers of follows

    def _last_merge(self, t: bytes, r: int) -> tuple[int, int] | None:
        """The two tokens that are left when all merges below rank r are done; None if they aren't two."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            rank, i = min((self.rank.get(parts[i] + parts[i + 1], r), i) for i in range(len(parts) - 1))
            if rank >= r:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def follows(self, p: int, t: int) -> bool:
        """Whether merging the bytes of p and t ends in p, t.

        The border survives if no merge across it would have come first. Going
        back in time, the half that was made last is undone, and a merge across
        the border counts if it ranks below everything undone so far. At equal
        rank the left one is made first.
        """
        known = self.known.get(p << 32 | t)
        if known is not None:
            return known
        a, b, free = p, t, self.size
        ok = True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < free:
                ok = False
                break
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                break
            if right is None or (left is not None and a > b):
                free, a = min(free, a), left[1]
            else:
                free, b = min(free, b + 1), right[0]
        if len(self.known) > CACHE_BORDERS:
            self.known.clear()
        self.known[p << 32 | t] = ok
        return ok


class PrefixTable:
    """For each prefix of `data`, the token that ends its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = bytearray()
        self.last: list[int] = [-1]
        if data:
            self.append(data)

    def _entry(self, end: int) -> int:
        data, last, usable, follows, text = self.data, self.last, self.v.usable, self.v.follows, self.v.text
        for start in range(max(0, end - self.v.longest), end):
            t = usable.get(bytes(data[start:end]))
            if t is not None and (start == 0 or follows(last[start], t)):
                return t
        raise ValueError(f"no token ends at byte {end}: {text[0]!r}")

    def append(self, more: bytes) -> None:
        """Exact: entries of the shorter prefixes never change."""
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._entry(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many entries were computed."""
        old_last, shift = self.last, len(new) - (stop - start)
        self.data[start:stop] = new
        self.last = old_last[: start + 1]
        agree = done = 0
        for end in range(start + 1, len(self.data) + 1):
            entry = self._entry(end)
            self.last.append(entry)
            done += 1
            agree = agree + 1 if end >= start + len(new) and entry == old_last[end - shift] else 0
            if agree >= self.v.longest:
                self.last += old_last[end - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.v.text[t])
        return out[::-1]


class Codec:
    """Encodes each match of a pattern separately; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.v = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self._quick = QUICK.get(pattern)
        self._seen: dict[str, tuple[int, str, bytes]] = {}

    def forget(self) -> None:
        """Empties the caches; a worker that waits for its next task holds the vocabulary only."""
        self._seen.clear()
        self.v.known.clear()

    def split(self, text: str) -> list[str]:
        if self._quick and not ODD.search(text):
            return self._quick(text)
        return self.pattern.findall(text)

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.v.rank.get(piece)  # a piece that is a token is that token
        if whole is not None:
            return [whole]
        # As PrefixTable, but from each start forward, as far as some token goes on.
        n, last, tree = len(piece), [-1] * (len(piece) + 1), self.v.tree
        known, follows = self.v.known, self.v.follows
        for start in range(n):
            node, p = tree, last[start]
            for end in range(start, n):
                node = node.get(piece[end])
                if node is None:
                    break
                t = node.get(-1)
                if t is None or last[end + 1] >= 0:
                    continue
                if start:
                    ok = known.get(p << 32 | t)
                    if not (follows(p, t) if ok is None else ok):
                        continue
                last[end + 1] = t
        out, text = [], self.v.text
        while n:
            out.append(last[n])
            n -= len(text[last[n]])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.split(text or "") for i in self.piece_ids(p.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.text.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and the bytes they decode to."""
        found = self._seen.get(piece)
        if found is None:
            ids = self.piece_ids(piece.encode())
            found = len(ids), ",".join(map(str, ids)), self.decode(ids)
            if len(piece) <= CACHE_CHARS:
                if len(self._seen) >= CACHE_PIECES:
                    self._seen.clear()
                self._seen[piece] = found
        return found

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as text, sha256 of the decoded bytes."""
        seen, pieces = self._seen, self.split(text or "")
        got = [seen.get(p) or self._piece(p) for p in pieces]
        n, ids, data = zip(*got, strict=True) if got else ((), (), ())
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


class EditableText:
    """A text that is kept encoded while it grows and is edited.

    Only pieces near the change are cut and encoded anew. A piece depends on at
    most two pieces before it (a contraction, or the white space before a word).
    A long piece keeps its prefix table, so that an edit inside it computes the
    entries near the edit only.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.starts: list[int] = []
        self.tables: list[list[int] | PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        from bisect import bisect_right

        keep = max(0, bisect_right(self.starts, start) - 3)
        begin = self.starts[keep] if keep < len(self.starts) else 0
        old_starts, old_tables, shift = self.starts, self.tables, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        known = {s + shift: k for k, s in enumerate(old_starts) if s >= stop}
        self.starts, self.tables = old_starts[:keep], old_tables[:keep]
        for m in self.codec.pattern.finditer(self.text, begin):
            k = known.get(m.start())
            if k is not None and m.start() >= start + len(new):
                self.starts += [s + shift for s in old_starts[k:]]
                self.tables += old_tables[k:]
                return
            k = bisect_right(old_starts, m.start()) - 1
            old = old_tables[k] if m.start() <= start and k >= 0 and old_starts[k] == m.start() else None
            self.starts.append(m.start())
            self.tables.append(self._table(m[0].encode(), old))

    def _table(self, piece: bytes, old: list[int] | PrefixTable | None) -> list[int] | PrefixTable:
        if len(piece) < LONG_PIECE or piece in self.codec.v.rank:
            return self.codec.piece_ids(piece)
        if not isinstance(old, PrefixTable):
            return PrefixTable(self.codec.v, piece)
        n = min(len(piece), len(old.data))
        a, b = (np.frombuffer(x, np.uint8) for x in (bytes(old.data), piece))
        differ = np.flatnonzero(a[:n] != b[:n])
        same = int(differ[0]) if len(differ) else n  # bytes at the start
        differ = np.flatnonzero(a[len(a) - n + same :] != b[len(b) - n + same :])
        tail = n - same - 1 - int(differ[-1]) if len(differ) else n - same  # and at the end, besides
        old.replace(same, len(a) - tail, piece[same : len(b) - tail])
        return old

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in (t.ids() if isinstance(t, PrefixTable) else t)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank, on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(read_ranks(f.read()), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """Adds `to` (array of ids). The vocabulary file is read on each executor, as part of its Python environment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            ids = pa.array((codec.encode(x) for x in b.column(text).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, to])
        codec.forget()

    return df.mapInArrow(run, df.drop(to).withColumn(to, F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds `to` (binary); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            data = pa.array((codec.decode(x or ()) for x in b.column(ids).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, data], [*b.schema.names, to])

    return df.mapInArrow(run, df.drop(to).withColumn(to, F.lit(None).cast("binary")).schema)


def encode_digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 — encoded and decoded in one pass, so that ids need not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            got = [codec.digests(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))],
                [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
