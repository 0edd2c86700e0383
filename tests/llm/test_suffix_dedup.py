import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from textmill.llm import suffix_dedup, suffix_sort


def test_sort_finds_repeats():
    rng = np.random.default_rng(1)
    for n, letters, depth in ((900, 2, 10), (2000, 2, 20), (3000, 1, 50), (4000, 26, 8)):
        for bucket in (64, 1 << 16):
            t = rng.integers(97, 97 + letters, n).astype(np.uint8)
            t[500:700] = t[:200]
            at = np.flatnonzero(rng.random(n - depth + 1) < 0.8)
            seen = Counter(t[i : i + depth].tobytes() for i in at)
            want = [seen[t[i : i + depth].tobytes()] > 1 for i in at]
            assert suffix_sort.repeated(t, at, depth, bucket).tolist() == want


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 9000).astype(np.uint8)
    starts = np.array([0, 4000, 4000, 9000])
    windows = lambda runs: {(d, s + k) for d, s, m in zip(*runs[:3], strict=True) for k in range(m)}
    whole = windows(suffix_dedup.anchor_runs(data, starts))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert windows(suffix_dedup.anchor_runs(data, starts)) == whole == {(0, i) for i in range(3801)} | {(2, i) for i in range(4801)}


def brute(texts, depth=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                hit[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = text(330), text(201)
    texts = [None, "", "short", "z" * 199, "y" * 200, "x" * 201, "w" * 900, text(2000), text(120) + passage + text(90), passage + text(40), text(60) + passage[30:290] + text(10), passage, line, line, text(20) + line[:199] + text(20)]
    near = text(700)
    for _ in range(12):  # one passage with many different neighbours
        texts.append(text(rng.randint(0, 150)) + passage[:250] + text(rng.randint(0, 150)))
        k = rng.randrange(600)
        texts.append(near[:k] + "#" + near[k + 1 :])
    return texts


@pytest.mark.parametrize(("hot", "bits"), [(1_000, 64), (2, 64), (1_000, 3), (2, 3)])
def test_removes_what_repeats(spark, hot, bits):
    """With hot buckets, and with hashes that collide all the time: the sort decides."""
    texts = corpus()
    df = spark.createDataFrame([(i, t, "k", "id") for i, t in enumerate(texts)], "doc_id long, text string, k1 string, id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df, hot_blocks=hot, bits=bits).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("hot", [1_000, 1])
def test_random_texts_of_few_letters(spark, hot):
    rng = random.Random(hot)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 260))) for _ in range(6)] + ["a" * 230, "ab" * 150]
    texts = ["".join(rng.choice(parts)[rng.randint(0, 50) :] for _ in range(rng.randint(0, 5))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df, hot_blocks=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_columns_of_any_name(spark):
    t = "".join(random.Random(5).choice("abc") for _ in range(260))
    df = spark.createDataFrame([(1, t + "x", 1, 2, 3, 4), (2, t + "y", 5, 6, 7, 8)], "doc_id long, text string, _k1 int, _k2 int, _kept int, KEY int")
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "x", 1, 2, 3, 4), (2, "y", 5, 6, 7, 8)]


def test_repeated_rows_and_null_ids(spark):
    t = "".join(random.Random(1).choice("abc") for _ in range(300))
    rows = [(1, t), (1, t), (None, "q" + t[:200]), (None, None), (2, "unique")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(df).collect())
    assert got == [(0, 0), (6, 0), (201, 200), (300, 300), (300, 300)]
    assert sorted(r["text"] or "" for r in suffix_dedup.remove_repeats(df).collect()) == ["", "", "", "q", "unique"]
    assert suffix_dedup.digest(df.limit(0)).count() == 0


def test_hot_buckets_are_not_dealt_out_window_by_window(spark):
    """A passage with many neighbours gives a few pieces a document, and the same bytes go."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(420)
    texts = [text(rng.randint(50, 150)) + passage + text(rng.randint(50, 150)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df, hot_blocks=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    ranges = suffix_dedup.repeated_ranges(suffix_dedup.row_keys(df, "doc_id", "text"), suffix_dedup.Scratch(spark, "test"), hot_blocks=10)
    assert ranges.count() < 40 * len(texts)  # 221 windows of each are repeated
