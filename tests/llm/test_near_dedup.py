import random
from collections import Counter

import numpy as np
import pytest

from textmill.llm import bagminhash, near_dedup
from textmill.llm.common import Scratch
from textmill.llm.components import components


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for high in (2, 9, 300):
        x = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = rng.integers(0, high, 200), rng.integers(0, high, 200)
        b = np.where(rng.random(200) < 0.7, a, b)
        sets = [(k, w > 0, w) for k, w in enumerate((a, b))]
        owner = np.concatenate([np.full(ok.sum(), k) for k, ok, _ in sets])
        s = bagminhash.signatures(owner, np.concatenate([x[ok] for _, ok, _ in sets]), np.concatenate([w[ok] for _, ok, w in sets]), 2, 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(texts):
    """class of each text: the least index linked to it, directly or not."""
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            n = sum((a & bags[j]).values())
            if a and bags[j] and n >= 0.8 * sum((a | bags[j]).values()) - 1e-9:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def test_similarity_is_exact():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(2))
        x, y = bag(a), bag(b)
        assert near_dedup.similarity(near_dedup.weighted(a), near_dedup.weighted(b)) == pytest.approx(sum((x & y).values()) / sum((x | y).values()))


def corpus():
    """Clusters of edited copies whose similarities lie on both sides of 0.8, exact copies, and the odd cases."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " ", "one", "one", "two words", "x " * 400, "x " * 330, "y " * 4]
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, *texts[9:14]]


def test_classes(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    kept = sorted(r["doc_id"] for r in near_dedup.one_of_each(df).collect())
    assert kept == sorted(set(brute(texts)))


def test_ties_nulls_and_extra_columns(spark):
    t = " ".join(map(str, range(30)))
    rows = [(None, t, 1), (None, t, 1), (5, t, 2), (5, t, 2), (7, "", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(repr, ((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(df).collect())))
    assert got == sorted(map(repr, [(None, 5, 4)] * 2 + [(5, 5, 4)] * 2 + [(7, 7, 1), (None, None, 1)]))
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns and sorted(r["node"] for r in left.collect()) == [2, 3, 4]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_many_texts_below_the_threshold(spark):
    """A group whose members share buckets, but of which only some pairs are linked."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for k in rng.sample(range(150), rng.choice([1, 3, 3, 4, 4, 4])):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    want = brute(texts)
    assert 1 < len(set(want)) < 300 and [got[i] for i in range(300)] == want


def test_a_very_long_text(spark):
    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(long.split()[:30_000])), (4, "the " * 60_000), (5, "the " * 59_000)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_nodes_of_one_name(spark):
    rows = [(1, 1, 7, 1), (2, 2, 7, 2), (3, 3, 7, 1), (4, 4, 8, 5)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, node long, more long")
    got = {r["k1"]: r["node"] for r in near_dedup.named_apart(df, Scratch(spark, "t")).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3 and got[4] == 8
    assert {r["node"] for r in near_dedup.named_apart(df.filter("more = 1"), Scratch(spark, "t")).collect()} == {7}


def test_columns_of_any_name(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, t, 1, 2, 3, 4), (2, t + " x", 5, 6, 7, 8)], "doc_id long, text string, _k1 int, key int, class int, Spot int")
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns and [tuple(r)[2:] for r in left.collect()] == [(1, 2, 3, 4)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {v: root(v) for e in edges for v in e if root(v) != v}
