import hashlib
import random
import re

import numpy as np

from textmill.llm import positional_index as pi
from textmill.llm import queries

from ..conftest import SMALL


def brute(docs, items, window=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    phrases = [(str(i), w[k : k + window]) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for _, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["The", "an", "über", "x1", "of-the", "don't", "été"]) for _ in range(n))
    items = [(1, text(30)), (10, text(12)), (2, text(4)), (3, "Lone"), (4, ""), (5, None), (1, text(11)), (None, text(15))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(50 + i, text(5) + " " + (t or "").upper() + ", " + text(5)) for i, (_, t) in enumerate(items)]
    return [*docs, (90, None), (91, ""), (None, items[0][1]), (50, docs[40][1])], items


def test_find(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((repr(k[0]), *r) for k, r in zip(docs, brute(docs, items), strict=True))
    for block, size in ((pi.BLOCK_BYTES, pi.SHARD_WORDS), (60, 7)):  # in one block, and in many; in few shards, and in many
        got = pi.digest(pi.find(d, b, block_bytes=block, shard_words=size))
        assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got.collect()) == want
    assert pi.digest(pi.find(d, b.limit(0))).filter("contaminated").count() == 0
    assert pi.find(d.limit(0), b).count() == 0


def shard(*texts):
    return pi.Shard.build([t.split() for t in texts])


def starts(s, phrase, within=None):
    q = pi.Queries.build([(1, phrase.split())])
    q = q.ordered(np.arange(len(q.vocabulary))[::-1])
    return [(int(a), int(b)) for _, _, at, end in pi.matches(s, q, within) for a, b in sorted(zip(at, end, strict=True))]


def test_shards_do_not_join_documents():
    assert starts(shard(b"x a", b"b", b"a b"), b"a b") == [(5, 7)]


def test_proximity():
    s = shard(b"a x b x x c a b c", b"a x b")
    assert starts(s, b"a b c", 3) == [(6, 9)]
    assert sorted(set(starts(s, b"a b c", 6))) == [(0, 6), (6, 9)]
    assert starts(s, b"a b", 3) == [(0, 3), (6, 8), (10, 13)]
    assert starts(shard(b"x a b"), b"a b", 6) == [(1, 3)]  # the end of a shard
    assert starts(shard(b"a b c d e f g h"), b"a b", 6) == [(0, 2)]
    assert starts(shard(b"a", b"b"), b"a b", 6) == []


def near(text, phrase, within):
    """Spans of the tightest in-order matches around each place of each term of the phrase, by trying all places."""
    w, out = text.split(), set()
    for rare in range(len(phrase)):
        spans = set()
        for p in (i for i, x in enumerate(w) if x == phrase[rare]):
            last = first = p
            for t in phrase[rare + 1 :]:
                last = next((i for i in range(last + 1, len(w)) if w[i] == t), 10**6)
            for t in reversed(phrase[:rare]):
                first = next((i for i in range(first - 1, -1, -1) if w[i] == t), -(10**6))
            if last - first < within:
                spans.add((first, last + 1))
        out.add(frozenset(spans))
    return out


def test_proximity_of_random_texts():
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 25)))
        phrase = rng.sample("abcd", rng.randint(1, 4))
        got = starts(shard(text.encode()), " ".join(phrase).encode(), 6)
        assert frozenset(got) in near(text, phrase, 6)  # which term is the rarest decides from where spans are drawn


def test_find_with_proximity(spark):
    docs = [(1, "x a b"), (2, "a x x b and a x b"), (3, "b a"), (4, None), (5, "a " + "x " * 9 + "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = {r["doc_id"]: ([tuple(h) for h in r["hits"]], r["n_hit"]) for r in pi.find(d, b, within=4).collect()}
    assert got == {1: ([(1, 2)], 2), 2: ([(0, 4), (5, 3)], 7), 3: ([], 0), 4: ([], 0), 5: ([], 0)}


def test_proximity_query_finds_what_the_exact_one_finds(spark):
    """And more: an occurrence is a match spread over just its own words."""
    rows = lambda d: {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in d.collect()}
    exact, wide = rows(queries.op4_decontamination(spark, SMALL)), rows(queries.op4_proximity(spark, SMALL))
    assert len(exact) == len(wide) and any(r[1] for r in exact.values())
    assert all(wide[k][0] == r[0] and wide[k][1] >= r[1] and wide[k][2] >= r[2] for k, r in exact.items())


def test_long_texts_and_long_items(spark):
    """A document over many shards' size, an item over many blocks' size."""
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(9000))
    w = long.split()
    docs = [(1, long), (2, " ".join(w[400:420]) + " z " + " ".join(w[8000:8009])), (3, " ".join(w[5000:7000]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, long)], "item_id long, text string")
    for size in (500, pi.SHARD_WORDS):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in pi.find(d, b, block_bytes=3000, shard_words=size).collect()}
        assert got == {1: (9000, 9000, ["7"]), 2: (30, 20, ["7"]), 3: (2000, 2000, ["7"])}
