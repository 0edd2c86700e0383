"""The pipeline against a plain version of its stages."""

import hashlib
import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from textmill.llm import queries  # noqa: E402

from .test_bpe import KNOWN  # noqa: E402
from .test_near_dedup import brute as classes  # noqa: E402
from .test_positional_index import brute as contaminated  # noqa: E402


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(rng.randint(20, 150)) for _ in range(30)]
    passage, item = text(60), text(40)
    texts += [texts[0], texts[1] + " end", None, "", "few words", "a b c d e " * 30, passage + " " + text(30), text(30) + " " + passage + " " + text(9)]
    texts += [text(40) + " " + " ".join(item.split()[5:25]) + " " + text(40), ("ab## cd$$ " * 3 + text(20)).strip()]
    return texts, [(7, item), (8, text(6))]


def plain(texts, items):
    from .test_native_operators import counts

    kept = []
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = counts(t)
        stop = sum(w.lower() in set(queries.quality_rules.STOP_WORDS) for w in (t or "").split())
        lines = len([x for x in (t or "").split("\n") if x.strip()])
        if n >= 10 and 100 * repeat <= 20 * n and 2 * n <= chars <= 14 * n and symbols <= 0.3 * n and dup <= 0.5 * lines and (n < 40 or stop >= 0.01 * n):
            kept.append((i, t))
    first = classes([t for _, t in kept])
    kept = [k for j, k in enumerate(kept) if first[j] == j]
    data = [t.encode() for _, t in kept]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    cut = []
    for (i, _), b in zip(kept, data, strict=True):
        hit = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        cut.append((i, bytes(x for x, h in zip(b, hit, strict=True) if not h).decode(errors="replace")))
    clean = [k for k, r in zip(cut, contaminated(cut, items), strict=True) if not r[4]]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(i, len(ids := KNOWN.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in clean]


def test_pipeline(spark, tmp_path):
    texts, items = corpus()
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain(texts, items)
    assert got == sorted(want) and 20 < len(want) < len(texts) - 6


def test_columns_of_any_name_and_long_texts(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join("the" if i % 20 == 0 else f"w{rng.randrange(10**6)}" for i in range(40_000))
    rows = [(1, long, "en", "s", 3, 1, 2, 3, 4), (2, "the " + " ".join(f"v{i}" for i in range(60)), None, None, None, 5, 6, 7, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, key int, row int, kept int")
    spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and sorted((r["doc_id"], r["text"], *tuple(r)[5:]) for r in out.collect()) == [(r[0], r[1], *r[5:]) for r in rows]


def test_stages_keep_the_columns(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == 0
