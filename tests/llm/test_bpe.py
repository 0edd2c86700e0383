import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe._codec(PATH, public_tokenizers.PATTERN)
RANKS = bpe.read_ranks(open(PATH, "rb").read())
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = st.one_of(st.text(max_size=60), st.text("aàb c'éstrelvdm\n\t 12’漢🙂!?._\x1c ²", max_size=80))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encodes_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = CODEC.encode(text)
    assert ids == KNOWN.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 80), st.integers(0, 80))
def test_appends_and_edits(text, new, a, b):
    text, new = (x.encode("utf-8", "replace").decode() for x in (text, new))
    held = bpe.EditableText(CODEC, text)
    held.append(new)
    assert held.ids() == KNOWN.encode_ordinary(text + new)
    a, b = sorted((min(a, len(held.text)), min(b, len(held.text))))
    held.replace(a, b, new)
    assert held.ids() == KNOWN.encode_ordinary(held.text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=20), st.integers(0, 80), st.integers(0, 80))
def test_prefix_table(data, new, a, b):
    table = bpe.PrefixTable(CODEC.v, data)
    grown = bpe.PrefixTable(CODEC.v)
    for x in data:
        grown.append(bytes([x]))
    assert grown.last == table.last
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    table.replace(a, b, new)
    assert table.last == bpe.PrefixTable(CODEC.v, bytes(table.data)).last


def test_an_edit_is_local():
    table = bpe.PrefixTable(CODEC.v, b"the end of " * 500)
    assert table.replace(2000, 2003, b"xyz") < 200


def test_an_edit_of_a_long_piece_is_local(monkeypatch):
    import random

    rng = random.Random(3)
    text = "".join(rng.choice("abcdeé") for _ in range(20_000))
    held = bpe.EditableText(CODEC, text)
    made = [0]
    entry = bpe.PrefixTable._entry
    monkeypatch.setattr(bpe.PrefixTable, "_entry", lambda self, end: (made.__setitem__(0, made[0] + 1), entry(self, end))[1])
    for _ in range(30):
        made[0] = 0
        a = rng.randint(0, len(held.text))
        held.replace(a, min(len(held.text), a + rng.randint(0, 4)), "".join(rng.choice("abxé") for _ in range(rng.randint(0, 4))))
        assert made[0] < 400
        assert held.ids() == KNOWN.encode_ordinary(held.text)
    held.replace(500, 501, " ")  # the piece falls in two
    held.replace(500, 501, "")
    held.append("more")
    assert held.ids() == KNOWN.encode_ordinary(held.text)


def test_long_runs():
    for text in ("a" * 5000, " " * 5000, "ab\n" * 3000, "é" * 3000):
        assert CODEC.encode(text) == KNOWN.encode_ordinary(text)


def test_query_rows(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello wörld", "x"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_digests(df, PATH, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((repr(i), len(KNOWN.encode_ordinary(t or "")), sha(",".join(map(str, KNOWN.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((repr(r[0]), r[1], r[2], r[3]) for r in got) == want
    ids = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(ids, PATH, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.encode_digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
