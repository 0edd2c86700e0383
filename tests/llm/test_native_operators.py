import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.llm import licenses, line_dedup, quality_rules, queries, revisits

from ..conftest import SMALL
from ..test_catalogue import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


# --- quality rules


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    rng = random.Random(6)
    texts = [None, "", "  \n\t ", "a", "x " * 5000, "é\x0b\x0c# ü|\r\n", "a b c d e a b c d e", "\n".join(["same line"] * 9 + ["other"]), "a\x85b\xa0c"]
    texts += ["".join(rng.choice("ab \n#!\t") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(df).collect()}
    for i, t in enumerate(texts):
        want = counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.apply_rules(df.limit(0)).count() == 0
    assert quality_rules.apply_rules(df).filter("kept").count() == sum(r["kept"] for r in got.values())


def test_rules_are_data(spark):
    words = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, "the " + words), (2, words + " #" * 30), (3, words)], "doc_id long, text string")
    rule = (quality_rules.Rule("symbols", "n_symbols", "n_words", None, 0.3),)
    assert {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(df, rule).collect()} == {1: True, 2: False, 3: True}
    assert {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(df).collect()} == {1: True, 2: False, 3: False}


def test_languages_and_scripts(spark):
    russian = "и это было давно в городе на реке где жили люди " * 6
    texts = [" ".join(f"{w}{i}" if len(w) > 3 else w for i, w in enumerate(russian.split())), " ".join("桜の花が咲く季節になると人々は公園へ出かける" + chr(0x4E00 + i) for i in range(45)), " ".join("x" * 20 + str(i) for i in range(45))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply_rules(df).collect()} == {0: (False, True), 1: (False, True), 2: (False, False)}


def test_columns_named_like_inner_ones(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], "doc_id long, text string, t int, words int, _t int, LINES int")
    got = quality_rules.apply_rules(df)
    assert got.columns[:6] == df.columns and tuple(got.first())[:6] == (1, "a b", 1, 2, 3, 4)


# --- line dedup


def test_lines(spark):
    same = "One line of  more words"
    rows = [(3, f"{same}\nshort\nshort"), (1, f"x\n{same.upper()}\ny\n one LINE of more words"), (2, same), (None, f"tail\n{same}"), (4, None), (5, ""), (6, "\n\n"), (1, f"x\n{same.upper()}\ny\n one LINE of more words")]
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], "doc_id long, text string, kept string, rank long, key long")
    got = sorted((repr(r["doc_id"]), r["n_units"], r["n_removed"], r["kept"], [tuple(s) for s in r["spans"]]) for r in line_dedup.dedup(df, by=line_dedup.LINE, least=1).collect())
    one = ("1", 4, 1, f"x\n{same.upper()}\ny\n", [(len(same) + 5 - 1, len(same) + 4 + 23)])
    assert [g[:4] for g in got] == sorted([one[:4], one[:4], ("2", 1, 1, ""), ("3", 3, 2, "short\n"), ("4", 0, 0, ""), ("5", 0, 0, ""), ("6", 0, 0, "\n\n"), ("None", 2, 1, "tail\n")])
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_lines_without_spaces(spark):
    cjk, rights = "一行没有空格的文字" * 9, "All rights reserved."
    rows = [("b1", f"{rights}\n{cjk}\n \nx"), ("b2", f"new\n{cjk}\nALL  rights reserved."), ("b3", f"x\n{rights}"), ("b4", "y\ny\n\ny")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["kept"]) for r in line_dedup.dedup(df, by=line_dedup.LINE, least=1).collect()}
    assert got == {"b1": (3, 0, rows[0][1]), "b2": (3, 2, "new\n"), "b3": (2, 2, ""), "b4": (3, 2, "y\n\n")}


def test_paragraphs():
    text = "a b c d e\nf\n\ng h i j k\n"
    assert [p[:2] for p in line_dedup.pieces(text, line_dedup.PARAGRAPH)] == [(0, 13), (13, 23)]


def plain_cut(rows, by, least):
    """Every unit against every earlier one, as strings."""
    units, out = [], {}
    for doc, text in rows:
        parts = [(m.start(), m.end(), " ".join(m[0].lower().split())) for m in re.finditer(by, text or "")]
        parts = [p for p in parts if p[2]]
        total = sum(len(p[2]) for p in parts)
        for a in range(len(parts)):
            b, size = a, len(parts[a][2])
            while size < least and b + 1 < len(parts):
                b += 1
                size += len(parts[b][2])
            if size >= least or (a == 0 and total < least):
                units.append((doc, a, parts[a][0], parts[b][1], " ".join(p[2] for p in parts[a : b + 1])))
        out[doc] = set()
    for u in units:
        if any(v[4] == u[4] and v[:2] < u[:2] for v in units):
            out[u[0]] |= set(range(u[2], u[3]))
    return {doc: "".join(c for i, c in enumerate(text or "") if i not in out[doc]) for doc, text in rows}


@pytest.mark.parametrize("seed", range(4))
def test_passages_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(["ab, cd.", "e", "fg!", "\n", "hi"]) for _ in range(rng.randint(4, 12))) for _ in range(4)]
    rows = [(i, "".join(rng.choice([*shared, " own%d. " % rng.randint(0, 50), "x,", "\n", ""]) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(40, None), (41, "ab " * 3000), (42, "ab " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for by, least in ((line_dedup.CLAUSE, 12), (line_dedup.LINE, 1), (line_dedup.CLAUSE, 1)):
        got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(df, by=by, least=least).collect()}
        assert got == plain_cut(rows, by, least)


def test_a_passage_is_found_in_the_middle_of_a_line(spark):
    passage = " ".join(f"Here is sentence {i} of a passage, which has clauses." for i in range(8))
    rows = [(1, f"one beginning {passage} one end"), (2, "another text altogether. The. Of. And."), (3, f"the third goes on and on {passage} until it stops. The. Of."), (4, "The. Of. And. It.")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[4] == rows[3][1]
    assert got[3].startswith("the third goes on and on Here is sentence 0") and got[3].endswith(" until it stops. The. Of.") and len(got[3]) < 120


# --- revisits


def test_canonical(spark):
    cases = {"http://WWW.h.com:80/a/?b=2&a=1&utm_x=3#f": "h.com/a?a=1&b=2", "https://h.com": "h.com", "https://h.com/?ref=x": "h.com", " h.com/p ": "h.com/p"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r[0] for r in df.select(revisits.canonical(F.col("u"))).collect()] == list(cases.values())


RECORD = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, status string"


def plain_resolve(rows):
    out = []
    key = lambda r: (r[2], r[0] is not None, r[0] or 0)
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and None not in (x[1], x[2], r[1], r[2]) and x[1] == r[1] and key(x) < key(r)]
        best = max(before, key=key, default=None)
        if best is None:
            out.append((r[0], None, "missing"))
            continue
        pairs = [(a.removeprefix("W/"), b.removeprefix("W/")) if a and b and a.endswith('"') else (a, b) for a, b in zip(r[4:7], best[4:7], strict=True)]
        ok = next((a == b for a, b in pairs if a is not None and b is not None), False)
        out.append((r[0], best[0], "resolved" if ok else "mismatch"))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 4, 64, None])
def test_as_of(spark, parts):
    rng = random.Random(parts)
    tags = [None, '"a"', 'W/"a"', '"b"']
    rows = [(i, rng.choice(["h/a", "h/a", "h/a", "h/b", None]), rng.choice([None, *range(60)]), rng.choice(["response", "revisit"]), rng.choice(tags), rng.choice([None, "m", "n"]), rng.choice([None, "d", "e"]), {"etag": "x"}, "old") for i in range(300)]
    got = revisits.resolve(spark.createDataFrame(rows, RECORD), parts).collect()
    assert sorted(repr((r["record_id"], r["response_id"], r["status"])) for r in got) == plain_resolve(rows)


def test_merged_headers(spark):
    rows = [(1, "h", 1, "response", '"a"', None, None, {"server": "s", "date": "1", "content-type": "t"}, ""), (2, "h", 2, "revisit", '"a"', None, None, {"server": "x", "date": "2"}, ""), (3, "h", 3, "revisit", '"a"', None, None, None, "")]
    got = {r["record_id"]: r["merged_headers"] for r in revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {2: {"server": "s", "content-type": "t", "date": "2"}, 3: {"server": "s", "date": "1", "content-type": "t"}}
    assert revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_one_url_at_one_time(spark):
    """All records of one URL, most of them at one time: parts split them by id."""
    rows = [(i, "h/a", 5 if i < 280 else 6, "response" if i % 9 == 0 else "revisit", f'"{i}"', None, "d", None, "") for i in range(300)]
    got = revisits.resolve(spark.createDataFrame(rows, RECORD), 16).collect()
    assert {r["record_id"]: r["response_id"] for r in got} == {i: i // 9 * 9 for i in range(300) if i % 9}


def test_revisit_columns_of_any_name(spark):
    rows = [(1, "h", 1, "response", '"a"', None, None, None, "", 1, 2, 3), (2, "h", 2, "revisit", '"a"', None, None, None, "", 4, 5, 6)]
    got = revisits.resolve(spark.createDataFrame(rows, RECORD + ", _b int, u int, p int"))
    assert [(r["_b"], r["u"], r["p"], r["response_id"], r["status"]) for r in got.collect()] == [(4, 5, 6, 1, "resolved")]


# --- licences


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, mit, "/r/LICENSE"), (2, "code", "/r/a/b/c.txt"), (3, apache + "\nmore", "/r/a/b/own.txt"), (4, apache, "/r/a/COPYING"), (5, None, "/r/a/x.txt"),
        (6, "", "/other/x.txt"), (7, "license to drive a car on the road", "/r/y.txt"), (8, "text", None), (2, "code", "/r/a/b/c.txt"), (9, "zz\n" + mit, "/r/a/license.md"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, path string, license string")
    got = sorted(repr((r["doc_id"], r["license"], r["how"], r["from_path"])) for r in licenses.scan(df).collect())
    assert got == sorted(map(repr, [
        (1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "/r/a"), (2, "Apache-2.0", "inherited", "/r/a"), (3, "Apache-2.0", "own", None), (4, "Apache-2.0", "own", None),
        (5, "Apache-2.0", "inherited", "/r/a"), (6, None, "none", None), (7, "MIT", "inherited", "/r"), (8, None, "none", None), (9, "MIT", "own", None),
    ]))
    assert licenses.scan(df.limit(0)).count() == 0


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    return {r["doc_id"]: (r["license"], r["how"]) for r in licenses.scan(df).collect()}


def test_every_template_is_its_own_best_match(spark):
    got = found(spark, [(i, t, f"/r{i}/LICENSE") for i, (_, t) in enumerate(licenses.templates())])
    assert got == {i: (name, "own") for i, (name, _) in enumerate(licenses.templates())}


def test_license_files_as_they_are_found(spark):
    """With holders filled in, lines wrapped otherwise, a title added, or comment marks before each line."""
    full = {n: t for n, t in licenses.templates() if len(t) > 700 and "\n" in t}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC"} <= set(full)
    rows, want = [], {}
    for name, text in sorted(full.items()):
        filled = re.sub("<[^>]*>", "2019 Some Harbour Authority and Others", text)
        for form in (filled, " ".join(filled.split()), "The software of the harbour\n\n" + filled, "\n".join(f" * {x}" for x in filled.split("\n"))):
            want[len(rows)] = (name, "own")
            rows.append((len(rows), form, f"/r{len(rows)}/LICENSE.txt"))
    assert found(spark, rows) == want


def test_headers_titles_and_spdx_lines(spark):
    header = "".join(f"# {x.strip()}\n" for x in licenses.SHORT["Apache-2.0"][3].split("\n"))
    mit = next(t for n, t in licenses.templates() if n == "MIT" and len(t) > 700)
    cases = {
        f"#!/usr/bin/env python\n\n# Copyright 2021 Some One\n{header}\nimport os\nprint(os)\n": "Apache-2.0",
        "// SPDX-License-Identifier: MIT\nint main() { return 0; }\n": "MIT",
        "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;\n": "GPL-2.0",
        "# SPDX-License-Identifier: BSD-3-Clause\nx = 1\n": "BSD-3-Clause",
        "MIT License\n\nsome text": "MIT",
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nmore": "GPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\n\nx": "LGPL-3.0",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\nx": "BSD-3-Clause",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "def f():\n    pass\n\n" + mit.replace("<year> <copyright holders>", "2020 A"): "MIT",
        "You need a license to drive a car on this road.": None,
        "The copyright of the song was sold, with permission of the heirs, to a public broadcaster.": None,
        "Permission slips must be returned by Friday.": None,
        "x" * 100_000 + " license " + "y" * 100_000: None,
    }
    got = found(spark, [(i, t, f"/r{i}/src.txt") for i, t in enumerate(cases)])
    assert {t: got[i][0] for i, t in enumerate(cases)} == cases
