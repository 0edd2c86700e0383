"""Operator 10 [native]: licence scan by sparse TF-IDF cosine to templates, then inheritance along directories.

Three kinds of text units become sparse TF-IDF vectors: the whole text of a
licence file (by its name); blocks between blank lines that hold a licence
keyword, such as the header of a source file; and single lines with a keyword,
wherever they stand. Each is held against the templates (full texts in the
folder `templates`, notices, titles and SPDX lines) by joining its terms with
the templates' terms, a fixed table of some thousand rows. A file takes its best
unit of at least THRESHOLD: the whole text before blocks before lines, then the
highest score.

A file without one inherits from the nearest directory above it that has a
licence file: distinct directories are joined with their ancestors' paths, the
longest path wins, and files are joined to the answer of their directory. All of
it is DataFrame operations; counts are partial before any exchange.

Defined results: a null or empty text has no units, so it can only inherit; ties
between templates go to the lesser name, ties between licence files of one
directory to the higher score, then the lesser id; a null path inherits nothing;
repeated rows give repeated results; extra columns are unused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_digest

#: Short forms, titles and notices of common licences.
SHORT = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Redistribution and use in source and binary forms are permitted under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal License"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    "ISC": ("ISC License", "Licensed under the ISC License."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": ("Released under the MIT License.", "MIT License", "The MIT License (MIT)", "Licensed under the MIT License."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
KEYWORD = "(?i)licen[sc]e|copyright|redistribution|mozilla public|public domain|permission"
LICENSE_FILE = "(?i)/(un)?(licen[sc]e|copying)[^/]*$"
#: Where one block ends and the next begins.
BLANK = r"\n[ \t\r]*\n"
TERM = "[a-z0-9.]*[a-z0-9]"
THRESHOLD = 0.7
WHOLE, BLOCK, LINE = 0, 1, 2


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text): full texts from the folder beside this file, short forms, and an SPDX line for each licence."""
    full = [(f.name.removesuffix(".txt"), f.read_text()) for f in files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt")]
    short = [(name, text) for name, texts in SHORT.items() for text in texts]
    spdx = [(name, f"SPDX-License-Identifier: {form}") for name in sorted(SHORT) for form in ((name, f"{name}-only", f"{name}-or-later") if "GPL" in name else (name,))]
    return tuple(sorted(full + short + spdx))


def _terms(text: str) -> Counter[str]:
    return Counter(re.findall(TERM, text.lower()))


@cache
def template_table() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight of unit vectors), idf by term, and the idf of terms that no template has."""
    n = len(templates())
    df = Counter(t for _, x in templates() for t in _terms(x))
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for k, (name, text) in enumerate(templates()):
        raw = {t: c * idf[t] for t, c in _terms(text).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rows += [(k, name, t, x / norm) for t, x in sorted(raw.items())]
    return rows, idf, math.log(1 + n) + 1


def _units(docs: DataFrame, doc_id: str, text: str, path: str | None, license_file: str) -> DataFrame:
    """_k, kind, n, t: the texts that are held against the templates."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_keyword = lambda parts: F.filter(parts, lambda x: x.rlike(KEYWORD))
    tagged = lambda parts, kind: F.transform(parts, lambda x, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), x.alias("t")))
    is_file = F.coalesce(F.col(path).rlike(license_file), F.lit(False)) if path else F.lit(False)
    none = F.array().cast("array<struct<kind:int,n:int,t:string>>")
    every = F.concat(
        F.when(is_file & (t != ""), tagged(F.array(t), WHOLE)).otherwise(none),
        # most texts hold no keyword, and are not split
        F.when(t.rlike(KEYWORD), F.concat(tagged(with_keyword(F.split(t, BLANK)), BLOCK), tagged(with_keyword(F.split(t, "\n")), LINE))).otherwise(none),
    )
    rows = docs.select(row_digest(F.col(doc_id), F.col(text)).alias("_k"), F.explode(every).alias("u"))
    return rows.select("_k", "u.kind", "u.n", "u.t")


def _counts(tokens: Column) -> Column:
    """term and c of each distinct token, made in the row: sorted, and cut where the next differs."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))
        return F.element_at(F.transform(F.array(begins), lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).alias("c")))), 1)

    none = F.array().cast("array<struct<term:string,c:int>>")
    return F.element_at(F.transform(F.array(F.sort_array(tokens)), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none)), 1)


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, license_file: str = LICENSE_FILE) -> DataFrame:
    """Best match of each distinct (id, text): _k, license, score."""
    spark: SparkSession = docs.sparkSession
    rows, idf, rare = template_table()
    known = spark.createDataFrame([(k, t, w) for k, _, t, w in rows], "template int, term string, w double")
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(templates())], "template int, license string")
    weights = spark.createDataFrame([(t, x) for t, x in sorted(idf.items())], "term string, idf double")
    unit = ["_k", "kind", "n"]
    # Terms don't travel: a unit's counts are made in its row, and its sums in its task. A row that is repeated makes its
    # units longer vectors of the same direction.
    tokens = F.regexp_extract_all(F.lower("t"), F.lit(TERM), F.lit(0))
    terms = _units(docs, doc_id, text, path, license_file).select(*unit, F.explode(_counts(tokens)).alias("u")).select(*unit, "u.term", "u.c")
    counted = terms.join(F.broadcast(weights), "term", "left").withColumn("x", F.col("c") * F.coalesce("idf", F.lit(rare)))
    norms = counted.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(F.broadcast(known), "term").groupBy(*unit, "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, unit).select("_k", "kind", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= THRESHOLD)
    scored = scored.join(F.broadcast(names), "template")
    best = scored.groupBy("_k").agg(F.min(F.struct("kind", (-F.col("score")).alias("s"), "license")).alias("m"))
    return best.select("_k", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def directory(path: Column) -> Column:
    """The path up to its last slash; "" at the root."""
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", license_file: str = LICENSE_FILE) -> DataFrame:
    """Per row: id, path, license, score, how (own, inherited or none) and from_path of the directory that it comes from."""
    listed = docs.select(doc_id, path, row_digest(F.col(doc_id), F.col(text)).alias("_k"))
    own = listed.join(matches(docs, doc_id, text, path, license_file), "_k", "left").withColumn("dir", directory(F.col(path)))
    rank = F.struct((-F.col("score")).alias("s"), F.col(doc_id).alias("i"), F.col("license").alias("l"))
    given = own.filter(F.col("license").isNotNull() & F.col(path).rlike(license_file)).groupBy("dir").agg(F.min(rank).alias("m"))
    given = given.select(F.col("dir").alias("above"), F.col("m.l").alias("dir_license"), (-F.col("m.s")).alias("dir_score"))
    dirs = own.filter(F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("above"))
    nearest = above.join(given, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_license", "dir_score")).alias("m"))
    nearest = nearest.select("dir", F.col("m.above").alias("above"), F.col("m.dir_license").alias("dir_license"), F.col("m.dir_score").alias("dir_score"))
    out = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        doc_id, path, F.coalesce("license", "dir_license").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("above")).alias("from_path"),
    )
