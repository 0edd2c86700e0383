"""The queries of this subpackage, each over its whole table, and the SQL that says what they return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, line_dedup, near_dedup, positional_index, quality_fm, quality_rules, revisits, suffix_dedup, toxicity
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return positional_index.digest(found)


#: Words over which the words of a benchmark window may be spread, in order.
WITHIN = 15


def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose words follow each other in order, spread over at most WITHIN words."""
    found = positional_index.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=WITHIN)
    return positional_index.digest(found)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _lines(found: DataFrame) -> DataFrame:
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_units", "n_removed", cut.alias("cut_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of adjacent clauses, of line_dedup.LEAST characters or more."""
    return _lines(line_dedup.dedup(table(spark, sf_dir, "documents")))


def op6_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surplus line that holds more than white space."""
    return _lines(line_dedup.dedup(table(spark, sf_dir, "documents"), by=line_dedup.LINE, least=1))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are made of the pages, see revisits.captures."""
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("page_id", "record_id", "canonical_url", "response_id", "response_ts", "status", merged.alias("headers"))


def file_path() -> Column:
    """Documents laid out in directories by source and id; every tenth is a licence file, some of them higher up."""
    doc = F.col("doc_id")
    digit = lambda n: (F.floor(doc / n) % 10).cast("string")
    top = F.concat(F.lit("/"), "source")
    a, b = F.concat(top, F.lit("/a"), digit(100)), F.concat(top, F.lit("/a"), digit(100), F.lit("/b"), digit(10))
    name = F.concat(F.lit("/LICENSE-"), doc.cast("string"))
    return (
        F.when(doc % 1000 == 0, F.concat(top, name)).when(doc % 100 == 50, F.concat(a, name)).when(doc % 10 == 0, F.concat(b, name))
        .otherwise(F.concat(b, F.lit("/f"), doc.cast("string")))
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", file_path())
    return licenses.scan(docs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op4_proximity": op4_proximity,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op6_line_dedup_all": op6_line_dedup_all,
    "op7_revisits": op7_revisits,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

_ROWS, _IDF, _RARE = licenses.template_table()
_TEMPLATES = ", ".join(f"({k}, '{name}', '{t}', {x:.17e})" for k, name, t, x in _ROWS)
_WEIGHTS = ", ".join(f"('{t}', {x:.17e})" for t, x in sorted(_IDF.items()))

ORACLES = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twins, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop,
             length(regexp_replace(t, '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]+', '', 'g')) AS n_unspaced
      FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars > 14.0 * n_words AND n_unspaced >= 0.2 * word_chars AS unspaced FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (unspaced OR word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words) AND n_symbols <= 0.3 * n_words
       AND n_exclaims <= 0.5 * n_words AND n_dup_lines <= 0.5 * n_lines AND (unspaced OR n_words < 40 OR n_stop >= 0.01 * n_words) AS kept
FROM b""",
    "op7_revisits": r"""
WITH p AS (SELECT page_id, trim(url) AS url, '"' || left(md5(coalesce(html, '')), 12) || '"' AS tag FROM pages),
u AS (SELECT page_id, tag, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
c AS (SELECT page_id, tag, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]|:[0-9]*$', '', 'g')
             || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
             list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
                                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM u),
k AS (SELECT page_id, tag, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM c),
r AS (SELECT 2 * page_id AS record_id, page_id, canonical_url, page_id * 10 AS ts, true AS full_, tag AS etag FROM k UNION ALL
      SELECT 2 * page_id + 1, page_id, canonical_url, CASE WHEN page_id % 7 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 100003 END, false,
             CASE WHEN page_id % 5 = 0 THEN '"old"' WHEN page_id % 5 = 1 THEN NULL ELSE tag END FROM k),
f AS (SELECT *, last_value(CASE WHEN full_ THEN record_id END IGNORE NULLS) OVER
             (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM r),
j AS (SELECT f.*, g.ts AS response_ts, g.etag AS rtag, g.page_id AS rpage, k1.tag AS own, k2.tag AS other FROM f
      LEFT JOIN r g ON g.full_ AND g.record_id = f.response_id LEFT JOIN k k1 ON k1.page_id = f.page_id LEFT JOIN k k2 ON k2.page_id = g.page_id WHERE NOT f.full_),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
      WHEN CASE WHEN etag IS NOT NULL THEN etag = rtag WHEN page_id % 3 <> 0 THEN page_id % 28 = rpage % 28 ELSE own = other END THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT page_id, record_id, canonical_url, response_id, response_ts, status,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=' || ts || ';etag=' || rtag || ';server=a' END AS headers
FROM s""",
    "op10_license_scan": rf"""
WITH tp(template, license, term, w) AS (VALUES {_TEMPLATES}), wt(term, idf) AS (VALUES {_WEIGHTS}),
d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 1000 = 0 THEN '/' || source || '/LICENSE-' || doc_id
        WHEN doc_id % 100 = 50 THEN '/' || source || '/a' || ((doc_id // 100) % 10) || '/LICENSE-' || doc_id
        WHEN doc_id % 10 = 0 THEN '/' || source || '/a' || ((doc_id // 100) % 10) || '/b' || ((doc_id // 10) % 10) || '/LICENSE-' || doc_id
        ELSE '/' || source || '/a' || ((doc_id // 100) % 10) || '/b' || ((doc_id // 10) % 10) || '/f' || doc_id END AS path FROM documents),
l AS (SELECT doc_id, 2 AS kind, u.i AS n, u.s AS t FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {{'i': i, 's': s}})) AS u FROM d)
      WHERE regexp_matches(u.s, '{licenses.KEYWORD}') UNION ALL
      SELECT doc_id, 1, u.i, u.s FROM (SELECT doc_id, unnest(list_transform(string_split_regex(text, '{licenses.BLANK}'), lambda s, i: {{'i': i, 's': s}})) AS u FROM d)
      WHERE regexp_matches(u.s, '{licenses.KEYWORD}') UNION ALL
      SELECT doc_id, 0, 0, text FROM d WHERE path LIKE '%/LICENSE-%' AND text <> ''),
x AS (SELECT doc_id, kind, n, z.term, count(*) * coalesce(any_value(idf), {_RARE:.17e}) AS x
      FROM (SELECT doc_id, kind, n, unnest(regexp_extract_all(lower(t), '{licenses.TERM}')) AS term FROM l) z LEFT JOIN wt ON wt.term = z.term GROUP BY ALL),
n AS (SELECT doc_id, kind, n, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT x.doc_id, x.kind, tp.license, round(sum(x * w) / any_value(norm), 6) AS score FROM x JOIN tp ON tp.term = x.term
      JOIN n ON n.doc_id = x.doc_id AND n.kind = x.kind AND n.n = x.n GROUP BY x.doc_id, x.kind, x.n, tp.template, tp.license),
b AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, score DESC, license) AS r FROM s WHERE score >= {licenses.THRESHOLD}) WHERE r = 1),
o AS (SELECT d.doc_id, path, license, score, regexp_replace(path, '/[^/]*$', '') AS dir FROM d LEFT JOIN b ON b.doc_id = d.doc_id),
g AS (SELECT dir, license, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) AS r FROM o WHERE license IS NOT NULL AND path LIKE '%/LICENSE-%') WHERE r = 1),
near AS (SELECT dirs.dir, arg_max(g.dir, length(g.dir)) AS above, arg_max(g.license, length(g.dir)) AS license, arg_max(g.score, length(g.dir)) AS score
         FROM (SELECT DISTINCT dir FROM o) dirs JOIN g ON dirs.dir = g.dir OR starts_with(dirs.dir, g.dir || '/') GROUP BY dirs.dir)
SELECT o.doc_id, o.path, coalesce(o.license, near.license) AS license, coalesce(o.score, near.score) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN o.license IS NULL THEN near.above END AS from_path
FROM o LEFT JOIN near ON near.dir = o.dir""",
}


def _sql_lines(by: str, least: int) -> str:
    return rf"""
WITH s AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{by}'), lambda s, i: {{'i': i, 's': s}})) AS u FROM documents),
n AS (SELECT doc_id, u.i AS i, u.s AS s, trim(regexp_replace(lower(u.s), '\s+', ' ', 'g')) AS norm FROM s),
p AS (SELECT *, row_number() OVER d AS r, sum(length(norm)) OVER d AS stop, sum(length(norm)) OVER d - length(norm) AS start FROM n WHERE norm <> ''
      WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT doc_id, list(norm ORDER BY r) AS norms, max(r) AS top, max(stop) AS size FROM p GROUP BY doc_id),
u AS (SELECT a.doc_id, a.r AS a, b.r AS b FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.stop >= a.start + {least} AND b.start < a.start + {least}
      UNION ALL SELECT doc_id, 1, top FROM l WHERE size < {least}),
k AS (SELECT u.doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(norms[a:b], ' ') ORDER BY u.doc_id, a) > 1 AS cut FROM u JOIN l ON l.doc_id = u.doc_id),
c AS (SELECT DISTINCT k.doc_id, p.i FROM k JOIN p x ON x.doc_id = k.doc_id AND x.r = k.a JOIN p y ON y.doc_id = k.doc_id AND y.r = k.b
      JOIN n p ON p.doc_id = k.doc_id AND p.i BETWEEN x.i AND y.i WHERE k.cut),
o AS (SELECT n.*, c.i IS NOT NULL AS cut FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.i = n.i)
SELECT d.doc_id, count(*) FILTER (norm <> '') AS n_units, count(*) FILTER (norm <> '' AND cut) AS n_removed,
       coalesce(sum(length(s)) FILTER (cut), 0)::BIGINT AS cut_chars, sha256(coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLES["op6_line_dedup"] = _sql_lines(line_dedup.CLAUSE, line_dedup.LEAST)
ORACLES["op6_line_dedup_all"] = _sql_lines(line_dedup.LINE, 1)
