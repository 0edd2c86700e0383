"""Keyword search: a positional postings table, a query grammar, BM25 and top-k.

Postings are written sorted by term, so that a query's terms prune row groups,
and carry the length of their chunk. A query reads the postings of its own
terms, sums by chunk with partial aggregates, and joins the content of the k
winners only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import ACCENTED, PLAIN, index_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("content", "title", "heading_path")


def _tokens(chunks: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, x: name and tokens of each column that the chunks have. heading_path is indexed by its words."""
    have = [c for c in columns if c in chunks.columns]
    types = dict(chunks.dtypes)
    text = {c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") if types[c].startswith("array") else F.coalesce(F.col(c), F.lit("")) for c in have}
    return chunks.select(F.col(key).alias("key"), F.array(*(F.struct(F.lit(c).alias("col"), index_tokens(text[c]).alias("tokens")) for c in have)).alias("x"))


def postings(chunks: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """key, dl, col, pos, term: every token, with the number of tokens of its chunk, so that a search needs no other table."""
    dl = F.aggregate("x", F.lit(0), lambda n, c: n + F.size(c["tokens"]))
    each = _tokens(chunks, key, columns).select("key", dl.alias("dl"), F.explode("x").alias("x"))
    return each.select("key", "dl", F.col("x.col").alias("col"), F.posexplode("x.tokens").alias("pos", "term"))


def lengths(chunks: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """key, dl: also of chunks without tokens."""
    return _tokens(chunks, key, columns).select("key", F.aggregate("x", F.lit(0), lambda n, c: n + F.size(c["tokens"])).alias("dl"))


@dataclass(frozen=True)
class Stats:
    """What a score needs of the whole corpus: chunks, and tokens of all of them."""

    n: int
    tokens: int


def corpus_stats(chunks: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> Stats:
    row = lengths(chunks, key, columns).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    return Stats(row["n"], row["t"])


# --- the query grammar: words (all must match), AND, OR, NOT, "phrase", prefix*, column:term, parentheses


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*)?|([()])|(\w+)\s*:\s*|(\w+)(\*)?)', re.UNICODE)


def fold(word: str) -> list[str]:
    return re.findall(r"[^\W_]+", word.lower().translate(str.maketrans(ACCENTED, PLAIN)))


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> object:
    """Raises ValueError for anything else, also for the empty query."""
    tokens: list[tuple] = []
    at = 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"syntax error near {query[at:].strip()!r}")
        phrase, p_star, paren, column, word, star = m.groups()
        if phrase is not None:
            tokens.append(("phrase", Phrase(tuple(fold(phrase)), bool(p_star))))
        elif paren:
            tokens.append((paren,))
        elif column:
            if column not in columns:
                raise ValueError(f"no such column: {column}")
            tokens.append(("column", column))
        elif word in ("AND", "OR", "NOT") and not star:
            tokens.append((word,))
        else:
            tokens.append(("phrase", Phrase(tuple(fold(word)), bool(star))))
        at = m.end()
    node, rest = _or(tokens)
    if rest:
        raise ValueError(f"syntax error near {rest[0]}")
    return node


def _or(t: list) -> tuple[object, list]:
    left, t = _and(t)
    while t and t[0][0] == "OR":
        right, t = _and(t[1:])
        left = Op("or", left, right)
    return left, t


def _and(t: list) -> tuple[object, list]:
    left, t = _not(t)
    while t and t[0][0] not in ("OR", ")"):
        right, t = _not(t[1:] if t[0][0] == "AND" else t)
        left = Op("and", left, right)
    return left, t


def _not(t: list) -> tuple[object, list]:
    left, t = _unit(t)
    while t and t[0][0] == "NOT":
        right, t = _unit(t[1:])
        left = Op("not", left, right)
    return left, t


def _unit(t: list) -> tuple[object, list]:
    if not t:
        raise ValueError("syntax error at the end of the query")
    head, rest = t[0], t[1:]
    if head[0] == "(":
        node, rest = _or(rest)
        if not rest or rest[0][0] != ")":
            raise ValueError("a parenthesis isn't closed")
        return node, rest[1:]
    if head[0] == "column":
        if not rest or rest[0][0] != "phrase":
            raise ValueError("a column needs a term")
        p = rest[0][1]
        return Phrase(p.terms, p.prefix, head[1]), rest[1:]
    if head[0] != "phrase" or not head[1].terms:
        raise ValueError(f"syntax error near {head}")
    return head[1], rest


def phrases(node: object) -> list[Phrase]:
    """Distinct phrases, those after NOT included, in order."""
    return [node] if isinstance(node, Phrase) else list(dict.fromkeys([*phrases(node.left), *phrases(node.right)]))


def _scored(node: object) -> list[Phrase]:
    """Phrases that add to the score: not those after NOT."""
    if isinstance(node, Phrase):
        return [node]
    return list(dict.fromkeys(_scored(node.left) + ([] if node.kind == "not" else _scored(node.right))))


def _holds(node: object, has: dict[Phrase, Column]) -> Column:
    if isinstance(node, Phrase):
        return has[node]
    a, b = _holds(node.left, has), _holds(node.right, has)
    return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b


def _term_test(p: Phrase, k: int) -> Column:
    own = F.col("term").startswith(p.terms[k]) if p.prefix and k == len(p.terms) - 1 else F.col("term") == p.terms[k]
    return own & (F.col("col") == p.column) if p.column else own


def wanted(query: str, columns: tuple[str, ...] = COLUMNS) -> Column:
    """A test of postings: those of the query's terms. Equality and prefix tests go down to the scan."""
    tests = [_term_test(p, k) for p in phrases(parse(query, columns)) for k in range(len(p.terms))]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def occurrences(post: DataFrame, found: list[Phrase]) -> DataFrame:
    """key, dl, f0, f1, ...: how often each phrase occurs.

    One read of the postings: each is tagged with the phrases and offsets that it fits; starts with all offsets count.
    A place holds one token, so no start has an offset twice.
    """
    tags = [F.when(_term_test(p, k), F.struct(F.lit(i).alias("p"), F.lit(k).alias("k"))) for i, p in enumerate(found) for k in range(len(p.terms))]
    wanted = [_term_test(p, k) for p in found for k in range(len(p.terms))]
    test = wanted[0]
    for w in wanted[1:]:
        test = test | w
    hits = post.filter(test).select("key", "dl", "col", "pos", F.explode(F.array_compact(F.array(*tags))).alias("t"))
    sizes = F.array(*(F.lit(len(p.terms)).cast("long") for p in found))
    starts = hits.groupBy("key", "col", F.col("t.p").alias("p"), (F.col("pos") - F.col("t.k")).alias("s")).agg(F.count("*").alias("n"), F.max("dl").alias("dl"))
    full = starts.filter(F.col("n") == F.get(sizes, F.col("p")))
    return full.groupBy("key").agg(F.max("dl").alias("dl"), *(F.sum((F.col("p") == i).cast("int")).alias(f"f{i}") for i in range(len(found))))


def search(chunks: DataFrame, query: str, k: int = 5, key: str = "id", columns: tuple[str, ...] = COLUMNS, post: DataFrame | None = None, stats: Stats | None = None) -> DataFrame:
    """rank, score and the columns of the k best chunks; ties go to the lesser key.

    With a stored postings table (`post`) and its `stats`, only the query's own postings are read, and the content of the
    k winners. Without them the chunks are tokenised for this query.
    """
    node = parse(query, columns)
    every, scored = phrases(node), set(_scored(node))
    stats = stats or corpus_stats(chunks, key, columns)
    found = occurrences(post if post is not None else postings(chunks, key, columns), every)
    counted = found.agg(*(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(every))))
    holders = counted.first()  # one row of sums
    rows = found.filter(_holds(node, {p: F.col(f"f{i}") > 0 for i, p in enumerate(every)}))
    rows = rows.withColumn("n", F.lit(stats.n)).withColumn("avgdl", F.lit(stats.tokens / max(1, stats.n)))
    score = F.lit(0.0)
    for i, p in enumerate(every):
        if p in scored:
            n = F.lit(holders[f"n{i}"] or 0)
            raw = F.log((F.col("n") - n + 0.5) / (n + 0.5))
            idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
            f = F.col(f"f{i}")
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = rows.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)
    return ranked(F.broadcast(best).join(chunks.withColumn("key", F.col(key)), "key").drop("key"), key)  # k rows


def ranked(best: DataFrame, key: str) -> DataFrame:
    """Adds rank from 1 to a top-k result, which is small."""
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
