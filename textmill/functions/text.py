"""Scalar text expressions: counts, tokens, digests, snippets, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run without white space, that of Unicode included: with (?U) the class is one look-up for each character.
WORD = r"(?U)\S+"
TOKENS_PER_WORD = 1.3
#: Letters whose marks the keyword index drops, and what they become.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def tokens_of_words(n: Column) -> Column:
    """1.3 tokens a word, rounded up, in integers."""
    return ((13 * n + 9) / 10).cast("int")


def estimate_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def words_for_tokens(tokens: int) -> int:
    return int(tokens / TOKENS_PER_WORD)


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; all else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits without Latin marks, as the keyword index has them."""
    lower = F.lower(text)
    plain = F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, ACCENTED, PLAIN))  # most text is ASCII
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (Spark's trim knows only the space)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def chunk_id(url: Column, path: Column, index: Column) -> Column:
    """First 16 hex digits over url, heading path and place in the document; content is left out, so an edit keeps its id."""
    joined = F.array_join(F.coalesce(path, F.array().cast("array<string>")), "|")
    return F.left(F.sha2(F.concat_ws("|", url, joined, index.cast("string")), 256), F.lit(16))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snippet(text: Column, size: int = 200) -> Column:
    """Cut by characters, so that none is split."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def join_path(path: Column, sep: str = " > ") -> Column:
    return F.array_join(F.coalesce(path, F.array().cast("array<string>")), sep)
