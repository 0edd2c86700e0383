"""Operator 5 [native]: quality rules, a threshold table compiled into one projection.

Each row of the table names a ratio and the range it must lie in. `RULES` is
data: `compile_rules` turns any such table into one boolean column, and
`measures` has one column for each count that the ratios are made of. All of it
is Spark SQL expressions: no exchange, no user function, one pass over the text.

Defined results: a null or empty text has no words, all its counts are 0 and it
fails the base rule (fewer than 10 words), so it is not kept; texts of any
length are measured whole; repeated rows give repeated results; columns of the
input stay, and those named like a measure are replaced.

Limits: the stop words are those of the languages named below; texts of other
languages that put spaces between words fail that rule. Scripts without such
spaces are exempt from it and from the bound on word length, but not from the
base rule, which counts words between white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: White space that ends a word, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
#: Frequent words of English, German, French, Spanish, Italian, Portuguese, Dutch, Swedish, Polish, Czech,
#: Turkish, Finnish, Hungarian, Romanian, Indonesian, Vietnamese, Russian, Ukrainian, Greek, Arabic, Persian, Hebrew, Hindi.
STOP_WORDS = (
    "the of and to in a is that for with was on are as by be this it from or an at "
    "der die das und den von zu mit des im sich für ist ein eine auf dem nicht als auch "
    "le la les de des et en un une que qui dans pour sur est pas avec par du au "
    "el los las del y que se por con una para su al lo no ta "
    "il di che non è sono "
    "o os uma não em com "
    "het een van dat niet zijn "
    "och att det som är på "
    "w nie na się jest że "
    "je se v že "
    "ve bir bu için "
    "ja on ei että "
    "az és hogy nem "
    "și cu nu pe "
    "yang dan dengan ini "
    "và của là không "
    "и в не на что с это "
    "і що та "
    "και το η να του της "
    "في من على أن "
    "و در به از "
    "של את על לא "
    "के है में की"
).split()
#: Letters of scripts that put no spaces between words.
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
LONG_WORDS, UNSPACED_SHARE = 14.0, 0.2


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [low, high]; a bound of None is open.

    A text of fewer than `from_words` words passes, as does a zero denominator; with `spaced` also one whose words can't be
    told apart, as over UNSPACED_SHARE of it is in scripts without spaces.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    spaced: bool = False


RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, LONG_WORDS, spaced=True),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.3),
    Rule("exclamation marks per word", "n_exclaims", "n_words", None, 0.5),
    Rule("duplicate lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop words", "n_stop_words", "n_words", 0.01, None, from_words=40, spaced=True),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    A window's hash is made of its words' hashes, each of which is made once. Where all hashes of a text differ, as in
    most texts, that is all; else windows are sorted by hash with their places, those whose words equal a neighbour's are
    kept, and the words they cover are counted from the distances between their places.
    """

    def of_hashes(each: Column) -> Column:
        n = F.size(each) - size
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.element_at(F.transform(F.array(ordered), lambda o: _count_covered(_twins(o, words, size), size)), 1)

    hashed = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of_hashes)
    per_text = F.transform(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.element_at(per_text, 1).cast("long")


def _twins(ordered: Column, words: Column, size: int) -> Column:
    """Places, in order, of windows whose hash and words equal those of a neighbour in the sorted array."""
    last = F.size(ordered) - 1
    text = lambda i: F.slice(words, i + 1, size)

    def place(x: Column, k: Column) -> Column:
        same = lambda y: (y["h"] == x["h"]) & (text(y["i"]) == text(x["i"]))
        before = F.when(k > 0, same(F.get(ordered, k - 1))).otherwise(F.lit(False))
        after = F.when(k < last, same(F.get(ordered, k + 1))).otherwise(F.lit(False))
        return F.when(before | after, x["i"])

    return F.sort_array(F.array_compact(F.transform(ordered, place)))


def _count_covered(places: Column, size: int) -> Column:
    def gaps(p: Column) -> Column:
        end = F.size(p) - 1
        return F.transform(p, lambda x, k: F.when(k < end, F.least(F.get(p, k + 1) - x, F.lit(size))).otherwise(F.lit(size)))

    one = F.transform(F.array(places), lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, g: a + g))
    return F.element_at(one, 1)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the counts that RULES use besides."""
    t, words, lines = (fresh(x, df.columns) for x in ("t", "words", "lines"))
    rest = [F.col(c) for c in df.columns if c not in COUNTS]
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(words, words_of(F.col(t)))
    # a line has a word if anything but white space is left of it
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chars = F.length(F.regexp_replace(t, SPACE, ""))
    stop = sorted(set(STOP_WORDS))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("n_exclaims"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        # counted where words are long only
        F.when(chars > LONG_WORDS * F.size(words), F.length(F.regexp_replace(t, UNSPACED, ""))).otherwise(0).cast("long").alias("n_unspaced"),
    )
    # Rows of a generator are not looked through: a filter on the counts reads them, where it would else compute each anew
    # as often as the rules name it.
    return df.select(*rest, F.inline(F.array(counts)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_stop_words", "n_unspaced")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every ratio lies in its range."""
    ok = F.lit(True)
    unspaced = F.col("n_unspaced") >= UNSPACED_SHARE * F.greatest(F.col("word_chars"), F.lit(1))
    for r in rules:
        a, b = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        for bound, good in ((r.low, a >= (r.low or 0) * b), (r.high, a <= (r.high or 0) * b)):
            if bound is not None:
                ok = ok & ((b == 0) | (F.col("n_words") < r.from_words) | (unspaced if r.spaced else F.lit(False)) | good)
    return ok


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, base_failed and kept."""
    df = measures(df, text)
    df = df.withColumn("base_failed", base_failed())
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(compile_rules(rules)))
