"""The corpus pipeline: stages over `documents`, each of which reads what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Rows that a stage rejects are gone for the
next; text that it cuts stays cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe, near_dedup, positional_index, quality_rules, suffix_dedup
from textmill.llm.common import Scratch, table, without_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.apply_rules(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    keys = suffix_dedup.row_keys(docs, "doc_id", "text").select(F.struct("k1", "k2").alias("doc_id"), "text")
    hit = positional_index.find(keys, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id.*").distinct()
    return without_rows(docs, Scratch(spark, "decontaminated").write("hit", hit), "doc_id", "text")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: BPE, and which member of an approximate class is found, are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
