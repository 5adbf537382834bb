"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import bpe, decontaminate, pii, quality, simhash
from placeloom.llm.common import materialize, table
from placeloom.llm.queries import WORD_BPE, tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs from the labels of this stage's documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document."""
    return bpe.encode_decode(docs, tokenizer_file(WORD_BPE))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one),
    ("decontamination", drop_contaminated),
    ("personal data", redact),
    ("tokens", tokens),
]

#: Fingerprints' union over links, bootstrapped patterns and BPE merges are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
