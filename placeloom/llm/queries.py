"""The registered queries of this subpackage: each applies one operator to its whole table.

The operators return their own results; the thin functions here derive the agreed columns.
``ORACLES`` holds the same in DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import bpe, chat, decontaminate, htmltext, oracles, pii, quality, simhash, tokencount, toxicity, warc
from placeloom.llm.common import scratch, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = quality.assess(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def _joined_spans(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))

    def of(name: str, kind: str) -> Column:
        return F.filter(name, lambda x: x["kind"] == kind)

    both = F.flatten(F.array(*[F.sort_array(F.concat(of("base", k), of("added", k))) for k in pii.KINDS]))
    counts = [F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.withColumn("all", both).select("doc_id", *counts, F.sha2(_joined_spans("base"), 256).alias("base_sha256"), _joined_spans("all").alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(PIECES))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(WORD_BPE))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    found = warc.page_records(spark, path)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_quality_rules,
        op3_warc,
        op4_benchmark_decontamination,
        op5_toxicity,
        op6_pii,
        op7_simhash,
        op8_token_counts,
        op9_bpe,
        op10_html_extraction,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": oracles.OP1,
    "op2_quality_rules": oracles.OP2,
    "op3_warc": oracles.OP3,
    "op4_benchmark_decontamination": oracles.OP4,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
