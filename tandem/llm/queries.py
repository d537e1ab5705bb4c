"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, classifier, decontam, lines, minhash, pii, quality_rules, secret_scan, substring, token_counts
from tandem.llm.common import load

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
QUALITY_BAR = 0.3


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 % or more of the 3-word shingles."""
    return minhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=3, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text and the cascade's verdict."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, columns=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before and removed, and a digest of the words that stay."""
    kept = substring.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the secrets in every text, with the forest's score; values as digests.  The tables hold no labelled findings, so these are made."""
    found = secret_scan.scan(load(spark, sf_dir, "documents"), secret_scan.example_findings(spark), path="source")
    return found.select("doc_id", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("secret_sha256"), "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data, and of the terms that reveal it."""
    found = pii.find_spans(load(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.kind_count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and a digest of the text that stays."""
    kept = lines.line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and round trip of every text, as digests."""
    docs = load(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, with_ids=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best window."""
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they exceed the limit."""
    counted = token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text by the model that its labels teach."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, load(spark, sf_dir, "labels"))
    scored = classifier.classify(docs, model)
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_BAR).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.NEAR_SQL,
    "op2_quality_rules": quality_rules.RULES_SQL,
    "op3_substring_dedup": substring.REPEATS_SQL,
    "op5_pii": pii.PII_SQL,
    "op6_line_dedup": lines.LINES_SQL,
}
