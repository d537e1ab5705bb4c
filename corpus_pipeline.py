"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and returns the columns of
documents; the last one returns token ids.  Between stages rows are written as
Parquet in the shared scratch folder.

1. The quality classifier drops documents below the score bar.
2. Line deduplication drops lines that many documents share (``n_chars`` follows
   the text).
3. MinHash near-deduplication keeps the smallest id of each group (5-word
   shingles, 80 %).
4. Decontamination drops documents that hold a benchmark item.
5. Byte-level BPE encodes the texts and checks that they decode to the same bytes.

Rows that repeat an id are judged alike where the text is the same; of an id with
several texts the rows stay if any of them stays.  Null ids are never near
duplicates.  Extra columns pass through whatever they are called, and very long
texts are treated whole.  Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, classifier, decontam, lines, minhash
from tandem.llm.common import load, materialize
from tandem.llm.queries import BPE_RANKS, QUALITY_BAR


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classifier.train(docs, load(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))
    return classifier.classify(rows, model, text="t").where(F.col("score") >= QUALITY_BAR).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    made = lines.line_dedup(docs.select("doc_id", "text", F.struct(*others).alias("others")))
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return made.select(*(values.get(c, F.col("others")[c]).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), shingle_words=5, percent=80)
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return docs.join(materialize(gone), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The first stage's model and the last stage's library have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of what the stages keep."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
