"""Requests to a model, rendered from tables, so that responses can be recorded and replayed by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators import judge

VERDICTS = ("EQUIVALENT", "MEANING_SHIFT", "HEDGE_CHANGE", "SCOPE_CHANGE", "PARTIAL_OMISSION", "WORDING")


def _listed(order: Column, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")


def _names(d: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with ``name_a`` and ``name_b`` of their run."""
    return d.join(names.select("run_id", "name_a", "name_b"), "run_id")


def judgment_requests(pairs: DataFrame, names: DataFrame, tier: str = "triage") -> DataFrame:
    """(run_id, sec_id, batch_no, tier, prompt): ten pairs of a section with their neighbours in one request."""
    near = _names(judge.batches(judge.context(pairs)), names)
    blank = lambda c: F.coalesce(F.col(c), F.lit("-"))
    line = F.concat(F.lit("["), "pair_id", F.lit("] before: "), blank("prev_en"), F.lit(" | "), blank("prev_zh"), F.lit("\n  A: "), "en_text", F.lit("\n  B: "), "zh_text", F.lit("\n  after: "), blank("next_en"), F.lit(" | "), blank("next_zh"))
    listed = near.groupBy("run_id", "sec_id", "batch_no", "name_a", "name_b").agg(_listed(F.col("pair_n"), line).alias("body"))
    head = F.concat(F.lit("Compare text A ("), "name_a", F.lit(") with text B ("), "name_b", F.lit(f") of each pair. Give one verdict of {', '.join(VERDICTS)}, the words that differ on each side, a reason and a confidence from 0 to 1. Answer with a JSON object that has the array results.\n\n"))
    return listed.select("run_id", "sec_id", "batch_no", F.lit(tier).alias("tier"), F.concat(head, "body").alias("prompt"))


def omission_requests(omitted: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, sentence_id, prompt): is a sentence of one side somewhere in the full text of the other?"""
    other = texts.select("run_id", F.when(F.col("slot") == "en", "zh").otherwise("en").alias("slot"), F.col("text").alias("other"))
    rows = _names(omitted.join(other, ["run_id", "slot"]), names)
    where = F.when(F.col("slot") == "en", F.col("name_b")).otherwise(F.col("name_a"))
    body = F.concat(F.lit("Is the content of this sentence found anywhere in the "), where, F.lit(" text below, and does its absence matter? Answer with a JSON object that has present_elsewhere, material, reason and confidence.\n\nSentence: "), "text", F.lit("\n\nText:\n"), "other")
    return rows.select("run_id", F.col("sid").alias("sentence_id"), body.alias("prompt"))


def section_requests(heads: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, prompt): which headings of the two sides go together?"""
    side = lambda s: _listed(F.when(F.col("slot") == s, F.col("sec_ord")), F.when(F.col("slot") == s, F.concat(F.col("sec_ord").cast("string"), F.lit(" "), "heading")))
    listed = heads.where("sec_ord > 0").groupBy("run_id").agg(side("en").alias("a"), side("zh").alias("b"))
    return _names(listed, names).select("run_id", F.concat(F.lit("Match the headings of the "), "name_a", F.lit(" text with those of the "), "name_b", F.lit(" text. Answer with a JSON object that has the array matches of i, j and score.\n\nA:\n"), "a", F.lit("\n\nB:\n"), "b").alias("prompt"))


def pair_requests(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, sec_id, prompt): which sentences of a section say the same?"""
    side = lambda s: _listed(F.when(F.col("slot") == s, F.col("s_n")), F.when(F.col("slot") == s, F.concat("sid", F.lit(" "), "text")))
    listed = sentences.groupBy("run_id", "sec_id").agg(side("en").alias("a"), side("zh").alias("b"))
    return _names(listed, names).select("run_id", "sec_id", F.concat(F.lit("Align the sentences of the "), "name_a", F.lit(" section with those of the "), "name_b", F.lit(" one; a sentence may go with several. Answer with a JSON object that has the array pairs of en_ids, zh_ids and score.\n\nA:\n"), "a", F.lit("\n\nB:\n"), "b").alias("prompt"))
