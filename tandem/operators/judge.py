"""Judgments of meaning: a provider table, two tiers, omissions.

The engine calls no model.  A provider is a table of recorded judgments, looked
up by content; ``rule_provider`` is a plain stand-in that knows hedges only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions import lexicons as lx
from tandem.functions.language import modal_pattern

BATCH = 10


class JudgmentProvider(Protocol):
    """Judges pairs (run_id, pair_id, en_text, zh_text) of a tier: (run_id, pair_id, verdict, en_span, zh_span, explanation, confidence)."""

    def __call__(self, pairs: DataFrame, tier: str) -> DataFrame: ...


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a unit separator between them."""
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def recorded_provider(judgments: DataFrame) -> JudgmentProvider:
    """Looks judgments up in a table (run_id, tier, pair_id, …)."""
    return lambda pairs, tier: judgments.where(F.col("tier") == tier).drop("tier").join(pairs.select("run_id", "pair_id"), ["run_id", "pair_id"], "left_semi")


def rule_provider(code_a: str = "en", code_b: str = "zh") -> JudgmentProvider:
    """HEDGE_CHANGE where one side has modal words and the other none, else EQUIVALENT.  No substitute for a model."""

    def judge(pairs: DataFrame, tier: str) -> DataFrame:
        a, b = F.col("en_text").rlike(modal_pattern(code_a)), F.col("zh_text").rlike(modal_pattern(code_b))
        null = F.lit(None).cast("string")
        return pairs.select("run_id", "pair_id", F.when(a != b, "HEDGE_CHANGE").otherwise("EQUIVALENT").alias("verdict"), null.alias("en_span"), null.alias("zh_span"), null.alias("explanation"), F.lit(0.5).alias("confidence"))

    return judge


def clamp(x: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(default))))


def context(pairs: DataFrame) -> DataFrame:
    """The texts of the pairs before and after, within the section."""
    section = W.partitionBy("run_id", "sec_id").orderBy("pair_n")
    return pairs.withColumns({f"{d}_{s}": f(f"{s}_text").over(section) for d, f in (("prev", F.lag), ("next", F.lead)) for s in ("en", "zh")})


def batches(pairs: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch_no`` within the section: at most ``size`` pairs, none across sections."""
    n = F.row_number().over(W.partitionBy("run_id", "sec_id").orderBy("pair_n"))
    return pairs.withColumn("batch_no", F.floor((n - 1) / size).cast("int"))


def cascade(pairs: DataFrame, provider: JudgmentProvider) -> DataFrame:
    """All pairs go through the fast tier; those it flags through the strong one, whose verdict counts if there is one."""
    known = pairs.where((F.col("en_text") != "") | (F.col("zh_text") != ""))
    triage = provider(known, "triage").where("verdict <> 'EQUIVALENT'")
    flagged = known.join(triage.select("run_id", "pair_id").distinct(), ["run_id", "pair_id"], "left_semi")
    return verdicts(triage, provider(flagged, "strong"))


def verdicts(triage: DataFrame, strong: DataFrame) -> DataFrame:
    """Strong judgments in place of triage ones, whatever they say."""
    fields = [c for c in triage.columns if c not in ("run_id", "pair_id")]
    s = strong.select("run_id", "pair_id", F.struct(*fields).alias("_s"))
    joined = triage.join(s, ["run_id", "pair_id"], "left")
    return joined.select("run_id", "pair_id", *(F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in fields))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def find_span(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Place of a needle: as it is, stripped, whatever its white space, whatever its case; else null.

    The last two need a pattern for each row, which built-in expressions lack.
    """
    import re

    def place(text: str | None, needle: str | None) -> list[int] | None:
        if not text or not needle:
            return None
        for exact in (needle, needle.strip()):
            if exact and (at := text.find(exact)) >= 0:
                return [at, at + len(exact)]
        loose = r"\s*".join(re.escape(c) for c in needle if not c.isspace())
        for flags in (0, re.I):
            if loose and (m := re.search(loose, text, flags)):
                return [m.start(), m.end()]
        return None

    for texts, needles in batches:
        yield pd.Series([place(t, n) for t, n in zip(texts, needles, strict=True)])


def pair_findings(judged: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings of judgments; a quotation that is not in the text drops WORDING and leaves others without a span."""
    types = F.create_map(*(F.lit(x) for pair in lx.VERDICT_TYPES.items() for x in pair))
    named = judged.withColumnsRenamed({"en_span": "en_needle", "zh_span": "zh_needle"})
    rows = named.join(pairs.select("run_id", "pair_id", "section", "en_text", "zh_text", "en_page", "zh_page"), ["run_id", "pair_id"]).withColumn("type", F.element_at(types, F.col("verdict"))).where(F.col("type").isNotNull())
    rows = rows.withColumns({"en_at": find_span("en_text", "en_needle"), "zh_at": find_span("zh_text", "zh_needle")})
    lost = F.coalesce((F.col("en_needle") != "") & F.col("en_at").isNull(), F.lit(False)) | F.coalesce((F.col("zh_needle") != "") & F.col("zh_at").isNull(), F.lit(False))
    told = F.coalesce(F.nullif(F.trim("explanation"), F.lit("")), F.concat(F.initcap(F.replace("verdict", F.lit("_"), F.lit(" "))), F.lit(" between the two versions.")))
    side = lambda s: F.struct(F.col(f"{s}_page").alias("page"), F.col(f"{s}_text").alias("text"), F.col(f"{s}_at").alias("span")).alias(s)
    return rows.where(~((F.col("verdict") == "WORDING") & lost)).select("run_id", "pair_id", "section", "type", F.lit("llm").alias("source"), side("en"), side("zh"), told.alias("explanation"), clamp(F.col("confidence"), 0.75).alias("confidence"))


def neighbours(omitted: DataFrame, sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each unpaired sentence the pair of its section that is nearest by order on its own side, with text on the other.

    ``omitted(run_id, sec_id, slot, sid, s_n)``, ``sentences(run_id, slot, sid, s_n)``,
    ``pairs(run_id, sec_id, pair_id, pair_n, en_ids, zh_ids, en_text, zh_text, …)``.
    """
    placed = []
    for slot, other in (("en", "zh"), ("zh", "en")):
        ids = pairs.where(F.size(f"{other}_ids") > 0).select("run_id", "sec_id", "pair_n", F.explode(f"{slot}_ids").alias("sid"), F.col(f"{other}_text").alias("other_text"), F.col(f"{other}_page").alias("other_page"))
        at = ids.join(sentences.where(F.col("slot") == slot).select("run_id", "sid", F.col("s_n").alias("at")), ["run_id", "sid"])
        own = omitted.where(F.col("slot") == slot)
        near = own.join(at.drop("sid"), ["run_id", "sec_id"], "left")
        best = F.min_by(F.struct("other_text", "other_page"), F.struct(F.abs(F.col("at") - F.col("s_n")), "pair_n")).alias("n")
        placed.append(near.groupBy("run_id", "sec_id", "slot", "sid").agg(best).select("run_id", "sec_id", "slot", "sid", F.coalesce("n.other_text", F.lit("")).alias("other_text"), F.col("n.other_page").alias("other_page")))
    return placed[0].unionByName(placed[1])


def full_text(sentences: DataFrame, chars: int = 16_000) -> DataFrame:
    """(run_id, slot, text): the sentences of a document in order, cut after ``chars``: what an omission is looked for in."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_n", "text"))), lambda x: x["text"]), "\n")
    return sentences.groupBy("run_id", "slot").agg(F.substring(listed, 1, chars).alias("text"))


def omission_findings(judgments: DataFrame, omitted: DataFrame, near: DataFrame) -> DataFrame:
    """Omissions that were judged and are not present elsewhere; the own side is marked whole, the other is its neighbour.

    ``judgments(run_id, sentence_id, present_elsewhere, material, reason, confidence)``,
    ``omitted(run_id, sec_id, slot, sid, page, text, section)``.
    """
    kept = judgments.where(~F.coalesce("present_elsewhere", F.lit(False))).withColumnRenamed("sentence_id", "sid")
    rows = omitted.join(kept, ["run_id", "sid"]).join(near, ["run_id", "sec_id", "slot", "sid"], "left")
    own = F.struct("page", "text", F.array(F.lit(0), F.length("text")).alias("span"))
    other = F.struct(F.coalesce("other_page", "page").alias("page"), F.coalesce("other_text", F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("span"))
    is_en = F.col("slot") == "en"
    sure = F.when(F.col("material"), clamp(F.col("confidence"), 0.9)).otherwise(clamp(F.col("confidence"), 0.7))
    return rows.select(
        "run_id", F.col("sid").alias("sentence_id"), "section", F.when(F.col("material"), "OMISSION_MATERIAL").otherwise("OMISSION_MINOR").alias("type"), F.lit("llm").alias("source"),
        F.when(is_en, own).otherwise(other).alias("en"), F.when(is_en, other).otherwise(own).alias("zh"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("Present in one version only.")).alias("explanation"), sure.alias("confidence"),
    )


def union_findings(*tables: DataFrame) -> DataFrame:
    """All findings with one ``input_ord`` for each run: by table, then pair or sentence."""
    columns = ("run_id", "type", "source", "section", "pair_id", "sentence_id", "en", "zh", "explanation", "confidence")
    shaped = []
    for i, t in enumerate(tables):
        extra = {c: F.lit(None).cast("string") for c in columns if c not in t.columns}
        shaped.append(t.withColumns(extra).select(F.lit(i).alias("_t"), (F.col("ord") if "ord" in t.columns else F.lit(0)).alias("_o"), *columns))
    made = shaped[0]
    for t in shaped[1:]:
        made = made.unionByName(t)
    order = W.partitionBy("run_id").orderBy("_t", F.coalesce("pair_id", "sentence_id"), "_o", "type")
    return made.withColumn("input_ord", F.row_number().over(order)).drop("_t", "_o")
