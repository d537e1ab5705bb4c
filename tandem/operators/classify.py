"""Findings: dedupe, escalation, severity, wording, rank, ids, counts.

``findings(run_id, input_ord, type, source, section, pair_id, sentence_id, en, zh,
explanation, confidence)``, en and zh structs of page, text, span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions import lexicons as lx
from tandem.functions.language import modal_pattern

#: Fixed value: what counts as a number in an omission.
NUMBER = r"(?U)\d|[一二兩三四五六七八九十百千]+(?:萬|億|元|股|%|％|個|名|項)|百分之"
RANK = {"Critical": 0, "Material": 1, "Cosmetic": 2}


def key(f: Column | None = None) -> Column:
    return F.coalesce(F.nullif("pair_id", F.lit("")), F.col("sentence_id"), F.lit(""))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def dedupe(findings: DataFrame) -> DataFrame:
    """Deterministic findings distinct by type, key and spans; model findings by type and key, none on a pair that has a deterministic one."""
    det = findings.where(F.col("source") == "deterministic")
    model = findings.where(F.coalesce(F.col("source") != "deterministic", F.lit(True)))
    first = lambda d, *by: d.withColumn("_n", F.row_number().over(W.partitionBy("run_id", *by).orderBy("input_ord"))).where("_n = 1").drop("_n")
    kept = first(det.withColumn("_key", key()), "type", "_key", "en.span", "zh.span").drop("_key")
    flagged = kept.where("pair_id <> ''").select("run_id", "pair_id").distinct()
    rest = model.join(flagged, ["run_id", "pair_id"], "left_anti").select(*findings.columns)
    return kept.unionByName(first(rest.withColumn("_key", key()), "type", "_key").drop("_key"))


def spanned(side: str) -> Column:
    span = F.col(f"{side}.span")
    return F.when(F.size(span) == 2, F.substring(F.col(f"{side}.text"), F.get(span, 0) + 1, F.get(span, 1) - F.get(span, 0))).otherwise("")


def has_term(en: Column, zh: Column, glossary: Column) -> Column:
    """A glossary term of either side occurs; ``glossary`` is an array of struct(en, zh)."""

    def occurs(g: Column) -> Column:
        a, b = F.lower(F.trim(F.coalesce(g["en"], F.lit("")))), F.trim(F.coalesce(g["zh"], F.lit("")))
        return ((F.length(a) > 2) & F.lower(en).contains(a)) | ((F.length(b) > 1) & zh.contains(b))

    return F.coalesce(F.exists(glossary, occurs), F.lit(False))


def with_headings(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """``headings``: the section's name and both headings of the first section that carries it on either side."""
    by = lambda c: sections.select("run_id", F.col(c).alias("section"), F.struct("sec_n", "en_heading", "zh_heading").alias("h"))
    first = by("en_heading").union(by("zh_heading")).groupBy("run_id", "section").agg(F.min_by("h", "h.sec_n").alias("h"))
    joined = findings.join(first, ["run_id", "section"], "left")
    return joined.withColumn("headings", F.concat_ws(" ", "section", "h.en_heading", "h.zh_heading")).drop("h")


def worded(authoritative: Column, name_a: Column, name_b: Column) -> Column:
    """Explanation of an omission from the side that does not prevail: "omitted from …"."""
    text = F.trim(F.coalesce("explanation", F.lit("")))
    no_en, no_zh = F.col("en.span").isNull(), F.col("zh.span").isNull()
    name = F.when((authoritative == "EN") & no_zh & ~no_en, name_b).when((authoritative == "ZH") & no_en & ~no_zh, name_a)
    phrase = F.concat(F.lit("omitted from "), name)
    # fixed values: wording of an omission
    absent = F.regexp_instr(text, F.concat(F.lit(r"(?iU)\b(?:missing|absent|not present|omitted)\s+(?:entirely\s+)?from\s+(?:the\s+)?"), name)) > 0
    pattern = F.concat(F.lit(r"(?isU)^(.*?)\b(?:missing|absent|not present|omitted)\s+(?:entirely\s+)?from\s+(?:the\s+)?"), name, F.lit(r"(?:\s+(?:version|text|section|side))?(?:\s+entirely)?"))
    swapped = F.regexp_replace(text, pattern, F.concat(F.lit("$1"), phrase))
    ended = F.when(swapped.rlike("[.。]$"), swapped).otherwise(F.concat(swapped, F.lit(".")))
    added = F.when(text == "", F.concat(F.lit("O"), F.substring(phrase, F.lit(2), F.length(phrase)), F.lit("."))).otherwise(F.concat(F.regexp_replace(text, "[ .;]+$", ""), F.lit(" — "), phrase, F.lit(".")))
    change = F.col("type").startswith("OMISSION") & name.isNotNull() & ~F.lower(text).contains(F.lower(phrase))
    return F.when(change, F.when(absent, ended).otherwise(added)).otherwise(F.coalesce("explanation", F.lit("")))


def has_modal(text: Column, code: Column | str) -> Column:
    """A modal word of the language occurs (of English for unknown codes)."""
    if isinstance(code, str):
        return text.rlike(modal_pattern(code))
    result = text.rlike(modal_pattern("en"))
    for c in lx.MODALS:
        result = F.when(code == c, text.rlike(modal_pattern(c))).otherwise(result)
    return result


def classify(findings: DataFrame, sections: DataFrame, glossary: DataFrame, runs: DataFrame, codes: tuple[Column | str, Column | str] = ("en", "zh")) -> DataFrame:
    """Ranked findings with ids.  ``runs(run_id, authoritative, name_a, name_b, …)``, ``glossary(run_id, en, zh)``.

    ``codes`` are the languages of the slots, or columns of ``runs``.

    One shuffle by run for the rank; glossaries hold at most 40 terms a run.
    """
    terms = glossary.groupBy("run_id").agg(F.collect_list(F.struct("en", "zh")).alias("terms"))
    kept = with_headings(dedupe(findings), sections).join(terms, "run_id", "left").join(runs, "run_id", "left")
    en_s, zh_s = spanned("en"), spanned("zh")
    some = (en_s != "") | (zh_s != "")
    en, zh = F.when(some, en_s).otherwise(F.coalesce("en.text", F.lit(""))), F.when(some, zh_s).otherwise(F.coalesce("zh.text", F.lit("")))
    months = r"(?i)\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    weighty = F.concat_ws(" ", en, zh).rlike(NUMBER) | en.rlike(months) | has_modal(en, codes[0]) | has_modal(zh, codes[1]) | has_term(en, zh, F.col("terms"))
    kind = F.coalesce("type", F.lit("WORDING"))
    raised = F.when((kind == "OMISSION_MINOR") & weighty, "OMISSION_MATERIAL").otherwise(kind)
    severity = F.when((F.col("type") == "HEDGE_CHANGE") & F.col("headings").rlike(f"(?iU){lx.RISK_HEADING}"), "Critical").otherwise(F.coalesce(F.element_at(_map(lx.SEVERITY), F.col("type")), F.lit("Cosmetic")))
    made = kept.withColumn("type", raised).withColumn("severity", severity).withColumn("explanation", worded(F.col("authoritative"), F.col("name_a"), F.col("name_b")))
    return ranked(made)


def ranked(findings: DataFrame) -> DataFrame:
    """By severity, page, key and type; ids f_001 … for each run."""
    page = F.coalesce("en.page", "zh.page", F.lit(10**6))
    severity = F.coalesce(F.element_at(_map(RANK), F.col("severity")), F.lit(3))
    source_ord = F.when(F.col("source") == "deterministic", 0).otherwise(1)
    n = F.row_number().over(W.partitionBy("run_id").orderBy(severity, page, key(), F.col("type"), source_ord, F.col("input_ord")))
    side = lambda s: F.struct(F.col(f"{s}.page").alias("page"), F.coalesce(F.col(f"{s}.text"), F.lit("")).alias("text"), F.col(f"{s}.span").alias("span")).alias(s)
    fields = [F.format_string("f_%03d", n).alias("id"), "type", "severity", F.coalesce("source", F.lit("llm")).alias("source"), F.coalesce("section", F.lit("")).alias("section"), "pair_id", "sentence_id", side("en"), side("zh"), "explanation"]
    review = [F.lit("unreviewed").alias("status"), F.lit(None).cast("string").alias("dismiss_reason"), F.lit(None).cast("string").alias("note")]
    return findings.select("run_id", *fields, F.bround(F.coalesce("confidence", F.lit(1.0)), 2).alias("confidence"), *review)


def recount(findings: DataFrame, unaligned: DataFrame | None = None) -> DataFrame:
    """Counts by severity, reviewed and total for each run, and its unaligned sections."""
    made = findings.groupBy("run_id").agg(
        *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in RANK), F.count_if(F.coalesce(F.col("status"), F.lit("unreviewed")) != "unreviewed").alias("reviewed"), F.count(F.lit(1)).alias("total")
    )
    if unaligned is None:
        return made.withColumn("unaligned_sections", F.lit(0).cast("bigint"))
    n = unaligned.groupBy("run_id").agg(F.count(F.lit(1)).alias("unaligned_sections"))
    joined = made.join(n, "run_id", "full")
    return joined.select("run_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "material", "cosmetic", "reviewed", "total", "unaligned_sections")))


def fallback_classify(findings: DataFrame) -> DataFrame:
    """Severity by type, distinct by key and type, ranked: what is left when nothing else is known of a run."""
    first = F.row_number().over(W.partitionBy("run_id", key(), "type").orderBy("input_ord"))
    kept = findings.withColumn("_n", first).where("_n = 1").drop("_n")
    return ranked(kept.withColumn("severity", F.coalesce(F.element_at(_map(lx.SEVERITY), F.col("type")), F.lit("Cosmetic"))))


def export_gate(findings: DataFrame) -> DataFrame:
    """Whether every Critical finding of a run is decided."""
    return findings.groupBy("run_id").agg(F.bool_and((F.col("severity") != "Critical") | (F.col("status") != "unreviewed")).alias("ready"))
