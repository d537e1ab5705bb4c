"""A whole audit: layout lines of document pairs to ranked findings and run objects.

One lazily built plan for all runs; the run id is the key of every shuffle, so
thousands of runs go through one job.  Meaning judgments come from a provider,
alignments from proposals or from sentence lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.language import detect_language, is_cjk, short_name
from tandem.operators import align, checks, classify, judge, layout
from tandem.sources.scratch import materialize

DOC = ["run_id", "slot"]

#: Characters of a text for each character of Chinese or Japanese that says the same.
CJK_RATIO = 3.0


@dataclass(frozen=True)
class Audit:
    languages: DataFrame
    blocks: DataFrame
    sentences: DataFrame
    sections: DataFrame
    pairs: DataFrame
    unaligned_sections: DataFrame
    unaligned_sentences: DataFrame
    glossary: DataFrame
    meta: DataFrame
    findings: DataFrame
    counts: DataFrame

    def totals(self) -> DataFrame:
        """(run_id, sections, pairs, glossary, unpaired, flagged, findings): what progress reports after each stage."""
        parts = {"sections": self.sections, "pairs": self.pairs, "glossary": self.glossary, "unpaired": self.unaligned_sentences, "flagged": self.findings.where("source = 'llm'"), "findings": self.findings}
        made = self.meta.select("run_id")
        for name, rows in parts.items():
            made = made.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left")
        return made.na.fill(0)

    def runs(self) -> DataFrame:
        """Run objects: meta, counts, findings, glossary, unaligned sections."""
        listed = lambda d, name, *cols: d.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        found = listed(self.findings, "findings", *(c for c in self.findings.columns if c != "run_id"))
        terms = self.glossary.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "en", "zh"))), lambda g: F.struct(g["en"].alias("en"), g["zh"].alias("zh"))).alias("glossary"))
        missing = listed(self.unaligned_sections, "unaligned_sections", F.col("slot").alias("lang"), "heading", "page")
        counts = self.counts.select("run_id", F.struct(*(c for c in self.counts.columns if c != "run_id")).alias("counts"))
        meta = self.meta.select("run_id", F.struct(*(c for c in self.meta.columns if c != "run_id")).alias("meta"))
        joined = meta
        for part in (counts, found, terms, missing):
            joined = joined.join(part, "run_id", "left")
        return joined.withColumn("status", F.lit("done"))


def detect(lines: DataFrame) -> DataFrame:
    """(run_id, slot, code, name, script) by the first 4000 characters of each document."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block_no", "line_no", "text"))), lambda x: x["text"]), " ")
    sample = lines.groupBy(*DOC).agg(F.substring(text, 1, 4000).alias("sample"))
    return sample.select(*DOC, detect_language(F.col("sample")).alias("l")).select(*DOC, "l.*")


def _by_slot(d: DataFrame, *columns: str) -> DataFrame:
    """One row a run with the columns of both slots, as ``en_…`` and ``zh_…``."""
    side = lambda s: d.where(F.col("slot") == s).select("run_id", *(F.col(c).alias(f"{s}_{c}") for c in columns))
    return side("en").join(side("zh"), "run_id", "full")


def match_sections(heads: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(run_id, sec_id, sec_n, en_ord, zh_ord, en_heading, zh_heading, score): accepted proposals, else sections whose headings go together.

    ``heads(run_id, slot, sec_ord, heading)``; place 0 is the text before the
    first heading, matched only if both sides have it.
    """
    side = lambda s: heads.where(F.col("slot") == s).select("run_id", F.col("sec_ord").cast("int").alias(f"{s}_ord"), F.col("heading").alias(f"{s}_heading"))
    en, zh = side("en"), side("zh")
    n = heads.where("sec_ord > 0").groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("slot") == "en", F.col("sec_ord"))), F.lit(0)).cast("int").alias("n_en"), F.coalesce(F.max(F.when(F.col("slot") == "zh", F.col("sec_ord"))), F.lit(0)).cast("int").alias("n_zh"))
    found = align.propose_sections(heads)
    if proposed is not None:
        found = proposed.select(*found.columns).unionByName(found.join(proposed.select("run_id").distinct(), "run_id", "left_anti"))
    taken = align.accept_matches(found, n).select("run_id", (F.col("i") + 1).alias("en_ord"), (F.col("j") + 1).alias("zh_ord"), "score")
    named = taken.join(en, ["run_id", "en_ord"]).join(zh, ["run_id", "zh_ord"])
    preamble = en.where("en_ord = 0").join(zh.where("zh_ord = 0"), "run_id").withColumn("score", F.lit(1.0))
    placed = named.unionByName(preamble)
    return placed.select("run_id", F.format_string("sec_%d", "en_ord").alias("sec_id"), F.col("en_ord").alias("sec_n"), "en_ord", "zh_ord", F.coalesce("en_heading", F.lit("")).alias("en_heading"), F.coalesce("zh_heading", F.lit("")).alias("zh_heading"), "score")


def audit(
    lines: DataFrame,
    provider: judge.JudgmentProvider | None = None,
    omissions: DataFrame | None = None,
    proposed_sections: DataFrame | None = None,
    proposed_pairs: DataFrame | None = None,
    proposed_terms: DataFrame | None = None,
    authoritative: Column | None = None,
) -> Audit:
    """All stages over ``lines`` (see ``layout``).  ``omissions`` are judgments of unpaired sentences."""
    languages = materialize(detect(lines))
    blocks, sentences = map(materialize, layout.layout(lines, languages.select(*DOC, "script")))
    placed = materialize(align.section_sentences(blocks, sentences))
    heads = placed.groupBy(*DOC, "sec_ord").agg(F.first("heading").alias("heading"), F.coalesce(F.first("heading_page"), F.min("page")).alias("page"))
    empty = align.section_spans(blocks).where("is_heading").select(*DOC, "sec_ord", F.col("text").alias("heading"), "page").join(heads.select(*DOC, "sec_ord"), [*DOC, "sec_ord"], "left_anti")
    heads = materialize(heads.unionByName(empty))
    sections = materialize(match_sections(heads, proposed_sections))

    in_section = lambda s: placed.where(F.col("slot") == s).join(sections.select("run_id", F.col(f"{s}_ord").alias("sec_ord"), "sec_id", "sec_n", "en_heading", "zh_heading"), ["run_id", "sec_ord"])
    matched = in_section("en").unionByName(in_section("zh")).join(languages.select(*DOC, "script"), DOC)
    widths = matched.withColumn("text", F.when(is_cjk(F.col("script")), F.repeat("text", F.lit(int(CJK_RATIO)))).otherwise(F.col("text")))
    by_length = align.align_by_length(widths)
    if proposed_pairs is not None:
        known = align.accept_pairs(proposed_pairs)
        by_length = known.unionByName(by_length.join(known.select("run_id", "sec_id").distinct(), ["run_id", "sec_id"], "left_anti"))
    section = F.coalesce(F.nullif("en_heading", F.lit("")), F.col("zh_heading"))
    pairs = materialize(align.number_pairs(by_length.join(sections.drop("score"), ["run_id", "sec_id"])).withColumn("section", section))
    texts = materialize(checks.pair_texts(pairs.select("run_id", "sec_id", "sec_n", "section", "pair_id", "pair_n", "en_ids", "zh_ids"), sentences.join(languages.select(*DOC, "script"), DOC)))

    both = _by_slot(languages, "code", "name", "script")
    named = texts.join(both.select("run_id", "en_code", "zh_code", short_name(F.col("en_name")).alias("name_a"), short_name(F.col("zh_name")).alias("name_b")), "run_id")
    # patterns are literals: one branch for each pair of languages that occurs, of a bounded number
    met = sorted((r.en_code, r.zh_code) for r in both.select("en_code", "zh_code").distinct().na.drop().collect())
    names = (F.col("name_a"), F.col("name_b"))
    found = [checks.run_checks(named.where((F.col("en_code") == a) & (F.col("zh_code") == b)), (a, b), names) for a, b in met] or [checks.run_checks(named.limit(0), ("en", "zh"), names)]
    if provider is not None:
        found.append(judge.pair_findings(judge.cascade(texts, provider), texts))
    left = align.unpaired(matched.select("run_id", "sec_id", "slot", "sid", "s_n", "page", "text", section.alias("section")), pairs)
    if omissions is not None:
        found.append(judge.omission_findings(omissions, left, judge.neighbours(left, sentences, texts)))

    defined = align.definitions_text(blocks).select(*DOC, align.terms(F.col("text")).alias("terms"))
    glossary = align.glossary(_by_slot(defined, "terms"), proposed_terms)
    prevailing = align.prevailing(blocks)
    choice = F.coalesce(authoritative, align.slot_of(F.col("code"), F.col("en_code"), F.col("zh_code"))) if authoritative is not None else align.slot_of(F.col("code"), F.col("en_code"), F.col("zh_code"))
    titles = _by_slot(align.document_meta(blocks), "title", "stock_code", "company")
    pages = _by_slot(lines.groupBy(*DOC).agg(F.max("page").alias("pages")), "pages")
    meta = both.join(prevailing, "run_id", "left").join(titles, "run_id", "left").join(pages, "run_id", "left")
    meta = meta.select("run_id", "en_title", "zh_title", F.coalesce("en_company", "zh_company").alias("company"), F.coalesce("en_stock_code", "zh_stock_code").alias("stock_code"), F.coalesce(choice, F.lit("none")).alias("authoritative"), F.col("code").isNotNull().alias("authoritative_detected"), "en_pages", "zh_pages", *(f"{s}_{c}" for s in ("en", "zh") for c in ("code", "name", "script")))

    runs = meta.select("run_id", "authoritative", short_name(F.col("en_name")).alias("name_a"), short_name(F.col("zh_name")).alias("name_b"), "en_code", "zh_code")
    findings = materialize(classify.classify(materialize(judge.union_findings(*found)), sections, glossary, runs, (F.col("en_code"), F.col("zh_code"))))
    used = sections.select("run_id", F.lit("en").alias("slot"), F.col("en_ord").alias("sec_ord")).union(sections.select("run_id", F.lit("zh"), "zh_ord"))
    missing = heads.where("sec_ord > 0").join(used, [*DOC, "sec_ord"], "left_anti").select(*DOC, "heading", "page")
    return Audit(languages, blocks, sentences, sections, texts, missing, left.select("run_id", "slot", "sid", "sec_id"), glossary, meta, findings, classify.recount(findings, missing))
