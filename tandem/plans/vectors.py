"""Registered queries over fixed cases: what each operator gives for inputs that the tables do not hold.

The SQL states the expected rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import language as lg
from tandem.functions import tokens as tk
from tandem.operators import align, checks, classify, judge, layout, prompts, report
from tandem.plans.catalog import query
from tandem.sources import runs as src
from tandem.streaming import review


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def rows_sql(columns: str, rows: Sequence[tuple]) -> str:
    """DuckDB: a table of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


def cases(name: str, columns: str, expected: Sequence[tuple]) -> Callable:
    return query(name, rows_sql(columns, expected))


def shown(span: Column) -> Column:
    """A span as start-end, or the empty text."""
    return F.coalesce(F.concat_ws("-", F.get(span, 0), F.get(span, 1)), F.lit(""))


# -- pairs and tokens ---------------------------------------------------------------

N, D, C = "NUMBER_MISMATCH", "DATE_MISMATCH", "CURRENCY_MISMATCH"
_S, _T = "\u202f", "\u00a0"
#: Languages, the two texts, and the findings as (type, span, span).
PAIRS = [
    ("en", "zh", "The consideration is HK$12.4 million.", "代價為港幣1,210萬元。", [(N, "21-36", "3-12")]), ("en", "zh", "The consideration is HK$12,100,000.", "代價為港幣1,210萬元。", []), ("en", "zh", "Completion by 24 September 2026 and 60% of all", "二零二六年九月二十四日完成，佔百分之六十", []),
    ("en", "zh", "The long stop date is 30 September 2026.", "最後截止日期為2026年9月24日。", [(D, "22-39", "7-17")]), ("en", "zh", "under Rule 14.07(1), Chapter 14A and paragraph 2 (1) first", "根據第14.07(1)條、第14A章", []), ("en", "zh", "revenue of HK$1.2 billion", "收入為港幣12億元", []),
    ("en", "zh", "July 5, 2026", "2026年7月5日", []), ("en", "zh", "on 5/7/2026", "於2026年5月7日", [(D, "3-11", "1-10")]), ("en", "zh", "US$5 million", "港幣500萬元", [(C, "0-3", "0-2")]), ("en", "zh", "Revenue was 3,456 units.", "收入增加。", [(N, "12-17", "")]),
    ("en", "zh", "It is fully consistent.", "一般而言十分一致。", []), ("en", "zh", "RMB9,300,000", "人民幣930萬元", []), ("en", "zh", "Q3 results rose by 5%", "Q3業績上升5%", []), ("en", "zh", "\U0001f600 It costs 12 units", "成本為15個", [(N, "11-13", "3-5")]), ("en", "zh", "on 31 February 2026", "2026年2月31日", []),
    ("en", "fr", "a price of 1,234,567.89 euros", f"un prix de 1{_S}234{_T}567,89 euros", []), ("en", "fr", "EUR 12.4 million", "12,1 millions d'euros", [(N, "0-16", "0-13")]), ("en", "fr", "on 24 September 2026", "le 24 septembre 2026, article 12, le 1er rang", []),
    ("en", "de", "HK$2,500 and 60 per cent", "HKD 2.500 und 60 Prozent", []), ("en", "de", "on 24 September 2026", "am 25.09.2026", [(D, "3-20", "3-13")]), ("en", "de", "CHF 1,234,567.89", "CHF 1'234'567.89", []), ("en", "it", "2 billion", "2 miliardi", []), ("en", "es", "12.4 million", "12,4 millones", []),
]


@cases("check_vectors", "case_no, type, en_span, zh_span", [(i, *f) for i, p in enumerate(PAIRS) for f in p[4]])
def check_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of pairs in several notations; most have none."""
    frame = spark.createDataFrame([(i, *p[:4]) for i, p in enumerate(PAIRS)], "case_no int, ca string, cb string, a string, b string")
    made = None
    for a, b in dict.fromkeys(p[:2] for p in PAIRS):
        rows = frame.where((F.col("ca") == a) & (F.col("cb") == b)).select("case_no", F.explode(checks.check_pair(F.col("a"), F.col("b"), a, b)).alias("f"))
        made = rows if made is None else made.union(rows)
    return made.select("case_no", "f.type", shown(F.col("f.en_span")).alias("en_span"), shown(F.col("f.zh_span")).alias("zh_span"))


#: Language, text, and the numbers as (value, kind, text).
NUMBERS = [
    ("en", "a loss of US$(1.5) million or 3.5% of all", [(-1500000.0, "scaled", "US$(1.5) million"), (3.5, "pct", "3.5%")]), ("en", "Rule 14, the 3rd part, B2B and (2) the rest", []), ("en", "12 per cent of 1,000", [(12.0, "pct", "12 per cent"), (1000.0, "plain", "1,000")]),
    ("fr", "1 234,5 millions et 12 %", [(1234500000.0, "scaled", "1 234,5 millions"), (12.0, "pct", "12 %")]), ("de", "1.234,56 Mio. und 5 Prozent", [(1234560000.0, "scaled", "1.234,56 Mio."), (5.0, "pct", "5 Prozent")]), ("zh", "增長百分之十二，共三億元", [(12.0, "pct", "百分之十二"), (300000000.0, "cjk", "三億元")]),
]
#: Language, text, and the dates.
DATES = [
    ("en", "on 5 July 2026, July 6th, 2026, 7/8/2026 and 2026-09-10", ["2026-07-05", "2026-07-06", "2026-08-07", "2026-09-10"]), ("fr", "le 1er août 2026 et 02.03.2026", ["2026-08-01", "2026-03-02"]), ("de", "am 3. März 2026, 4-5-2026", ["2026-03-03", "2026-05-04"]),
    ("it", "il 6 gennaio 2026", ["2026-01-06"]), ("es", "el 7 de enero de 2026", ["2026-01-07"]), ("pt", "em 8 de março de 2026", ["2026-03-08"]), ("nl", "op 9 mei 2026", ["2026-05-09"]), ("zh", "二零二六年十月十一日及2026年1月2日", ["2026-10-11", "2026-01-02"]),
]


def _by_code(spark: SparkSession, rows: list, extract: Callable[[Column, str], Column]) -> DataFrame:
    made = None
    for i, r in enumerate(rows):
        one = spark.createDataFrame([(i, r[1])], "case_no int, text string").select("case_no", F.posexplode(extract(F.col("text"), r[0])).alias("pos", "x"))
        made = one if made is None else made.union(one)
    return made


@cases("number_vectors", "case_no, pos, value, kind, raw", [(i, n, *x) for i, r in enumerate(NUMBERS) for n, x in enumerate(r[2])])
def number_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with scale words, brackets and percentages; references, ordinals and list markers are none."""
    return _by_code(spark, NUMBERS, lambda t, c: tk.numbers(t, c, tk.none_of(tk.DATE))).select("case_no", "pos", F.round("x.value", 6).alias("value"), "x.kind", F.trim("x.raw").alias("raw"))


@cases("date_vectors", "case_no, pos, iso", [(i, n, x) for i, r in enumerate(DATES) for n, x in enumerate(r[2])])
def date_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the notations of eight languages."""
    return _by_code(spark, DATES, tk.dates).select("case_no", "pos", "x.iso")


# -- languages ----------------------------------------------------------------------

LANGUAGES = [
    ("The company shall pay the amount in full, and that is all of it.", "en", "Latn"), ("La société a été informée que le prix est dans les comptes de la banque.", "fr", "Latn"), ("Die Gesellschaft hat den Vertrag mit der Bank nicht unterzeichnet und wird es nicht tun.", "de", "Latn"),
    ("Il contratto è stato firmato con la società e non è più in vigore.", "it", "Latn"), ("El contrato se firmó con la sociedad y no es válido para los socios.", "es", "Latn"), ("O contrato não foi assinado com a sociedade e não é mais válido para os sócios.", "pt", "Latn"),
    ("De overeenkomst is niet ondertekend en het bedrag wordt door de bank betaald.", "nl", "Latn"), ("本公司於二零二六年公佈業績，這個董事會認為條款公平合理。", "zh", "Hant"), ("这个公司于二零二六年发布业绩，董事会认为条款公平合理。", "zh", "Hans"), ("これは日本語の文章です。会社は発表しました。", "ja", "Jpan"),
    ("이 회사는 오늘 발표했습니다 그리고 계속합니다", "ko", "Hang"), ("xyzzy qwerty", "und", "Zyyy"), ("", "und", "Zyyy"), (None, "und", "Zyyy"), ("12345 !!", "und", "Zyyy"),
]


@cases("language_vectors", "case_no, code, script", [(i, *r[1:]) for i, r in enumerate(LANGUAGES)])
def language_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and scripts of short texts."""
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LANGUAGES)], "case_no int, text string")
    return frame.select("case_no", lg.detect_language(F.col("text")).alias("x")).select("case_no", "x.code", "x.script")


SENTENCES = [
    ("Mr. Smith of No. 5 came. He left! \"Why?\" It is approx. This.", "Latn", ["Mr. Smith of No. 5 came.", "He left!", "\"Why?\" It is approx. This."]), ("Un prix. Évident. « Oui. » Non", "Latn", ["Un prix.", "Évident.", "« Oui. » Non"]),
    ("甲公司宣佈收購。是。乙公司同意所有條款；好！完成日期待定", "Hant", ["甲公司宣佈收購。是。", "乙公司同意所有條款；好！", "完成日期待定"]), ("是。甲公司宣佈收購。", "Hans", ["是。", "甲公司宣佈收購。"]), ("  ", "Latn", []),
]


@cases("sentence_vectors", "case_no, pos, text", [(i, n, x) for i, r in enumerate(SENTENCES) for n, x in enumerate(r[2])])
def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of Latin and Chinese texts."""
    frame = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(SENTENCES)], "case_no int, text string, script string")
    return frame.select("case_no", F.posexplode(lg.sentences(F.col("text"), lg.is_cjk(F.col("script")))).alias("pos", "text"))


# -- layout -------------------------------------------------------------------------


def _line(page: int, block: int, no: int, text: str, size: float = 10.0, bold: bool = False, y: float = 100.0, slot: str = "en") -> tuple:
    return ("r", slot, page, block, no, text, size, bold, 50.0, y, 300.0, y + size)


LINES = [
    *(_line(p, 0, 0, "Example Holdings Limited", y=20.0) for p in (1, 2, 3)), *(_line(p, 9, 0, f"Page {p} of 3", y=800.0) for p in (1, 2, 3)), _line(1, 1, 0, "1. Terms", bold=True, y=50.0), _line(1, 1, 1, "The buyer shall pay the price in full when due.", y=72.0), _line(1, 1, 2, "It was signed by Mr. Lee. All agree.", y=84.0),
    _line(1, 2, 0, "This line continues the paragraph before it.", y=97.0), _line(1, 3, 0, "BIG TITLE", size=18.0, y=200.0), _line(2, 1, 0, "A second page with some more text for the body.", y=60.0), _line(1, 1, 0, "一、條款", y=60.0, slot="zh"), _line(1, 2, 0, "買方須支付", y=150.0, slot="zh"),
    _line(1, 2, 1, "全部價款。賣方須交付股份。好。", y=162.0, slot="zh"),
]
BLOCKS = [
    ("en_b1", "1. Terms", 1), ("en_b2", "The buyer shall pay the price in full when due. It was signed by Mr. Lee. All agree. This line continues the paragraph before it.", 0), ("en_b3", "BIG TITLE", 1), ("en_b4", "A second page with some more text for the body.", 0), ("zh_b1", "一、條款", 1), ("zh_b2", "買方須支付全部價款。賣方須交付股份。好。", 0),
]
LAID = [
    ("en_s1", "en_b2", "The buyer shall pay the price in full when due."), ("en_s2", "en_b2", "It was signed by Mr. Lee."), ("en_s3", "en_b2", "All agree."), ("en_s4", "en_b2", "This line continues the paragraph before it."), ("en_s5", "en_b4", "A second page with some more text for the body."), ("zh_s1", "zh_b2", "買方須支付全部價款。"), ("zh_s2", "zh_b2", "賣方須交付股份。好。"),
]


def _laid(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    scripts = spark.createDataFrame([("r", "en", "Latn"), ("r", "zh", "Hant")], "run_id string, slot string, script string")
    return layout.layout(spark.createDataFrame(LINES, src.LINES), scripts)


@cases("layout_blocks", "block_id, text, heading", BLOCKS)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three pages: headers and page numbers go, a block splits after its bold lead, neighbours merge."""
    return _laid(spark)[0].select("block_id", "text", F.col("is_heading").cast("int").alias("heading"))


@cases("layout_numbered", "sid, block_id, text", LAID)
def layout_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of these blocks, numbered across the document."""
    return _laid(spark)[1].select("sid", "block_id", "text")


@cases("span_lines", "text, size, bold, x1, y0", [("Total of the price", 10.0, 0, 9.0, 1.0)])
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line made of two spans."""
    spans = [("r", "en", 1, 0, 0, 0, "Total  ", 12.04, True, 1.0, 2.0, 3.0, 4.0), ("r", "en", 1, 0, 0, 1, "of the price", 10.0, False, 3.0, 1.0, 9.0, 4.0)]
    frame = spark.createDataFrame(spans, "run_id string, slot string, page int, block_no int, line_no int, span_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    return layout.project_lines(frame).select("text", "size", F.col("bold").cast("int").alias("bold"), "x1", "y0")


# -- alignment ----------------------------------------------------------------------

ALIGNED = {"en": ["Price is 5 dollars and no more.", "Closing is on day 12 of June.", "An extra remark that stands alone in this version and nowhere else."], "zh": ["價格為5元正。", "於六月12日完成。"]}


@cases("aligned_pairs", "pair_id, en, zh", [("p_001", "en_s1", "zh_s1"), ("p_002", "en_s2", "zh_s2"), ("unpaired", "en_s3", "")])
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences aligned by length and digits, numbered, and what is left over."""
    rows = [("r", "sec_1", s, f"{s}_s{i}", i, t) for s, ts in ALIGNED.items() for i, t in enumerate(ts, 1)]
    sentences = spark.createDataFrame(rows, "run_id string, sec_id string, slot string, sid string, s_n int, text string")
    pairs = align.number_pairs(align.align_by_length(sentences, ratio=3.0).withColumn("sec_n", F.lit(1)))
    left = align.unpaired(sentences, pairs).select(F.lit("unpaired").alias("pair_id"), F.col("sid").alias("en"), F.lit("").alias("zh"))
    return pairs.select("pair_id", F.array_join("en_ids", "+").alias("en"), F.array_join("zh_ids", "+").alias("zh")).union(left)


@cases("accepted_pairs", "ord, en, zh", [(0, "a+b", "x"), (1, "c", "y")])
def accepted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed pairs without the sentences that an earlier one has."""
    pairs = [("r", "s", 0, ["a", "b"], ["x"], 0.9), ("r", "s", 1, ["b", "c"], ["y"], 0.9), ("r", "s", 2, ["a"], ["z"], 0.9)]
    kept = align.accept_pairs(spark.createDataFrame(pairs, "run_id string, sec_id string, ord int, en_ids array<string>, zh_ids array<string>, score double"))
    return kept.select("ord", F.array_join("en_ids", "+").alias("en"), F.array_join("zh_ids", "+").alias("zh"))


HEADS = [("en", ["1. Terms", "2. Risks", "3. Fees", "Closing"]), ("zh", ["一、條款", "附加 A", "二、風險", "三、費用", "完成"])]


@cases("proposed_sections", "i, j, score", [(0, 0, 0.9), (1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.7)])
def proposed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that go together; a section that one side lacks shifts none."""
    heads = spark.createDataFrame([("r", s, n, t) for s, ts in HEADS for n, t in enumerate(ts, 1)], "run_id string, slot string, sec_ord int, heading string")
    return align.propose_sections(heads).select("i", "j", "score")


@cases("defined_terms", "pos, term", list(enumerate(["Buyer", "Seller", "Prix", "Preis", "買方"])))
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined terms by all patterns, the first of equal ones."""
    text = '"Buyer" means X. “Seller” shall mean Y. „Preis“ bedeutet Z. «Prix» désigne P. 「買方」指甲。"Buyer" means again'
    return spark.range(1).select(F.posexplode(align.terms(F.lit(text))).alias("pos", "term"))


# -- judgments ----------------------------------------------------------------------

PAIR = "run_id string, sec_id string, section string, pair_id string, pair_n int, en_ids array<string>, zh_ids array<string>, en_text string, zh_text string, en_page int, zh_page int"
JUDGED = [
    ("r", "triage", "p_001", "EQUIVALENT", None, None, None, 0.9), ("r", "triage", "p_002", "HEDGE_CHANGE", "may", None, " ", None), ("r", "strong", "p_002", "MEANING_SHIFT", "the BUYER may", None, "", 1.7), ("r", "triage", "p_003", "WORDING", "absent", None, "x", 0.5),
    ("r", "triage", "p_004", "PARTIAL_OMISSION", "absent", None, "x", 0.5), ("r", "triage", "p_005", "SCOPE_CHANGE", None, None, "x", 0.5), ("r", "strong", "p_005", "EQUIVALENT", None, None, "x", 0.5),
]


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", "s", "Terms", f"p_{n:03d}", n, [f"en_s{n}"], [f"zh_s{n}"], f"The  buyer may pay {n}.", f"買方可支付{n}", 1, 2) for n in range(1, 6)], PAIR)


@cases("judged_pairs", "pair_id, type, en_span, confidence, explanation", [("p_002", "MEANING_SHIFT", "0-14", 1.0, "Meaning Shift between the two versions."), ("p_004", "OMISSION_MINOR", "", 0.5, "x")])
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two tiers of judgments; quotations are found whatever their case and white space."""
    rows = spark.createDataFrame(JUDGED, "run_id string, tier string, pair_id string, verdict string, en_span string, zh_span string, explanation string, confidence double")
    found = judge.pair_findings(judge.cascade(_pairs(spark), judge.recorded_provider(rows)), _pairs(spark))
    return found.select("pair_id", "type", shown(F.col("en.span")).alias("en_span"), "confidence", "explanation")


@cases("judged_omissions", "sid, type, en_span, zh_span, other, confidence", [("en_s9", "OMISSION_MATERIAL", "0-14", "", "買方可支付5", 0.9), ("zh_s7", "OMISSION_MINOR", "", "0-2", "The  buyer may pay 5.", 0.4)])
def judged_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omissions that are not present elsewhere, beside the nearest pair's text."""
    omitted = spark.createDataFrame([("r", "s", "en", "en_s9", 9, 3, "Left out here.", "Terms"), ("r", "s", "en", "en_s8", 8, 3, "Elsewhere.", "Terms"), ("r", "s", "zh", "zh_s7", 7, 4, "遺漏", "Terms")], "run_id string, sec_id string, slot string, sid string, s_n int, page int, text string, section string")
    sentences = spark.createDataFrame([("r", s, f"{s}_s{n}", n) for s in ("en", "zh") for n in range(1, 10)], "run_id string, slot string, sid string, s_n int")
    judged = spark.createDataFrame([("r", "en_s9", False, True, " Why ", None), ("r", "en_s8", True, True, "x", 0.5), ("r", "zh_s7", False, False, None, 0.4)], "run_id string, sentence_id string, present_elsewhere boolean, material boolean, reason string, confidence double")
    found = judge.union_findings(judge.omission_findings(judged, omitted, judge.neighbours(omitted, sentences, _pairs(spark))))
    return found.select(F.col("sentence_id").alias("sid"), "type", shown(F.col("en.span")).alias("en_span"), shown(F.col("zh.span")).alias("zh_span"), F.when(F.col("sentence_id").startswith("en"), F.col("zh.text")).otherwise(F.col("en.text")).alias("other"), "confidence")


@cases("request_batches", "batch_no, n_pairs, asks", [(0, 5, 1)])
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a section's pairs, each naming its pairs once."""
    names = spark.createDataFrame([("r", "English", "Chinese")], "run_id string, name_a string, name_b string")
    made = prompts.judgment_requests(_pairs(spark), names)
    return made.select("batch_no", F.size(F.regexp_extract_all("prompt", F.lit(r"\[p_\d+\]"), F.lit(0))).alias("n_pairs"), F.col("prompt").contains("English").cast("int").alias("asks"))


@cases("parsed_responses", "pair_id, verdict, confidence", [("p_001", "WORDING", 0.5)])
def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments read from responses; malformed ones give none."""
    rows = [("r", "triage", '{"results": [{"pair_id": "p_001", "verdict": "WORDING", "confidence": 0.5}, {"verdict": "X"}]}'), ("r", "triage", "{nope"), ("r", "triage", None)]
    return src.parse_judgments(spark.createDataFrame(rows, "run_id string, tier string, response string")).select("pair_id", "verdict", "confidence")


@cases("valid_responses", "case_no, valid", [(0, 1), (1, 0), (2, 0), (3, 0)])
def valid_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses against the keys and types that are required."""
    shapes = spark.createDataFrame(list(enumerate(['{"a": [1], "b": "x"}', '{"a": 1, "b": "x"}', "[]", '{"a": []}'])), "case_no int, t string")
    return shapes.select("case_no", src.valid_response(F.col("t"), {"a": "array", "b": "string"}).cast("int").alias("valid"))


# -- findings and reports -----------------------------------------------------------

SIDE = "struct<page:int,text:string,span:array<int>>"
FINDINGS = f"run_id string, input_ord int, type string, source string, pair_id string, sentence_id string, section string, en {SIDE}, zh {SIDE}, explanation string, confidence double"
_NONE = (1, "", None)
RAW = [
    ("r", 1, "OMISSION_MINOR", "llm", None, "en_s1", "Terms", (1, "The buyer shall pay.", [0, 20]), _NONE, "It is missing from the Chinese version.", 0.834), ("r", 2, "OMISSION_MINOR", "llm", None, "en_s2", "Terms", (1, "Just some words here.", [0, 21]), _NONE, "", 0.834),
    ("r", 3, "OMISSION_MINOR", "llm", None, "en_s3", "Terms", (1, "The Escrow Agent of old.", [0, 24]), _NONE, "Gone", 0.834), ("r", 4, "HEDGE_CHANGE", "llm", "p_001", None, "Terms", (1, "It may.", [0, 6]), (1, "可", [0, 1]), "Differs.", 0.5), ("r", 5, "HEDGE_CHANGE", "llm", "p_002", None, "Prices", (1, "It may.", [0, 6]), (1, "可", [0, 1]), "Differs.", 0.5),
]


@cases(
    "escalated_findings", "key, type, severity, explanation, confidence",
    [("en_s1", "OMISSION_MATERIAL", "Critical", "It is omitted from Chinese.", 0.83), ("en_s2", "OMISSION_MINOR", "Cosmetic", "Omitted from Chinese.", 0.83), ("en_s3", "OMISSION_MATERIAL", "Critical", "Gone — omitted from Chinese.", 0.83), ("p_001", "HEDGE_CHANGE", "Critical", "Differs.", 0.5), ("p_002", "HEDGE_CHANGE", "Material", "Differs.", 0.5)],
)
def escalated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omissions raised by modal words and glossary terms, hedges by a risk heading, wording by the side that prevails."""
    made = classify.classify(
        spark.createDataFrame(RAW, FINDINGS), spark.createDataFrame([("r", 1, "Terms", "風險因素"), ("r", 2, "Prices", "價格")], "run_id string, sec_n int, en_heading string, zh_heading string"),
        spark.createDataFrame([("r", "Escrow Agent", "託管代理")], "run_id string, en string, zh string"), spark.createDataFrame([("r", "EN", "English", "Chinese")], "run_id string, authoritative string, name_a string, name_b string"),
    )
    return made.select(F.coalesce("sentence_id", "pair_id").alias("key"), "type", "severity", "explanation", "confidence")


def _run(spark: SparkSession) -> DataFrame:
    side = lambda text, span: (1, text, span)
    found = [(f"f_{n}", N, severity, "deterministic", "S", "p_001", None, side("a <b> HK$5", [6, 10]), side("五元", None), "x & y", 1.0, status, None, "n'") for n, severity, status in ((1000, "Cosmetic", "confirmed"), (999, "Cosmetic", "unreviewed"), (2, "Critical", "unreviewed"))]
    rows = [("r", "done", None, "2026-01-02T03:04:05Z", ("T", None, "A & B", None, "EN", True, 1, 1, ([], []), (("en", "English", "Latn"), ("zh", "Chinese (Traditional)", "Hant")), 1.5), (1, 0, 2, 0, 1, 3), found, [], [("a", "b")])]
    return spark.createDataFrame(rows, src.RUN)


@cases("rendered_report", "ids, marked, company, critical, shown_at", [("f_2,f_999,f_1000", 3, 1, 1, 1)])
def rendered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: cards by severity, page and number of the id, escaped texts with their marks."""
    html = F.col("html")
    held = lambda x: html.contains(x).cast("int")
    ids = F.array_join(F.regexp_extract_all("html", F.lit("<h3>(f_[0-9]+)"), F.lit(1)), ",")
    marks = F.size(F.regexp_extract_all("html", F.lit("a &lt;b&gt; <mark>HK.5</mark>"), F.lit(0)))
    return report.render(_run(spark)).select(ids.alias("ids"), marks.alias("marked"), held("A &amp; B").alias("company"), held("<td>Critical: 1</td>").alias("critical"), held("2 January 2026").alias("shown_at"))


@cases("run_objects", "run_id, status, critical, total, n_findings", [("r", "done", 1, 3, 3), ("q", "running", 0, 0, 0)])
def run_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run objects of a finished run and of one that has none yet."""
    both = src.load_runs(spark.createDataFrame([("r",), ("q",)], "run_id string"), _run(spark))
    return both.select("run_id", "status", "counts.critical", "counts.total", F.size("findings").alias("n_findings"))


@cases("exported_run", "status, company, last_id", [("done", "A & B", "f_2")])
def exported_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run object as JSON, read again."""
    made = src.export_json(_run(spark))
    return made.select(*(F.get_json_object("json", p).alias(n) for p, n in (("$.status", "status"), ("$.meta.company", "company"), ("$.findings[2].id", "last_id"))))


@cases("checked_uploads", "path, error", [("a.pdf", None), ("b.pdf", "the file is empty"), ("c.pdf", "the file is not a PDF")])
def checked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no documents."""
    files = spark.createDataFrame([("a.pdf", b"%PDF-1.7"), ("b.pdf", b""), ("c.pdf", b"hello")], "path string, content binary")
    return src.check_uploads(files).select("path", "error")


# -- progress and review ------------------------------------------------------------

EVENTS = [("r", n, s, d) for n, (s, d) in enumerate([("extract", True), ("align", False), ("align", True), ("done", True), ("late", False)])] + [("q", 1, "detect", True)]


def _events(spark: SparkSession) -> DataFrame:
    frame = spark.createDataFrame(EVENTS, "run_id string, seq int, stage string, done boolean")
    return frame.select("run_id", F.col("seq").cast("bigint").alias("seq"), F.lit("2026-01-01").cast("timestamp").alias("ts"), "stage", F.lit("").alias("label"), "done")


@cases("replayed_events", "run_id, seq, stage, upto, in_all", [("r", 0, "extract", 1, 1), ("r", 1, "align", 1, 2), ("r", 2, "align", 2, 2), ("r", 3, "done", 1, 1), ("q", 1, "detect", 1, 1), ("q", 2, "done", 1, 1)])
def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to the terminal one, which a run that broke off is given, with counts within the stage."""
    ended = review.with_terminal(_events(spark), spark.createDataFrame([("r", "done"), ("q", "error")], "run_id string, status string"))
    made = review.running_counts(review.until_terminal(ended))
    return made.select("run_id", F.col("seq").cast("int").alias("seq"), "stage", F.col("finished_of").cast("int").alias("upto"), F.col("of").cast("int").alias("in_all"))


DECISIONS = [
    ("r", "f_001", 1, "dismissed", "false_positive", " ok ", True, True), ("r", "f_001", 2, "confirmed", "false_positive", "", True, True), ("r", "f_002", 1, "dismissed", None, None, False, False), ("r", "f_002", 0, "unresolved", None, None, False, False), ("r", "f_003", 1, "bogus", None, None, False, False),
    ("r", "f_003", 3, "dismissed", "acceptable_variation", "n", True, True),
]


@cases("reviewed_findings", "id, status, dismiss_reason, note", [("f_001", "confirmed", None, None), ("f_002", "unresolved", None, None), ("f_003", "dismissed", "acceptable_variation", "n"), ("f_1000", "unreviewed", None, None), ("next", "f_1000", None, None)])
def reviewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the decisions that hold, and the one to review next."""
    frame = spark.createDataFrame(DECISIONS, "run_id string, finding_id string, s int, status string, dismiss_reason string, note string, has_reason boolean, has_note boolean")
    decisions = frame.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows = [("r", f"f_{n:03d}", "Critical" if n < 3 else "Cosmetic", "unreviewed", None, None) for n in (1, 2, 3, 1000)]
    now = review.applied(spark.createDataFrame(rows, "run_id string, id string, severity string, status string, dismiss_reason string, note string"), decisions)
    null = F.lit(None).cast("string")
    following = review.next_unreviewed(now, 1).select(F.lit("next").alias("id"), F.col("id").alias("status"), null.alias("dismiss_reason"), null.alias("note"))
    return now.select("id", "status", "dismiss_reason", "note").union(following)
