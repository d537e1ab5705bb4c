"""Sections, sentence pairs, glossary, prevailing language.

Alignments come from a table of matches (``accept``), as a reviewer or a model
proposes them, or from ``align_by_length``: dynamic programming over sentence
lengths (Gale and Church 1993) with moves 1-1, 1-0, 0-1, 2-1 and 1-2, anchored by
the digits that two sentences share.  A section is one bounded group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DOC = ("run_id", "slot")
MAX_TERMS = 40

#: Places off the diagonal that an alignment may go, besides the difference in length.
BAND = 64

#: Headings of definitions.
DEFINITION_HEADINGS = "DEFINITION|INTERPRETATION|釋義|释义|定義|定义|詞彙|词汇|DÉFINITION|BEGRIFFSBESTIMMUNG|DEFINIZIONI|DEFINICIONES|DEFINIÇÕES|DEFINITIES"
#: How a document introduces a defined term.
TERM_PATTERNS = (
    r"(?iU)[\"“]([^\"”]{1,60})[\"”]\s+(?:means|shall mean|has the meaning)",
    r"(?iU)«\s*([^»]{1,60}?)\s*»\s+(?:désigne|designe|signifie|s'entend|a le sens)",
    r"(?iU)[„\"“]([^\"“”]{1,60})[\"“”]\s+(?:bezeichnet|bedeutet|meint|hat die Bedeutung)",
    r"(?iU)[\"“«]([^\"”»]{1,60})[\"”»]\s+(?:indica|significa|designa|si intende|se refiere|se entiende|refere-se|betekent)",
    r"(?U)「([^」]{1,30})」\s*(?:指|乃指|即|的意思是|是指|とは)",
    r"(?U)“([^”]{1,30})”\s*(?:指|乃指|即|是指)",
)
#: Names of languages by code, as clauses on the prevailing version use them.
MENTIONS = {
    "en": "english anglaise englische inglese inglesa 英文 英語", "zh": "chinese chinoise chinesische cinese china 中文 中国語", "fr": "french française francaise französische francese francesa 法文 フランス語",
    "de": "german allemande deutsche tedesca alemana 德文 ドイツ語", "it": "italian italienne italienische italiana 意大利文 義大利文 イタリア語", "es": "spanish espagnole spanische spagnola española espanola 西班牙文 スペイン語",
    "pt": "portuguese portugaise portugiesische portoghese portuguesa 葡萄牙文 ポルトガル語", "nl": "dutch néerlandaise niederländische olandese neerlandesa 荷蘭文 荷兰文 オランダ語", "ja": "japanese japonaise japanische giapponese japonesa 日文 日本語",
    "ko": "korean coréenne koreanische coreana 韓文 韩文 韓国語",
}
#: The same names by the language of the clause; a clause names languages in its own.
NAMES = {
    "en": "English|Chinese|French|German|Italian|Spanish|Portuguese|Dutch|Japanese|Korean",
    "fr": "anglaise|chinoise|française|francaise|allemande|italienne|espagnole|portugaise|néerlandaise|japonaise|coréenne",
    "de": "englische|chinesische|französische|deutsche|italienische|spanische|portugiesische|niederländische|japanische|koreanische",
    "it": "inglese|cinese|francese|tedesca|italiana|spagnola|portoghese|olandese|giapponese|coreana",
    "es": "inglesa|china|francesa|alemana|italiana|española|espanola|portuguesa|neerlandesa|japonesa|coreana",
    "zh": "英文|中文|法文|德文|意大利文|義大利文|西班牙文|葡萄牙文|荷蘭文|荷兰文|日文|韓文|韩文",
    "ja": "英語|中国語|フランス語|ドイツ語|イタリア語|スペイン語|ポルトガル語|オランダ語|日本語|韓国語",
}
#: Clauses on the prevailing version, each for names of its own language, in the order in which they are tried.
PREVAIL = (
    rf"(?iU)\b({NAMES['en']})\b[^.]{{0,80}}?\b(?:shall|will|to)\s+(?:prevail|govern|control)",
    rf"(?iU)\b({NAMES['en']})\b[^.]{{0,80}}?\b(?:shall|will)\s+be\s+(?:authoritative|binding)",
    rf"(?iU)prevail[^.]{{0,40}}?\b({NAMES['en']})\b",
    rf"(?U)以({NAMES['zh']})(?:版本|本|文本|版)?[為为]準?准?",
    rf"(?iU)(?:version|texte)\s+({NAMES['fr']})[^.]{{0,80}}?(?:prévau|prevau|fait\s+foi|l'emport|fera\s+foi)",
    rf"(?iU)({NAMES['de']})\s+(?:Fassung|Version|Sprachfassung)[^.]{{0,60}}?(?:maßgeblich|massgeblich|maßgebend|verbindlich|Vorrang)",
    rf"(?iU)gilt\s+die\s+({NAMES['de']})\s+(?:Fassung|Version|Sprachfassung)",
    rf"(?iU)prevale\s+la\s+versione\s+({NAMES['it']})",
    rf"(?iU)versione\s+({NAMES['it']})\s+(?:prevale|prevarrà|fa\s+fede)",
    rf"(?iU)prevalecer[áa]?\s+la\s+versi[óo]n\s+({NAMES['es']})",
    rf"(?iU)versi[óo]n\s+({NAMES['es']})\s+prevalecer[áa]?",
    rf"(?iU)prevalece(?:rá)?\s+a\s+vers[ãa]o\s+({NAMES['es']})",
    rf"(?iU)vers[ãa]o\s+({NAMES['es']})\s+prevalece(?:rá)?",
    rf"({NAMES['ja']})版が優先",
)


def section_spans(blocks: DataFrame) -> DataFrame:
    """Blocks with ``sec_ord``: 0 before the first heading, then the ordinal of the last heading."""
    return blocks.withColumn("sec_ord", F.sum(F.col("is_heading").cast("int")).over(W.partitionBy(*DOC).orderBy("block_n")))


def section_sentences(blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences with their section's ordinal and heading."""
    spans = section_spans(blocks)
    heading = spans.where("is_heading").select(*DOC, "sec_ord", F.col("text").alias("heading"), F.col("page").alias("heading_page"))
    own = spans.select(*DOC, "block_id", "sec_ord").join(heading, [*DOC, "sec_ord"], "left")
    return sentences.join(own, [*DOC, "block_id"])


def accept_matches(proposed: DataFrame, sides: DataFrame) -> DataFrame:
    """Matches whose places exist on both sides and are not taken by an accepted earlier one.

    ``proposed(run_id, ord, i, j, score)``, ``sides(run_id, n_en, n_zh)``.  Order
    matters (a rejected match takes nothing), so the matches of a run go one by
    one past the sets of taken places.
    """
    listed = proposed.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "j", "score"))).alias("ms")).join(sides, "run_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for r in batch.itertuples(index=False):
                left, right = set(), set()
                for m in r.ms:
                    if 0 <= m["i"] < r.n_en and 0 <= m["j"] < r.n_zh and m["i"] not in left and m["j"] not in right:
                        left.add(m["i"])
                        right.add(m["j"])
                        kept.append((r.run_id, m["ord"], m["i"], m["j"], m["score"]))
            yield pd.DataFrame(kept, columns=["run_id", "ord", "i", "j", "score"])

    return listed.select("run_id", "ms", "n_en", "n_zh").mapInPandas(run, "run_id string, ord int, i int, j int, score double")


def accept_pairs(proposed: DataFrame) -> DataFrame:
    """Sentence pairs without ids that an earlier pair has; a pair goes if a side is left empty.

    ``proposed(run_id, sec_id, ord, en_ids, zh_ids, score)``.
    """
    listed = proposed.groupBy("run_id", "sec_id").agg(F.array_sort(F.collect_list(F.struct("ord", "en_ids", "zh_ids", "score"))).alias("ps"))
    kind = "array<struct<ord:int,en_ids:array<string>,zh_ids:array<string>,score:double>>"

    def step(acc: Column, p: Column) -> Column:
        fresh = lambda c: F.array_except(p[c], F.flatten(F.transform(acc, lambda t: t[c])))
        pair = F.struct(p["ord"].alias("ord"), fresh("en_ids").alias("en_ids"), fresh("zh_ids").alias("zh_ids"), p["score"].alias("score"))
        return F.when((F.size(fresh("en_ids")) > 0) & (F.size(fresh("zh_ids")) > 0), F.concat(acc, F.array(pair))).otherwise(acc)

    return listed.select("run_id", "sec_id", F.explode(F.aggregate(F.col("ps").cast(kind), F.array().cast(kind), step)).alias("p")).select("run_id", "sec_id", "p.*")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_n`` and ``pair_id`` across sections, in section order."""
    first = F.transform(F.col("en_ids"), lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int"))
    n = F.row_number().over(W.partitionBy("run_id").orderBy("sec_n", F.array_min(first), "ord"))
    return pairs.withColumn("pair_n", n).withColumn("pair_id", F.format_string("p_%03d", "pair_n"))


def unpaired(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sentences of matched sections that are in no pair."""
    used = pairs.select("run_id", F.explode(F.concat("en_ids", "zh_ids")).alias("sid")).distinct()
    return sentences.join(used, ["run_id", "sid"], "left_anti")


def _cost(a: int, b: int, shared: float) -> float:
    """Distance of two lengths in units of their spread, less what shared digits are worth."""
    mean = (a + b) / 2
    return abs(a - b) / (mean * 6.8) ** 0.5 - 3 * shared if a and b else 3.0


def _align(en: list[tuple[str, str]], zh: list[tuple[str, str]], ratio: float) -> list[tuple[list[str], list[str], float]]:
    """Cheapest moves from start to end, within ``BAND`` places of the diagonal and the difference of the sides."""
    n, m = len(en), len(zh)
    digits = [[set(re.findall(r"\d+", t)) for _, t in xs] for xs in (en, zh)]
    width = [[len(t) for _, t in xs] for xs in (en, zh)]
    reach = BAND + abs(n - m)
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    moves = ((1, 1, 0.0), (1, 0, 2.5), (0, 1, 2.5), (2, 1, 1.0), (1, 2, 1.0))
    for i in range(n + 1):
        row = best[i]
        middle = i * m // n if n else 0
        for j in range(max(0, middle - reach), min(m, middle + reach) + 1):
            if j not in row:
                continue
            here = row[j][0]
            for di, dj, extra in moves:
                if i + di > n or j + dj > m:
                    continue
                cost = here + extra
                if di and dj:
                    a, b = set().union(*digits[0][i : i + di]), set().union(*digits[1][j : j + dj])
                    shared = len(a & b) / len(a | b) if a or b else 0.0
                    cost += _cost(sum(width[0][i : i + di]), int(sum(width[1][j : j + dj]) * ratio), shared)
                if j + dj not in best[i + di] or cost < best[i + di][j + dj][0]:
                    best[i + di][j + dj] = (cost, di, dj)
    made, i, j = [], n, m
    while i or j:
        _, di, dj = best[i][j]
        if di and dj:
            made.append(([s for s, _ in en[i - di : i]], [s for s, _ in zh[j - dj : j]], 0.7))
        i, j = i - di, j - dj
    return made[::-1]


def align_by_length(sentences: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(run_id, sec_id, ord, en_ids, zh_ids, score) for each section; ``ratio`` scales the second side's lengths.

    ``sentences(run_id, sec_id, slot, sid, s_n, text)``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                sides = {s: [(x["sid"], x["text"]) for x in sorted(r.xs, key=lambda x: x["s_n"]) if x["slot"] == s] for s in ("en", "zh")}
                rows += [(r.run_id, r.sec_id, n, a, b, s) for n, (a, b, s) in enumerate(_align(sides["en"], sides["zh"], ratio))]
            yield pd.DataFrame(rows, columns=["run_id", "sec_id", "ord", "en_ids", "zh_ids", "score"])

    grouped = sentences.groupBy("run_id", "sec_id").agg(F.collect_list(F.struct("slot", "sid", "s_n", "text")).alias("xs"))
    return grouped.mapInPandas(run, "run_id string, sec_id string, ord int, en_ids array<string>, zh_ids array<string>, score double")


#: Chinese digits of heading numbers.
_CJK_DIGITS = {c: n for n, c in enumerate("〇一二三四五六七八九")}


def heading_number(text: str) -> tuple[str, int] | None:
    """(level, number) at the start of a heading: 2., 2.3, (b), IV., 二、, 第三章; null if there is none."""
    if m := re.match(r"\s*(?:section|article|chapter|part|abschnitt|artikel|sección|capítulo|第)?\s*(\d+)((?:\.\d+)*)(?=[\s.):、章節节條条]|$)", text, re.I):
        parts = [int(x) for x in (m[1] + m[2]).split(".")]
        return f"{len(parts)}", sum(x * 1000 ** (len(parts) - 1 - i) for i, x in enumerate(parts))
    if m := re.match(r"\s*第?([一二三四五六七八九十]{1,3})[、章節节條条]", text):
        tens, _, ones = m[1].rpartition("十")
        return "1", (10 * _CJK_DIGITS.get(tens, 1) if "十" in m[1] else 0) + _CJK_DIGITS.get(ones, 0)
    if m := re.match(r"\s*\(?([a-z])[).]\s", text):
        return "a", ord(m[1]) - 96
    if m := re.match(r"\s*([IVX]{1,5})[.、\s]", text):
        value = [{"I": 1, "V": 5, "X": 10}[c] for c in m[1]]
        return "1", sum(-v if v < max(value[i:]) else v for i, v in enumerate(value))
    return None


def _match_headings(en: list[str], zh: list[str]) -> list[tuple[int, int, float]]:
    """(i, j, score) in order: the cheapest alignment by numbers, shared figures and places; what fits nothing stays alone."""
    n, m = len(en), len(zh)
    numbers = [[heading_number(t) for t in xs] for xs in (en, zh)]
    figures = [[set(re.findall(r"\d+|[A-Z]{2,}", t)) for t in xs] for xs in (en, zh)]

    def cost(i: int, j: int) -> float:
        a, b = numbers[0][i], numbers[1][j]
        place = abs(i / n - j / m) if n and m else 0.0
        if a and b:
            return (0.0 if a == b else 2.5) + 0.2 * place
        both = figures[0][i] | figures[1][j]
        return (0.9 if a or b else 0.5) + 0.5 * place - (0.4 * len(figures[0][i] & figures[1][j]) / len(both) if both else 0.0)

    best = [[(0.8 * (i + j), (i > 0) * 1, (i == 0) * (j > 0) * 1) for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = min((best[i - 1][j - 1][0] + cost(i - 1, j - 1), 1, 1), (best[i - 1][j][0] + 0.8, 1, 0), (best[i][j - 1][0] + 0.8, 0, 1), key=lambda x: x[0])
    made, i, j = [], n, m
    while i or j:
        _, di, dj = best[i][j]
        if di and dj:
            made.append((i - 1, j - 1, 0.9 if numbers[0][i - 1] and numbers[0][i - 1] == numbers[1][j - 1] else 0.7))
        i, j = i - di, j - dj
    return made[::-1]


def propose_sections(heads: DataFrame) -> DataFrame:
    """(run_id, ord, i, j, score): headings of the two sides that go together, in document order.

    ``heads(run_id, slot, sec_ord, heading)``, places from 1.  A section that one
    side lacks shifts none of the others.  The headings of a run are one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                side = lambda s, hs=r.hs: [(h["sec_ord"], h["heading"] or "") for h in hs if h["slot"] == s]
                en, zh = side("en"), side("zh")
                rows += [(r.run_id, n, en[i][0] - 1, zh[j][0] - 1, s) for n, (i, j, s) in enumerate(_match_headings([t for _, t in en], [t for _, t in zh]))]
            yield pd.DataFrame(rows, columns=["run_id", "ord", "i", "j", "score"])

    listed = heads.where("sec_ord > 0").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col("sec_ord").cast("int").alias("sec_ord"), "slot", "heading"))).alias("hs"))
    return listed.mapInPandas(run, "run_id string, ord int, i int, j int, score double")


def definitions_text(blocks: DataFrame) -> DataFrame:
    """(run_id, slot, text): the section under the first heading about definitions, else the whole document."""
    spans = section_spans(blocks)
    heads = spans.where(F.col("is_heading") & F.upper("text").rlike(DEFINITION_HEADINGS)).groupBy(*DOC).agg(F.min("sec_ord").alias("def_ord"))
    own = spans.join(heads, list(DOC), "left").where(F.col("def_ord").isNull() | ((F.col("sec_ord") == F.col("def_ord")) & ~F.col("is_heading")))
    return own.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_n", "text"))), lambda x: x["text"]), "\n").alias("text"))


def terms(text: Column, limit: int = MAX_TERMS) -> Column:
    """Defined terms, by pattern, then place; the first ``limit`` distinct ones."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in TERM_PATTERNS)))
    bare = F.filter(F.transform(found, F.trim), lambda t: t != "")
    return F.slice(F.array_distinct(bare), 1, limit)


def glossary(listed: DataFrame, proposed: DataFrame | None = None, limit: int = MAX_TERMS) -> DataFrame:
    """(run_id, ord, en, zh): accepted proposals; without any, terms at the same place if both sides have as many.

    ``listed(run_id, en_terms, zh_terms)``, ``proposed(run_id, ord, i, j, score)``.
    """
    zipped = F.arrays_zip(F.col("en_terms").alias("en"), F.col("zh_terms").alias("zh"))
    by_place = lambda d: d.where(F.size("en_terms") == F.size("zh_terms")).select("run_id", F.posexplode(F.slice(zipped, 1, limit)).alias("ord", "t")).select("run_id", "ord", "t.en", "t.zh")
    if proposed is None:
        return by_place(listed)
    sides = listed.select("run_id", F.size("en_terms").alias("n_en"), F.size("zh_terms").alias("n_zh"))
    taken = accept_matches(proposed, sides).join(listed, "run_id").select("run_id", "ord", F.get("en_terms", F.col("i")).alias("en"), F.get("zh_terms", F.col("j")).alias("zh"))
    rest = listed.join(taken.select("run_id").distinct(), "run_id", "left_anti")
    return taken.unionByName(by_place(rest))


def prevailing(blocks: DataFrame) -> DataFrame:
    """(run_id, code): the language that the first clause on a prevailing version names; slot en before zh, then block, then pattern."""
    codes = F.create_map(*(F.lit(x) for c, ws in MENTIONS.items() for w in ws.split() for x in (w, c)))
    found = F.filter(F.array(*(F.regexp_extract("text", p, 1) for p in PREVAIL)), lambda m: m != "")
    named = blocks.select(*DOC, "block_n", F.get(found, 0).alias("mention")).where(F.col("mention").isNotNull())
    first = named.groupBy("run_id").agg(F.min_by("mention", F.struct((F.col("slot") != "en").alias("o"), "block_n")).alias("mention"))
    return first.select("run_id", F.coalesce(F.element_at(codes, F.lower("mention")), F.lit("und")).alias("code"))


def slot_of(code: Column, code_en: Column, code_zh: Column) -> Column:
    return F.when(code_en == code, "EN").when(code_zh == code, "ZH").otherwise("none")


def document_meta(blocks: DataFrame) -> DataFrame:
    """(run_id, slot, title, stock_code, company): the first heading, else the first block; a code and a company's name by pattern."""
    head = first_text(blocks)
    code = F.regexp_extract(head["text"], r"(?iU)(?:stock\s+code|股份代號)[:：\s]*(\d{4,5})", 1)
    company = F.regexp_extract(head["text"], COMPANY, 1)
    title = F.coalesce(F.min_by(F.when(F.col("is_heading"), F.col("text")), F.when(F.col("is_heading"), F.col("block_n"))), F.min_by("text", "block_n"))
    return head.groupBy(*DOC).agg(title.alias("title"), F.max(F.nullif(code, F.lit(""))).alias("stock_code"), F.min_by(F.nullif(company, F.lit("")), F.when(company != "", F.col("block_n"))).alias("company"))


#: A name that ends in a legal form.
COMPANY = r"((?:[A-Z][\w&'-]*\s+){1,6}(?:Holdings\s+)?(?:Limited|Ltd\.?|Inc\.?|PLC|plc|Corporation|S\.A\.|SA|AG|GmbH|S\.p\.A\.|N\.V\.)|[一-鿿]{2,20}(?:股份)?有限公司)"


def first_text(blocks: DataFrame, pages: int = 2) -> DataFrame:
    return blocks.where(F.col("page") <= pages)

