"""Language, script and sentence splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import lexicons as lx
from tandem.functions.rx import let

#: Character classes of the scripts.
SCRIPTS = {
    "han": r"一-鿿㐀-䶿豈-﫿",
    "kana": r"぀-ヿ",
    "hangul": r"가-힯ᄀ-ᇿ㄰-㆏",
}
#: Words that end in a stop without ending a sentence.
ABBREVIATIONS = ("No.", "Nos.", "Mr.", "Mrs.", "Ms.", "Dr.", "Ltd.", "Co.", "Inc.", "Corp.", "approx.", "e.g.", "i.e.", "etc.", "vs.", "St.", "Jr.")


def count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def script_counts(text: Column) -> dict[str, Column]:
    """Characters by script; Latin are the letters below U+2000 that belong to no other."""
    counts = {n: count_of(text, c) for n, c in SCRIPTS.items()}
    counts["latin"] = F.length(F.regexp_replace(text, r"[^\p{L}&&[\x00-῿]]|[ᄀ-ᇿ]", ""))
    return counts


def stopword_hits(words: Column, known: str) -> Column:
    """Words of the array that are among the function words given."""
    return F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(known.split()))))  # a hash set: the list is long


def _language(code: str, name: str, script: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(script).alias("script"))


def detect_language(text: Column, stopwords: dict[str, str] = lx.STOPWORDS) -> Column:
    """struct(code, name, script) of a text.

    A text with 20 characters of the CJK scripts, or a fifth of its letters, is
    Korean, Japanese or Chinese by the share of their scripts.  Others go to the
    language with most function words: three and 5 % of the words at least, and
    a lead of a fifth over the next; of equal ones none leads.  Scripts are
    counted only in texts that hold a CJK character.
    """
    unknown = _language("und", "Unknown", "Zyyy")
    any_of_them = dict.fromkeys(w for ws in stopwords.values() for w in ws.split())

    def of_words(words: Column) -> Column:
        return let(F.filter(words, lambda w: w.isin(*any_of_them)), lambda hits: of_hits(hits, F.size(words)))

    def of_hits(hits: Column, n_words: Column) -> Column:
        scores = F.array(*(F.struct(stopword_hits(hits, ws).alias("n"), F.lit(c).alias("c")) for c, ws in stopwords.items()))

        def best(ranked: Column) -> Column:
            top, second = F.get(ranked, 0), F.get(ranked, 1)
            sure = (top["n"] >= 3) & (top["n"] >= 0.05 * n_words) & (top["n"] >= 1.2 * second["n"])
            names = F.create_map(*(F.lit(x) for c in stopwords for x in (c, lx.LANGUAGE_NAMES[c])))
            return F.when(sure, F.struct(top["c"].alias("code"), F.element_at(names, top["c"]).alias("name"), F.lit("Latn").alias("script"))).otherwise(unknown)

        return let(F.reverse(F.array_sort(scores)), best)

    latin = let(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿœ]+"), F.lit(0)), of_words)

    def of_counts(n: Column) -> Column:
        cjk = n["han"] + n["kana"] + n["hangul"]
        chinese = F.when(count_of(text, lx.HANS) > count_of(text, lx.HANT), _language("zh", "Chinese (Simplified)", "Hans")).otherwise(_language("zh", "Chinese (Traditional)", "Hant"))
        asian = F.when((n["hangul"] > 0) & (n["hangul"] >= 0.3 * cjk), _language("ko", "Korean", "Hang")).when((n["kana"] > 0) & (n["kana"] >= 0.05 * cjk), _language("ja", "Japanese", "Jpan")).otherwise(chinese)
        return F.when((cjk >= 20) | (cjk >= 0.2 * (cjk + n["latin"])), asian).when(n["latin"] > 0, latin).otherwise(unknown)

    counts = F.struct(*(c.alias(n) for n, c in script_counts(text).items()))
    return F.when(text.rlike(f"[{''.join(SCRIPTS.values())}]"), let(counts, of_counts)).when(text.isNotNull(), latin).otherwise(unknown)


def is_cjk(script: Column) -> Column:
    """Scripts without spaces between words (Korean has them)."""
    return script.isin(*lx.NO_SPACE_SCRIPTS)


def joiner(script: Column) -> Column:
    return F.when(is_cjk(script), "").otherwise(" ")


def short_name(name: Column) -> Column:
    return F.substring_index(name, " (", 1)


def modals(code: Column, script: Column) -> Column:
    """Array of the modal words of a language; the English ones for unknown codes."""
    result = F.array(*map(F.lit, lx.MODALS["en"]))
    for c, ws in lx.MODALS.items():
        if c not in ("en", "zh-Hans"):
            result = F.when(code == c, F.array(*map(F.lit, ws))).otherwise(result)
    return F.when((code == "zh") & (script == "Hans"), F.array(*map(F.lit, lx.MODALS["zh-Hans"]))).otherwise(result)


def modal_pattern(code: str) -> str:
    """Word-bounded for Latin words, anywhere for others."""
    return "(?iU)" + "|".join(rf"\b{w}\b" if w[0].isascii() or w[0].isalpha() and ord(w[0]) < 0x250 else w for w in lx.MODALS.get(code, lx.MODALS["en"]))


def sentences_latin(text: Column) -> Column:
    """Split at white space after . ! ? before a capital, bracket or quote, but not after an abbreviation."""
    guarded = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for a in ABBREVIATIONS:
        guarded = F.regexp_replace(guarded, a.replace(".", r"\.") + r"(?=(?U)\s)", a.replace(".", "\x00"))
    parts = F.split(guarded, r"(?U)(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ(\"“«])", -1)
    cleaned = F.transform(parts, lambda p: F.regexp_replace(F.replace(p, F.lit("\x00"), F.lit(".")), r"(?U)^\s+|\s+$", ""))
    return F.filter(cleaned, lambda p: p != "")


def sentences_cjk(text: Column) -> Column:
    """Split after 。！？；; pieces of fewer than 6 characters join the one before."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(bare(text), "(?<=[。！？；])", -1), bare), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        glued = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))
        return F.when((F.size(acc) > 0) & (F.length(p) < 6), glued).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def sentences(text: Column, cjk: Column | bool) -> Column:
    if isinstance(cjk, bool):
        return sentences_cjk(text) if cjk else sentences_latin(text)
    return F.when(cjk, sentences_cjk(text)).otherwise(sentences_latin(text))
