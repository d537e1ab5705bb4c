"""Deterministic checks of aligned pairs: numbers, dates, currencies.

Everything happens inside a row: tokens are arrays, the matching is a fold over
them, so that pairs need no shuffle and are checked where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import lexicons as lx
from tandem.functions import tokens as tk
from tandem.functions.language import joiner
from tandem.functions.rx import empty, let

FINDING = "array<struct<type:string,en_span:array<int>,zh_span:array<int>,explanation:string>>"
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def same(a: Column, b: Column) -> Column:
    """Equal up to a millionth of the larger value, or 1e-9."""
    return F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def without(items: Column, at: Column) -> Column:
    """The array without its element at a 0-based place."""
    return F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))


def bag_match(a: Column, b: Column, equal, kind: str) -> Column:
    """struct(a, b): what is left of two bags when each of the first has taken the first free equal of the second."""

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["b"], lambda y: equal(x, y)), True).cast("int") - 1
        taken = F.struct(acc["a"].alias("a"), without(acc["b"], at).alias("b"))
        return F.when(at >= 0, taken).otherwise(F.struct(F.concat(acc["a"], F.array(x)).alias("a"), acc["b"].alias("b")))

    return F.aggregate(a, F.struct(empty(kind).alias("a"), b.alias("b")), step)


def nearest_pairs(a: Column, b: Column, distance, kind: str) -> Column:
    """Array of struct(a, b): each of the first with the nearest free one of the second; the rest of either alone."""
    element = kind.removeprefix("array<")[:-1]
    null = F.lit(None).cast(element)
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def step(acc: Column, x: Column) -> Column:
        near = F.array_min(F.transform(acc["b"], lambda y, i: F.struct(distance(x, y).alias("d"), i.alias("i"))))["i"]
        found = F.struct(without(acc["b"], near).alias("b"), F.concat(acc["out"], F.array(pair(x, F.get(acc["b"], near)))).alias("out"))
        return F.when(F.size(acc["b"]) > 0, found).otherwise(F.struct(acc["b"].alias("b"), F.concat(acc["out"], F.array(pair(x, null))).alias("out")))

    start = F.struct(b.alias("b"), empty(f"array<struct<a:{element},b:{element}>>").alias("out"))
    return F.aggregate(a, start, step, lambda acc: F.concat(acc["out"], F.transform(acc["b"], lambda y: pair(null, y))))


def trimmed(v: Column) -> Column:
    whole = v == F.floor(v)
    decimals = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), "0+$", ""), r"\.$", "")
    return F.when(whole & (F.abs(v) >= 1000), F.format_number(v, 0)).when(whole, v.cast("bigint").cast("string")).otherwise(decimals)


def formatted(v: Column, kind: Column, mult: Column, cur: Column) -> Column:
    """A value in the notation of a token with this kind and scale word."""
    prefixes = F.create_map(*(F.lit(x) for pair in lx.PREFIX.items() for x in pair))
    prefix = F.when(cur.isNull(), "").otherwise(F.coalesce(F.element_at(prefixes, cur), cur))
    big = F.coalesce(mult.isin("billion", "bn") | ((mult == "億") & (F.abs(v) >= 1e9)), F.lit(False))
    mid = F.coalesce(mult.isin("million", "mn", "mm", "百萬") | (mult.isin("萬", "億") & (F.abs(v) >= 1e6)), F.lit(False))
    return F.when(kind == "pct", F.concat(trimmed(v), F.lit("%"))).when(big, F.concat(prefix, trimmed(v / 1e9), F.lit(" billion"))).when(mid, F.concat(prefix, trimmed(v / 1e6), F.lit(" million"))).otherwise(F.concat(prefix, trimmed(v)))


def long_date(iso: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.substring(iso, 6, 2).cast("int"))
    return F.concat_ws(" ", F.substring(iso, 9, 2).cast("int").cast("string"), month, F.substring(iso, 1, 4))


def _span(x: Column) -> Column:
    return F.when(x.isNotNull(), F.array(x["s"], x["e"]))


def _finding(kind: str, a: Column, b: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), a.alias("en_span"), b.alias("zh_span"), text.alias("explanation"))


def _stated(name_a, name_b, a: Column, b: Column, both: Column, show, what: str) -> Column:
    only = lambda mine, other, x: F.concat(mine, F.lit(" states "), show(x), F.lit("; "), other, F.lit(f" has no corresponding {what}."))
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull(), only(name_a, name_b, a)).otherwise(only(name_b, name_a, b))


def number_findings(a: Column, b: Column, cur_a: Column, cur_b: Column, text_a: Column, text_b: Column, name_a: Column, name_b: Column) -> Column:
    """Numbers of equal value cancel; the rest pairs up by nearness of the logarithms."""

    def yearlike(n: Column) -> Column:
        return (n["kind"] == "plain") & (n["value"] == F.floor(n["value"])) & n["value"].between(1900, 2100) & ~n["raw"].contains(",")

    def verbatim(n: Column, other: Column) -> Column:
        digits = F.regexp_replace(n["raw"], r"(?U)[^\d.]", "")
        return (n["kind"] == "plain") & (digits != "") & (F.instr(other, digits) > 0)

    def distance(x: Column, y: Column) -> Column:
        apart = (x["value"] == 0) | (y["value"] == 0) | ((x["value"] > 0) != (y["value"] > 0))
        return F.when(apart, F.abs(x["value"] - y["value"]) + 1e12).otherwise(F.abs(F.ln(F.abs(x["value"])) - F.ln(F.abs(y["value"]))))

    codes = F.create_map(*(F.lit(x) for pair in lx.CURRENCY_OF.items() for x in pair))
    code_of = lambda ns, cs: F.coalesce(F.get(F.filter(F.transform(ns, lambda n: F.element_at(codes, F.upper(n["currency"]))), lambda c: c.isNotNull()), 0), F.get(cs, 0)["code"])

    def of_left(left: Column) -> Column:
        rest_a = F.filter(left["a"], lambda n: ~(yearlike(n) | verbatim(n, text_b)))
        rest_b = F.filter(left["b"], lambda n: ~(yearlike(n) | verbatim(n, text_a)))
        code = F.coalesce(code_of(a, cur_a), code_of(b, cur_b))

        def finding(p: Column) -> Column:
            x, y = p["a"], p["b"]
            shared = F.when(x["currency"].isNotNull() | (x["kind"] != "pct"), code)
            like = x["kind"].isin("pct", "scaled")
            shown_x = formatted(x["value"], x["kind"], x["mult"], F.when(x["currency"].isNotNull(), shared))
            shown_y = formatted(y["value"], F.when(like, x["kind"]).otherwise(y["kind"]), F.when(like, x["mult"]).otherwise(y["mult"]), F.when(x["currency"].isNotNull() | y["currency"].isNotNull(), shared))
            both = F.concat(name_a, F.lit(" states "), shown_x, F.lit("; "), name_b, F.lit(" states "), shown_y, F.lit("."))
            return _finding("NUMBER_MISMATCH", _span(x), _span(y), _stated(name_a, name_b, x, y, both, lambda n: F.trim(n["raw"]), "figure"))

        return F.transform(nearest_pairs(rest_a, rest_b, distance, tk.NUMBER), finding)

    return let(bag_match(a, b, lambda x, y: same(x["value"], y["value"]), tk.NUMBER), of_left)


def date_findings(a: Column, b: Column, text_a: Column, text_b: Column, name_a: Column, name_b: Column) -> Column:
    """Dates of equal value cancel; the rest pairs up by nearness of yyyymmdd as a number."""
    number = lambda x: F.replace(x["iso"], F.lit("-"), F.lit("")).cast("int")
    label = F.when(F.concat_ws(" ", text_a, text_b).rlike(f"(?iU){lx.LONG_STOP}"), "long stop date").otherwise("date")

    def finding(p: Column) -> Column:
        x, y = p["a"], p["b"]
        both = F.concat(name_a, F.lit(" "), label, F.lit(" is "), long_date(x["iso"]), F.lit("; "), name_b, F.lit(" is "), long_date(y["iso"]), F.lit("."))
        return _finding("DATE_MISMATCH", _span(x), _span(y), _stated(name_a, name_b, x, y, both, lambda d: long_date(d["iso"]), "date"))

    def of_left(left: Column) -> Column:
        return F.transform(nearest_pairs(left["a"], left["b"], lambda x, y: F.abs(number(x) - number(y)), tk.DATE), finding)

    return let(bag_match(a, b, lambda x, y: x["iso"] == y["iso"], tk.DATE), of_left)


def currency_findings(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    """One finding where both sides name currencies and the sets differ."""
    codes = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda c: c["code"])))
    only = lambda x, y: F.coalesce(F.get(F.filter(x, lambda c: ~F.array_contains(codes(y), c["code"])), 0), F.get(x, 0))
    text = F.concat(name_a, F.lit(" uses "), F.array_join(codes(a), ", "), F.lit("; "), name_b, F.lit(" uses "), F.array_join(codes(b), ", "), F.lit("."))
    differ = (F.size(a) > 0) & (F.size(b) > 0) & (codes(a) != codes(b))
    return F.when(differ, F.array(_finding("CURRENCY_MISMATCH", _span(only(a, b)), _span(only(b, a)), text))).otherwise(empty(FINDING))


def check_pair(text_a: Column, text_b: Column, code_a: Column | str = "en", code_b: Column | str = "zh", name_a: Column | None = None, name_b: Column | None = None) -> Column:
    """Array of findings of one pair: numbers, then dates, then currency."""
    name_a = F.lit("English") if name_a is None else name_a
    name_b = F.lit("Chinese") if name_b is None else name_b

    def with_dates(d: Column) -> Column:
        numbers = F.struct(tk.numbers(text_a, code_a, d["a"]).alias("a"), tk.numbers(text_b, code_b, d["b"]).alias("b"), tk.currencies(text_a, code_a).alias("ca"), tk.currencies(text_b, code_b).alias("cb"))
        return let(
            numbers,
            lambda n: F.concat(
                number_findings(n["a"], n["b"], n["ca"], n["cb"], text_a, text_b, name_a, name_b),
                date_findings(d["a"], d["b"], text_a, text_b, name_a, name_b),
                currency_findings(n["ca"], n["cb"], name_a, name_b),
            ),
        )

    return let(F.struct(tk.dates(text_a, code_a).alias("a"), tk.dates(text_b, code_b).alias("b")), with_dates)


def pair_texts(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs with the joined text and first page of both sides; ids without a sentence are skipped.

    ``pairs(run_id, pair_id, en_ids, zh_ids, …)``, ``sentences(run_id, slot, sid, page, text, script)``.
    Sentences are grouped by pair after one equi-join for each slot.
    """
    made = pairs
    for slot in ("en", "zh"):
        ids = pairs.select("run_id", "pair_id", F.posexplode(f"{slot}_ids").alias("pos", "sid"))
        own = sentences.where(F.col("slot") == slot).select("run_id", "sid", "page", F.trim("text").alias("text"), joiner(F.col("script")).alias("sep"))
        side = ids.join(own, ["run_id", "sid"]).groupBy("run_id", "pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text", "sep"))).alias("xs"))
        texts = F.filter(F.transform("xs", lambda x: x["text"]), lambda t: t != "")
        page = F.get(F.filter(F.transform("xs", lambda x: x["page"]), lambda p: p.isNotNull()), 0)
        made = made.join(side.select("run_id", "pair_id", F.call_function("array_join", texts, F.get("xs", F.lit(0))["sep"]).alias(f"{slot}_text"), page.alias(f"{slot}_page")), ["run_id", "pair_id"], "left")
    return made.withColumns({f"{s}_text": F.coalesce(f"{s}_text", F.lit("")) for s in ("en", "zh")})


def run_checks(pairs: DataFrame, languages: tuple[Column | str, Column | str] = ("en", "zh"), names: tuple[Column, Column] | None = None) -> DataFrame:
    """Findings of pairs that have text on both sides (``pair_texts``)."""
    name_a, name_b = names or (None, None)
    found = pairs.where((F.col("en_text") != "") & (F.col("zh_text") != "")).withColumn("found", check_pair(F.col("en_text"), F.col("zh_text"), *languages, name_a, name_b))
    side = lambda s: F.struct(F.col(f"{s}_page").alias("page"), F.col(f"{s}_text").alias("text"), F.col(f"f.{s}_span").alias("span"))
    rows = found.select("*", F.posexplode("found").alias("ord", "f"))
    return rows.select("run_id", "pair_id", "section", "ord", F.col("f.type").alias("type"), F.lit("deterministic").alias("source"), side("en").alias("en"), side("zh").alias("zh"), F.col("f.explanation").alias("explanation"), F.lit(1.0).alias("confidence"))

