"""Dates, numbers and currencies as arrays of structs, for the rules of each language.

Every function takes a text column and a language code, as a string or a column;
a column is dispatched by CASE, so that patterns stay literals.  Codes without
rules of their own use the English ones (currencies: the Latin table).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import lexicons as lx
from tandem.functions.rx import by_span, empty, find_all, group, let, masked, without_overlaps

DATE = "array<struct<s:int,e:int,raw:string,iso:string>>"
NUMBER = "array<struct<s:int,e:int,value:double,raw:string,kind:string,currency:string,mult:string>>"
CURRENCY = "array<struct<s:int,e:int,raw:string,code:string>>"

#: Space, narrow no-break space, no-break space: what groups digits besides signs.
SP = r"   "
_FULL_WIDTH = "０１２３４５６７８９"


def dispatch(code: Column | str, rules: dict[str, Callable[[], Column]], other: Callable[[], Column]) -> Column:
    if isinstance(code, str):
        return rules.get(code, other)()
    return reduce(lambda rest, item: F.when(code == item[0], item[1]()).otherwise(rest), reversed(rules.items()), other())


def ascii_digits(x: Column) -> Column:
    return F.translate(x, _FULL_WIDTH, "0123456789")


def to_number(x: Column) -> Column:
    return ascii_digits(x).try_cast("double")


# -- dates ---------------------------------------------------------------------


def iso(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a date whose parts are in range; the calendar is not checked."""
    return F.when(m.between(1, 12) & d.between(1, 31) & y.between(1000, 9999), F.format_string("%04d-%02d-%02d", y, m, d))


def _int(x: Column) -> Column:
    return ascii_digits(x).try_cast("int")


def _dates(text: Column, pattern: str, read: Callable[[Column], Column]) -> Column:
    found = F.transform(find_all(text, pattern), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["raw"].alias("raw"), read(m["raw"]).alias("iso")))
    return F.filter(found, lambda m: m["iso"].isNotNull())


def _month_number(word: Column, code: str) -> Column:
    names = F.create_map(*(F.lit(x) for pair in lx.MONTHS[code].items() for x in pair))
    return F.coalesce(F.element_at(names, F.lower(word)), F.lit(0))


def _parts(pattern: str, order: str) -> Callable[[Column], Column]:
    """Reader of three numeric groups in the order of ``order``."""
    place = {c: order.index(c) + 1 for c in "ymd"}
    return lambda raw: iso(*(_int(group(raw, pattern, place[c])) for c in "ymd"))


#: Dates in digits.
_SLASH = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
_DOTS = r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
_DASHES = r"(?U)\b(\d{1,2})-(\d{1,2})-(\d{4})\b"
_ISO = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"


def _alternation(words) -> str:
    escape = lambda w: w.replace(".", r"\.").replace(" ", r"\s+")
    return "|".join(escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _settled(parts: list[Column]) -> Column:
    return by_span(without_overlaps(F.concat(*parts), DATE))


def dates_en(text: Column) -> Column:
    # fixed values: how dates with month names are written
    names = _alternation(w.title() for w in lx.MONTHS["en"])
    dmy = rf"(?U)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})\.?,?\s+(\d{{4}})\b"
    mdy = rf"(?U)\b({names})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
    named = lambda p, y, m, d: lambda raw: iso(_int(group(raw, p, y)), _month_number(group(raw, p, m), "en"), _int(group(raw, p, d)))
    return _settled([_dates(text, dmy, named(dmy, 3, 2, 1)), _dates(text, mdy, named(mdy, 3, 1, 2)), _dates(text, _SLASH, _parts(_SLASH, "dmy")), _dates(text, _ISO, _parts(_ISO, "ymd"))])


def dates_locale(text: Column, code: str) -> Column:
    names = _alternation(lx.MONTHS[code])
    # fixed value
    p = rf"(?iU)\b(\d{{1,2}})(?:er|re|e|º|ª|°|\.)?[{SP}]+(?:de[{SP}]+|d')?({names})\.?[{SP}]+(?:de[{SP}]+)?(\d{{4}})\b"
    named = _dates(text, p, lambda raw: iso(_int(group(raw, p, 3)), _month_number(group(raw, p, 2), code), _int(group(raw, p, 1))))
    return _settled([named, *(_dates(text, x, _parts(x, "dmy")) for x in (_SLASH, _DOTS, _DASHES)), _dates(text, _ISO, _parts(_ISO, "ymd"))])


def _digit(ch: Column) -> Column:
    """Value of a Chinese digit character, or null."""
    at = F.instr(F.lit("零一二三四五六七八九"), ch)
    return F.when(at > 0, at - 1)


def _plain_cjk(x: Column) -> Column:
    return F.translate(x, "〇○兩两萬亿億点", "零零二二万億億點")


def cjk_number(x: Column) -> Column:
    """Value of Chinese numerals: digits one by one, or with 十百千, 萬 and 億; 點 starts decimals."""

    def step(acc: Column, ch: Column) -> Column:
        d = _digit(ch)
        unit = F.when(ch == "十", 10.0).when(ch == "百", 100.0).when(ch == "千", 1000.0)
        in_section = acc["section"] + acc["digit"]
        made = lambda total, section, digit, scale: F.struct(total.alias("total"), section.alias("section"), digit.alias("digit"), scale.alias("scale"))
        zero = F.lit(0.0)
        return (
            F.when(ch == "點", made(acc["total"] + in_section, zero, zero, F.lit(0.1)))
            .when(d.isNotNull() & (acc["scale"] > 0), made(acc["total"] + d * acc["scale"], zero, zero, acc["scale"] / 10))
            .when(d.isNotNull(), made(acc["total"], acc["section"], acc["digit"] * 10 + d, zero))
            .when(unit.isNotNull(), made(acc["total"], acc["section"] + F.greatest(acc["digit"], F.lit(1.0)) * unit, zero, zero))
            .when(ch == "万", made(acc["total"] + in_section * 1e4, zero, zero, zero))
            .otherwise(made((acc["total"] + in_section) * 1e8, zero, zero, zero))
        )

    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("total", "section", "digit", "scale")))
    return F.aggregate(F.split(_plain_cjk(x), ""), zero, step, lambda a: a["total"] + a["section"] + a["digit"])


def dates_zh(text: Column) -> Column:
    # fixed value
    p = r"(?U)([零〇○一二三四五六七八九]{4}|\d{4})年([一二三四五六七八九十]{1,2}|\d{1,2})月([一二三四五六七八九十]{1,3}|\d{1,2})日"
    number = lambda x: F.when(x.rlike(r"(?U)^\d"), _int(x)).otherwise(cjk_number(x).cast("int"))
    return by_span(_dates(text, p, lambda raw: iso(*(number(group(raw, p, i)) for i in (1, 2, 3)))))


def dates(text: Column, code: Column | str) -> Column:
    def if_any(hint: str, found: Column) -> Column:
        """Every date has a year in digits, or the sign for years: one cheap test before all patterns."""
        return F.when(text.rlike(hint), found).otherwise(empty(DATE))

    year = r"(?U)\d{4}"
    rules = {c: (lambda c=c: if_any(year, dates_locale(text, c))) for c in lx.LOCALES} | {c: (lambda: if_any("年", dates_zh(text))) for c in ("zh", "ja")}
    return dispatch(code, rules, lambda: if_any(year, dates_en(text)))


# -- currencies ----------------------------------------------------------------


def currencies(text: Column, code: Column | str) -> Column:
    def table(name: str) -> Column:
        parts = []
        for cur, pattern in lx.CURRENCIES[name].items():
            parts.append(F.transform(find_all(text, f"(?iU){pattern}"), _tagged(cur)))
        some = text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in lx.CURRENCIES[name].values()))
        return F.when(some, by_span(F.concat(*parts))).otherwise(empty(CURRENCY))

    return dispatch(code, {c: (lambda c=c: table(c)) for c in ("en", "zh", "ja")}, lambda: table("latin"))


def _tagged(cur: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["raw"].alias("raw"), F.lit(cur).alias("code"))


# -- numbers -------------------------------------------------------------------


def _blank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_locale(raw: Column, scaled: Column) -> Column:
    """Value of digits with comma and dot: the later of both is the decimal sign; alone, groups of three are grouping.

    One comma before three digits is grouping without a scale word, a decimal sign with one.
    """
    x = F.regexp_replace(ascii_digits(raw), rf"[{SP}']", "")
    commas, dots = x.contains(","), x.contains(".")
    no_dots, no_commas = F.replace(x, F.lit("."), F.lit("")), F.replace(x, F.lit(","), F.lit(""))
    last = lambda c: F.length(x) - F.instr(F.reverse(x), c)
    return (
        F.when(commas & dots, F.when(last(",") > last("."), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(commas, F.when(x.rlike(r"^\d+(,\d{3}){2,}$") | (x.rlike(r"^\d+,\d{3}$") & ~scaled), no_commas).otherwise(F.replace(x, F.lit(","), F.lit("."))))
        .when(dots & x.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dots)
        .otherwise(x)
        .try_cast("double")
    )


def _latin_numbers(text: Column, spans: Column, code: str) -> Column:
    english = code == "en"
    space = r"\s" if english else f"[{SP}]"
    symbols = lx.SYMBOLS_EN if english else lx.SYMBOLS_LATIN
    # fixed values: how amounts are written
    digits = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?" if english else rf"\d{{1,3}}(?:[{SP}'.,]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
    inner = rf"(?:({symbols}){space}?)?" if english else "()"
    scale = rf"({_alternation(lx.SCALES[code])})" + (r"\b" if english else r"\.?(?![a-zà-öø-ÿ])")
    p = rf"(?iU)(?:({symbols}){space}?)?(\()?{inner}({digits})(\))?({space}?(?:%|{lx.PERCENT[code]}))?(?:{space}?{scale})?"
    factors = F.create_map(*(F.lit(x) for pair in lx.SCALES[code].items() for x in pair))
    letters = "[A-Za-z]" if english else "[A-Za-zà-öø-ÿ]"

    def numbers(src: Column) -> Column:
        def read(m: Column) -> Column:
            part = lambda i: group(m["raw"], p, i)
            at = m["s"] + F.length(F.regexp_extract(m["raw"], r"(?U)^(\D*)", 1))
            return F.struct(m["s"].alias("s"), m["e"].alias("e"), m["raw"].alias("raw"), *(part(i).alias(n) for i, n in enumerate(("cur", "open", "cur2", "num", "close", "pct", "mult"), 1)), at.alias("at"))

        def keep(m: Column) -> Column:
            end = m["at"] + F.length(m["num"])
            after = F.substring(src, end + 1, F.lit(3))
            low = F.greatest(m["at"] - 24, F.lit(0))
            before = F.substring(src, low + 1, m["at"] - low)
            bare = (m["pct"] == "") & (m["mult"] == "")
            marker = (m["open"] != "") & (m["close"] != "") & (F.length(m["num"]) <= 2) & ~m["num"].rlike("[.,]")
            glued = (m["at"] > 0) & F.substring(src, m["at"], F.lit(1)).rlike("[A-Za-z0-9.]") & (m["cur"] == "") & (m["cur2"] == "")
            rejected = (after.rlike(f"^{letters}") & bare) | after.rlike(r"(?U)^\(\d") | before.rlike("(?iU)" + lx.REFERENCE["en" if english else "locale"]) | glued | marker
            return ~(rejected | after.rlike(r"(?iU)^(?:st|nd|rd|th)\b")) if english else ~rejected

        def token(m: Column) -> Column:
            word = F.regexp_replace(F.lower(m["mult"]), r"(?U)\s+", " ")
            factor = F.when(m["mult"] != "", F.coalesce(F.element_at(factors, word), F.lit(1.0))).otherwise(1.0)
            number = to_number(F.replace(m["num"], F.lit(","), F.lit(""))) if english else parse_locale(m["num"], factor != 1.0)
            kind = F.when(m["pct"] != "", "pct").when(m["mult"] != "", "scaled").otherwise("plain")
            scaled = F.when(kind == "scaled", number * factor).otherwise(number)
            opened, closed = m["open"] != "", m["close"] != ""
            name = word if english else F.when(factor == 1e3, "thousand").when(factor == 1e9, "billion").otherwise("million")
            s = F.when(opened & ~closed, F.when(m["cur2"] != "", m["s"] + F.instr(m["raw"], "(")).otherwise(m["at"])).otherwise(m["s"])
            e = F.when(closed & ~opened & (m["pct"] == "") & (m["mult"] == ""), m["at"] + F.length(m["num"])).otherwise(m["e"])
            return F.struct(
                s.cast("int").alias("s"), e.cast("int").alias("e"), F.when(opened & closed, -scaled).otherwise(scaled).alias("value"), F.substring(text, s + 1, e - s).alias("raw"),
                kind.alias("kind"), F.coalesce(_blank(m["cur"]), _blank(m["cur2"])).alias("currency"), F.when(kind == "scaled", name).alias("mult"),
            )

        found = F.transform(F.filter(F.transform(find_all(src, p), read), keep), token)
        return F.filter(found, lambda n: n["value"].isNotNull())

    return F.when(text.rlike(r"(?U)\d"), let(masked(text, spans), numbers)).otherwise(empty(NUMBER))


def _zh_numbers(text: Column, spans: Column) -> Column:
    # fixed values: how amounts are written in Chinese
    percent = r"(?U)百分之([零一二兩三四五六七八九十百點点]+|\d+(?:\.\d+)?)"
    arabic = rf"(?U)({lx.SYMBOLS_ZH})?([(（])?(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)([)）])?({_alternation(w for w in lx.SCALES['zh'] if w != '百')})?(%|％)?(元|港元|美元|人民幣)?"
    words = r"(?<![第])(港幣|港元|人民幣|美元)?([零一二兩两三四五六七八九十百千萬万億亿]{2,}[點点]?[零一二兩两三四五六七八九]*)(元|港元|美元|人民幣)?"
    factors = F.create_map(*(F.lit(x) for pair in lx.SCALES["zh"].items() for x in pair))

    def token(s: Column, e: Column, value: Column, kind: Column, cur: Column, mult: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), value.cast("double").alias("value"), F.substring(text, s + 1, e - s).alias("raw"), kind.alias("kind"), cur.cast("string").alias("currency"), mult.cast("string").alias("mult"))

    def numbers(src: Column) -> Column:
        none = F.lit(None)

        def of_percent(m: Column) -> Column:
            num = group(m["raw"], percent, 1)
            return token(m["s"], m["e"], F.when(num.rlike(r"(?U)^\d"), to_number(num)).otherwise(cjk_number(num)), F.lit("pct"), none, none)

        def read(m: Column) -> Column:
            part = lambda i: group(m["raw"], arabic, i)
            at = m["s"] + F.length(F.regexp_extract(m["raw"], r"(?U)^(\D*)", 1))
            return F.struct(m["s"].alias("s"), m["e"].alias("e"), *(part(i).alias(n) for i, n in enumerate(("cur", "open", "num", "close", "mult", "pct", "unit"), 1)), at.alias("at"))

        def keep(m: Column) -> Column:
            after = F.substring(src, m["at"] + F.length(m["num"]) + 1, F.lit(2))
            before = F.when(m["at"] > 0, F.substring(src, m["at"], F.lit(1))).otherwise("")
            marker = (m["open"] != "") & (m["close"] != "") & (F.length(m["num"]) <= 2) & (m["mult"] == "") & (m["pct"] == "") & ~m["num"].contains(",")
            # a Latin letter, digit or dot right before belongs to a name such as Q3
            return ~((before == "第") | after.rlike("^[A-Za-z]?[章條項项款節段]") | after.rlike("^[A-Za-z]") | after.rlike(r"(?U)^[(（]\d") | (before.rlike("[A-Za-z0-9.]") & (m["cur"] == "")) | marker)

        def of_arabic(m: Column) -> Column:
            opened, closed = m["open"] != "", m["close"] != ""
            end = m["at"] + F.length(m["num"])
            s = F.when(opened & ~closed, m["at"]).otherwise(m["s"])
            e = F.when(closed & ~opened & (m["mult"] == "") & (m["pct"] == "") & (m["unit"] == ""), end).otherwise(m["e"])
            number = to_number(F.replace(m["num"], F.lit(","), F.lit("")))
            kind = F.when(m["pct"] != "", "pct").when(m["mult"] != "", "scaled").otherwise("plain")
            value = F.when(kind == "scaled", number * F.element_at(factors, m["mult"])).otherwise(number)
            return token(s, e, F.when(opened & closed, -value).otherwise(value), kind, _blank(m["cur"]), F.when(kind == "scaled", m["mult"]))

        def likely(m: Column) -> Column:
            num, unit = group(m["raw"], words, 2), group(m["raw"], words, 3)
            following = F.substring(src, m["e"] + 1, F.lit(1))
            return ~(num.isin(*lx.NOT_NUMBERS_ZH) | ((following != "") & F.lit(lx.NOT_AFTER_ZH).contains(following) & (unit == "")))

        def of_words(m: Column) -> Column:
            num = group(m["raw"], words, 2)
            return token(m["s"], m["e"], cjk_number(num), F.lit("cjk"), _blank(group(m["raw"], words, 1)), F.when(num.contains("萬"), "萬").when(num.contains("億"), "億"))

        first = F.transform(find_all(src, percent), of_percent)
        second = F.transform(F.filter(F.transform(find_all(src, arabic), read), keep), of_arabic)
        third = F.transform(F.filter(find_all(src, words), likely), of_words)
        return by_span(without_overlaps(F.concat(first, second, third), NUMBER))

    return let(masked(text, spans), numbers)


def numbers(text: Column, code: Column | str, date_spans: Column) -> Column:
    rules = {c: (lambda c=c: _latin_numbers(text, date_spans, c)) for c in lx.LOCALES} | {c: (lambda: _zh_numbers(text, date_spans)) for c in ("zh", "ja")}
    return dispatch(code, rules, lambda: _latin_numbers(text, date_spans, "en"))


def none_of(kind: str) -> Column:
    return empty(kind)
