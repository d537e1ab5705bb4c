"""Find-all with spans from built-in expressions.

Offsets are code points, end exclusive.  Patterns get the flag ``U`` so that
``\\d``, ``\\s`` and ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<s:int,e:int,raw:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def find_all(text: Column, pattern: str, names: tuple[str, str, str] = ("s", "e", "raw")) -> Column:
    """Array of (s, e, raw) of the leftmost matches that do not overlap.

    The pieces between the matches and the matches themselves give the offsets
    by their lengths.  The pattern must not match the empty text.  Matches are
    summed up in blocks of about the square root of their number, since each
    step of a fold copies the array that it extends.
    """
    start, end, value = names
    kind = f"array<struct<{start}:int,{end}:int,{value}:string>>"

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                raw = F.get(m, i)
                s = acc["at"] + F.length(F.get(g, i))
                e = s + F.length(raw)
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias(start), e.alias(end), raw.alias(value)))).alias("out"))

            width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(m))).cast("int"))

            def block(acc: Column, b: Column) -> Column:
                zero = F.struct(acc["at"].alias("at"), empty(kind).alias("out"))
                own = F.aggregate(F.sequence(b * width, F.least((b + 1) * width, F.size(m)) - 1), zero, step)
                return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

            zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / width).cast("int")), zero, block, lambda a: F.flatten(a["out"]))

        # most patterns find nothing: the text is split only for those that do
        return F.when(F.size(m) == 0, empty(kind)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def group(raw: Column, pattern: str, index: int) -> Column:
    """A group of a match, matched again on its own; '' if it took no part."""
    return F.regexp_extract(raw, pattern, index)


def without_overlaps(matches: Column, kind: str) -> Column:
    """Matches in order, each dropped if it overlaps one that was taken before."""

    def step(acc: Column, m: Column) -> Column:
        return F.when(F.exists(acc, lambda t: (m["s"] < t["e"]) & (m["e"] > t["s"])), acc).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(matches, empty(kind), step)


def masked(text: Column, spans: Column) -> Column:
    """The text with the spans blanked, so that offsets stay."""

    def step(acc: Column, m: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), m["s"]), F.repeat(F.lit(" "), m["e"] - m["s"]), F.substring(acc, m["e"] + 1, F.length(acc)))

    return F.aggregate(spans, text, step)


def by_span(matches: Column) -> Column:
    """Sorted by start, then end: struct order, as these come first."""
    return F.array_sort(matches)
