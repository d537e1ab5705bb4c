"""Quality rules as a short-circuit cascade, native.

Each rule rejects a text by measures of it.  On a sample the cascade estimates
what a rule costs and how many rows it rejects, and orders the rules by
rejections per cost; ties keep the order given.  The verdict is the first rule
that rejects: a CASE expression, which evaluates the measures of no later rule.
The order changes the cost and the name of the rule that is reported, never
whether a row is kept.

The sample is the rows whose texts have the smallest seeded hashes, about
``SAMPLE_ROWS`` of all: equal texts are one row with their number, so that a
group of copies neither floods nor misses it.  It is written once; one
aggregation over it gives all estimates.  A rule costs what its measures cost:
``COSTS`` holds their nanoseconds for each code point, fixed by timing, and the
sample tells how many code points a row has and which measures earlier columns
have paid for.  So two runs on the same rows have the same order.

A caller that wants measures as columns names them: these are computed once for
every row and free for the rules; the others are computed only in rows that
reach a rule that needs them.

Defined results: a null or empty text has all measures 0 and fails
``too_short``; repeated rows are judged alike; very long texts are judged whole;
extra columns pass through, and a result column takes the place of an input
column of its name; on an empty table the rules keep the order given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import SPACE_CLASS, SPACES, let, materialize, text_of, with_results, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

#: Rows on which costs and selectivities are estimated, and the seed of their choice.
SAMPLE_ROWS = 2000
SEED = 29

#: Nanoseconds for each code point of a text, by timing on one core.
COSTS = {"n_words": 70, "word_chars": 60, "n_symbols": 55, "n_dup_lines": 20, "n_repeat_words": 390, "n_capitals": 55, "n_lines": 10, "n_alpha_words": 100, "n_text_lines": 10, "n_bullets": 15, "n_ellipses": 30}
#: What a rule costs on measures that are there: one comparison.
LEAST_COST = 10.0

BULLET = "^[\\x20\\x09-\\x0D]*[-*\u2022\u2013\u00b7\u25cf]"
ELLIPSIS = "(\\.\\.\\.|\u2026)[\\x20\\x09-\\x0D]*\\z"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the text.

    Linear but for texts with a repetition: only these sort their windows.
    Windows of one text are compared by 64-bit hashes.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

        unsorted = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(unsorted), of_sorted))

    def hashed(w: Column) -> Column:
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))), covered))

    return let(words, hashed)


def measures(text: Column) -> dict[str, Column]:
    """Name -> measure; each stands alone, so that a cascade computes what it needs."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    bare = F.translate(text, SPACES, "")
    return {
        "n_words": F.size(words_of(text)).cast("bigint"),
        "word_chars": F.length(bare).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words_of(text)).cast("bigint"),
        "n_capitals": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("bigint"),
        "n_lines": F.size(F.split(text, "\n", -1)).cast("bigint"),
        "n_alpha_words": F.size(F.filter(words_of(text), lambda w: w.rlike("\\p{L}"))).cast("bigint"),
        "n_text_lines": F.size(lines).cast("bigint"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(BULLET))).cast("bigint"),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))).cast("bigint"),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures it names to a boolean."""

    name: str
    needs: tuple[str, ...]
    rejects: object

    def on(self, values: dict[str, Column]) -> Column:
        return self.rejects(*(values[n] for n in self.needs))


RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 20),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("shouting", ("n_capitals", "word_chars"), lambda c, w: 2 * c > w),
    Rule("word_length", ("word_chars", "n_words"), lambda w, n: (w < 2 * n) | (w > 15 * n)),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (10 * d > 3 * n)),
    Rule("few_letters", ("n_alpha_words", "n_words"), lambda a, n: 10 * a < 6 * n),
    Rule("bullets", ("n_bullets", "n_text_lines"), lambda b, n: (n >= 3) & (10 * b > 9 * n)),
    Rule("ellipses", ("n_ellipses", "n_text_lines"), lambda e, n: (n >= 3) & (10 * e > 3 * n)),
)


@dataclass(frozen=True)
class Estimate:
    """``cost`` in nanoseconds for a row, ``rejected`` rows of the sample."""

    rule: Rule
    cost: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, LEAST_COST)


def sample(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(t, n): about ``sample_rows`` rows, those with the smallest hashes of their texts; equal texts once with their number."""
    rows = docs.select(text_of(text).alias("t"))
    whole = 1 << 40
    bar = min(whole, -(-sample_rows * whole // max(1, rows.count())))
    h = F.xxhash64(F.lit(SEED), "t")
    chosen = rows.withColumn("h", h).where(F.pmod("h", F.lit(whole)) < bar)
    return materialize(chosen.groupBy("h").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n")).select("t", "n"))


def estimate(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, paid: tuple[str, ...] = ()) -> list[Estimate]:
    """Cost and rejections of every rule on the sample; measures in ``paid`` cost nothing."""
    rows = sample(docs, text, sample_rows)
    values = measures(F.col("t"))
    counts = [F.sum(F.when(r.on(values), F.col("n")).otherwise(0)).alias(f"r{i}") for i, r in enumerate(rules)]
    found = rows.agg(F.sum(F.col("n") * F.length("t")).alias("chars"), F.sum("n").alias("rows"), *counts).first()
    mean = (found["chars"] or 0) / max(1, found["rows"] or 0)
    cost = lambda r: mean * sum(COSTS.get(m, 50) for m in set(r.needs) - set(paid))
    return [Estimate(r, cost(r), found[f"r{i}"] or 0) for i, r in enumerate(rules)]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, in this order, or null."""
    result = F.lit(None).cast("string")
    for rule in reversed(rules):
        result = F.when(rule.on(values), F.lit(rule.name)).otherwise(result)
    return result


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, columns: tuple[str, ...] = ()) -> DataFrame:
    """Every row with ``failed_rule`` (null: none) and ``kept``, after the measures named in ``columns``."""
    order = ordered(estimate(docs, text, rules, sample_rows, columns))
    rows = docs.select(F.struct("*").alias("row"), text_of(text).alias("t"))
    values = measures(F.col("t"))
    rows = rows.select("row", "t", *(values[n].alias(f"m_{n}") for n in columns))
    ready = {n: F.col(f"m_{n}") for n in columns}
    rows = rows.withColumn("failed", verdict(order, values | ready))
    return with_results(rows, ready | {"failed_rule": F.col("failed"), "kept": F.col("failed").isNull()})


RULES_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE_CLASS}+'), lambda x: x <> '') AS w FROM base
), placed AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW}
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM placed
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), gaps AS (
  SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS g FROM twice
), repeats AS (
  SELECT doc_id, sum(g) AS r FROM gaps GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{SPACE_CLASS}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         len(string_split(text, chr(10))) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         coalesce(r, 0) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)
), counted AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_text_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_ellipses
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_capitals > word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines
            OR 10 * n_alpha_words < 6 * n_words OR n_text_lines >= 3 AND (10 * n_bullets > 9 * n_text_lines OR 10 * n_ellipses > 3 * n_text_lines)) AS kept
FROM counted
"""
