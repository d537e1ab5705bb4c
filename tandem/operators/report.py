"""Sign-off report of a run as HTML, by string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("Critical", "Material", "Cosmetic")
STATUSES = ("unreviewed", "confirmed", "dismissed", "unresolved")


def escape(x: Column) -> Column:
    x = F.coalesce(x.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def marked(text: Column, span: Column) -> Column:
    """The text, escaped, with a valid span in <mark>."""
    a, b = F.get(span, 0), F.get(span, 1)
    valid = F.coalesce((F.size(span) == 2) & (a >= 0) & (a < b) & (b <= F.length(text)), F.lit(False))
    made = F.concat(escape(F.substring(text, F.lit(1), a)), F.lit("<mark>"), escape(F.substring(text, a + 1, b - a)), F.lit("</mark>"), escape(F.substring(text, b + 1, F.length(text))))
    return F.when(valid, made).otherwise(escape(text))


def shown_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts.try_cast("timestamp"), "d MMMM yyyy, HH:mm 'UTC'"), escape(ts))


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and by status for each run."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v.lower())
    return findings.groupBy("run_id").agg(*(count("severity", s) for s in SEVERITIES), *(count("status", s) for s in STATUSES), F.count(F.lit(1)).alias("total"))


def card(name_a: Column, name_b: Column) -> Column:
    side = lambda name, s: F.concat(F.lit("<div class='side'><h4>"), escape(name), F.when(F.col(f"f.{s}.page").isNotNull(), F.concat(F.lit(", page "), F.col(f"f.{s}.page").cast("string"))).otherwise(""), F.lit("</h4><p>"), marked(F.col(f"f.{s}.text"), F.col(f"f.{s}.span")), F.lit("</p></div>"))
    extra = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"<p class='{label.lower()}'>{label}: "), escape(F.col(c)), F.lit("</p>"))).otherwise("")
    head = F.concat(F.lit("<article class='"), F.lower(F.col("f.severity")), F.lit("'><h3>"), escape(F.col("f.id")), F.lit(" · "), escape(F.initcap(F.replace(F.col("f.type"), F.lit("_"), F.lit(" ")))), F.lit(" · "), escape(F.col("f.status")), F.lit("</h3><p>"), escape(F.col("f.explanation")), F.lit("</p>"))
    return F.concat(head, side(name_a, "en"), side(name_b, "zh"), extra("Reason", "f.dismiss_reason"), extra("Note", "f.note"), F.lit("</article>"))


def render(runs: DataFrame) -> DataFrame:
    """(run_id, html) of run objects: header, counts, cards by severity, English page and id."""
    name = lambda s, default: F.coalesce(F.substring_index(F.col(f"meta.languages.{s}.name"), " (", 1), F.lit(default))
    rows = runs.select("run_id", F.explode_outer("findings").alias("f"), name("en", "English").alias("a"), name("zh", "Chinese").alias("b"))
    rank = F.when(F.col("f.severity") == "Critical", 0).when(F.col("f.severity") == "Material", 1).otherwise(2)
    key = F.struct(rank.alias("r"), F.coalesce("f.en.page", F.lit(10**6)).alias("p"), F.regexp_extract("f.id", r"(\d+)$", 1).try_cast("int").alias("n"), F.col("f.id").alias("id"), card(F.col("a"), F.col("b")).alias("html"))
    count = lambda c, v: F.concat(F.lit(f"<td>{v}: "), F.count_if(F.col(f"f.{c}") == v).cast("string"), F.lit("</td>"))
    table = F.concat(F.lit("<table><tr>"), *(count("severity", s) for s in SEVERITIES), F.lit("</tr><tr>"), *(count("status", s) for s in STATUSES), F.lit("</tr></table>"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("f.id").isNotNull(), key))), lambda x: x["html"]), "\n")
    body = rows.groupBy("run_id").agg(table.alias("table"), cards.alias("cards"))
    head = runs.select("run_id", F.concat(F.lit("<!doctype html><meta charset='utf-8'><h1>"), escape(F.coalesce("meta.company", F.lit("Consistency report"))), F.lit("</h1><p>"), escape(F.col("meta.en_title")), F.lit(" / "), escape(F.col("meta.zh_title")), F.lit(" · "), shown_time(F.col("created_at")), F.lit("</p>")).alias("head"))
    none = F.when(F.col("cards") == "", "<p>No findings.</p>").otherwise(F.col("cards"))
    return head.join(body, "run_id").select("run_id", F.concat("head", "table", none).alias("html"))


def render_plain(findings: DataFrame) -> DataFrame:
    """(run_id, html): findings as one table with fixed columns."""
    cells = [escape(F.col(c)) for c in ("id", "severity", "type", "section", "explanation", "status")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int").alias("n"), "id", row.alias("row")))), lambda x: x["row"]), "\n")
    return findings.groupBy("run_id").agg(F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
