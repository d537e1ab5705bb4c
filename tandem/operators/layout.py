"""Layout lines -> blocks -> sentences.

Lines are the ingestion boundary: ``lines(run_id, slot, page, block_no, line_no,
text, size, bold, x0, y0, x1, y1)``.  Everything is keyed by (run_id, slot), so
that many documents are laid out in one job; ``scripts(run_id, slot, script)``
says how texts join and split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandem.functions.language import is_cjk, sentences

DOC = ("run_id", "slot")

#: What a page number and a numbered heading look like.
PAGE_NUMBER = r"(?iU)^\s*(?:[-–—]\s*)?(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?(?:\s*[-–—])?\s*$|^\s*第\s*\d+\s*頁(?:\s*，?\s*共\s*\d+\s*頁)?\s*$"
NUMBERED = (r"^\d+\.\s", r"^\([a-z]\)", "^[一二三四五六七八九十]+、")
_CJK = "一-鿿，。、；：「」（）"
GAP, SIZE_STEP, MIN_TEXT = 0.4, 0.6, 20


def project_lines(spans: DataFrame) -> DataFrame:
    """Spans of a line -> the line: joined text, dominant size, bold only if all are.

    ``spans(run_id, slot, page, block_no, line_no, span_no, text, size, bold, x0, y0, x1, y1)``.
    """
    keys = [*DOC, "page", "block_no", "line_no"]
    by_size = spans.groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("span_no").alias("first"))
    size = by_size.groupBy(*keys).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = spans.groupBy(*keys).agg(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"), F.bool_and("bold").alias("bold"), *box)
    return lines.join(size, keys).where(F.col("text") != "")


def split_blocks(lines: DataFrame) -> DataFrame:
    """Part number of each line within its block: a new part where the size jumps, or after a bold run of one or two leading lines."""
    block = W.partitionBy(*DOC, "page", "block_no").orderBy("line_no")
    jump = F.coalesce(F.abs(F.col("size") - F.lag("size").over(block)) > SIZE_STEP, F.lit(False))
    runs = lines.withColumn("run_no", F.sum(jump.cast("int")).over(block))
    run = W.partitionBy(*DOC, "page", "block_no", "run_no")
    rank = F.row_number().over(run.orderBy("line_no"))
    plain_at = F.min(F.when(~F.col("bold"), F.col("rank"))).over(run)
    led = runs.withColumn("rank", rank).withColumn("lead", plain_at - 1)
    after = F.coalesce(F.col("lead").between(1, 2) & (F.col("rank") > F.col("lead")), F.lit(False))
    return led.withColumn("part", F.col("run_no") * 2 + after.cast("int")).drop("run_no", "rank", "lead")


def _joined(parts: Column, cjk: Column) -> Column:
    text = F.trim(F.when(cjk, F.array_join(parts, "")).otherwise(F.array_join(parts, " ")))
    return F.when(cjk, F.regexp_replace(text, rf"(?U)(?<=[{_CJK}])\s+(?=[{_CJK}])", "")).otherwise(text)


def _dominant(ls: Column) -> Column:
    """Size with most characters; the first seen wins a tie."""
    sizes = F.array_distinct(F.transform(ls, lambda x: x["size"]))
    weight = lambda s: F.aggregate(F.filter(ls, lambda x: x["size"] == s), F.lit(0), lambda a, x: a + F.length(x["text"]))
    return F.element_at(F.array_sort(F.transform(sizes, lambda s, i: F.struct((-weight(s)).alias("w"), i.alias("i"), s.alias("s")))), 1)["s"]


def merged_blocks(lines: DataFrame, scripts: DataFrame) -> DataFrame:
    """(run_id, slot, page, part_no, lines, text): parts, with vertically adjacent ones of one size on a page merged.

    Whether a part joins depends on what its predecessor has become, so the
    parts of a page are folded in order; a page is a bounded group.
    """
    line = F.struct("line_no", "text", "size", "bold", "x0", "y0", "x1", "y1")
    parts = split_blocks(lines).groupBy(*DOC, "page", "block_no", "part").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    parts = parts.join(scripts, list(DOC)).withColumn("cjk", is_cjk(F.col("script")))
    pages = parts.groupBy(*DOC, "page", "cjk").agg(F.array_sort(F.collect_list(F.struct("block_no", "part", "ls"))).alias("ps"))
    text_of = lambda ls: _joined(F.transform(ls, lambda x: x["text"]), F.col("cjk"))

    def step(acc: Column, p: Column) -> Column:
        prev = F.element_at(acc, -1)
        size = _dominant(p["ls"])
        gap = F.get(p["ls"], 0)["y0"] - F.array_max(F.transform(prev, lambda x: x["y1"]))
        near = (F.abs(_dominant(prev) - size) <= SIZE_STEP) & (gap < GAP * size)
        plain = ~text_of(p["ls"]).rlike(PAGE_NUMBER) & ~text_of(prev).rlike(PAGE_NUMBER)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(prev, p["ls"])))
        return F.when((F.size(acc) > 0) & near & plain, grown).otherwise(F.concat(acc, F.array(p["ls"])))

    kind = "array<array<struct<line_no:int,text:string,size:double,bold:boolean,x0:double,y0:double,x1:double,y1:double>>>"
    folded = pages.withColumn("blocks", F.aggregate("ps", F.array().cast(kind), step))
    out = folded.select(*DOC, "page", "cjk", F.posexplode("blocks").alias("part_no", "ls"))
    return out.withColumn("text", text_of(F.col("ls"))).where(F.col("text") != "")


def running_headers(blocks: DataFrame) -> DataFrame:
    """(run_id, slot, text, band): short texts at one height on three pages or more."""
    banded = blocks.where(F.length("text") <= 120).select(*DOC, "page", "text", F.bround(F.array_min(F.transform("ls", lambda x: x["y0"])) / 5).alias("band"))
    return banded.groupBy(*DOC, "text", "band").agg(F.count_distinct("page").alias("n")).where("n >= 3").drop("n")


def body_median(blocks: DataFrame) -> DataFrame:
    """(run_id, slot, median): font size of the body, each block weighing a tenth of its characters."""
    sized = blocks.select(*DOC, _dominant(F.col("ls")).alias("size"), F.greatest(F.lit(1), F.floor(F.length("text") / 10)).alias("w"))
    return sized.groupBy(*DOC).agg(F.coalesce(F.percentile("size", 0.5, F.col("w")), F.lit(10.0)).alias("median"))


def is_heading(text: Column, size: Column, bold: Column, median: Column) -> Column:
    numbered = (F.length(text) <= 80) & ~text.rlike("[.。；;！？!?]$") & text.rlike("|".join(NUMBERED))
    return (F.length(text) <= 300) & ((size > 1.15 * median) | ((F.length(text) <= 200) & bold) | numbered)


def layout(lines: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and sentences, numbered in document order for each run and slot."""
    blocks = merged_blocks(lines, scripts).where(~F.col("text").rlike(PAGE_NUMBER))
    band = F.bround(F.array_min(F.transform("ls", lambda x: x["y0"])) / 5)
    body = blocks.withColumn("band", band).join(running_headers(blocks), [*DOC, "text", "band"], "left_anti")
    sized = body.join(body_median(blocks), list(DOC)).withColumn("font_size", _dominant(F.col("ls")))
    bold = F.forall("ls", lambda x: x["bold"])
    order = W.partitionBy(*DOC).orderBy("page", "part_no")
    side = lambda c, f: F.round(f(F.transform("ls", lambda x: x[c])), 1)
    box = F.array(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
    made = sized.select(*DOC, "page", "cjk", "text", "font_size", box.alias("bbox"), is_heading(F.col("text"), F.col("font_size"), bold, F.col("median")).alias("is_heading"), F.row_number().over(order).alias("block_n"))
    made = made.withColumn("block_id", F.format_string("%s_b%d", "slot", "block_n"))
    pieces = made.where(~F.col("is_heading")).select(*DOC, "block_id", "block_n", "page", F.posexplode(sentences(F.col("text"), F.col("cjk"))).alias("pos", "text"))
    number = F.row_number().over(W.partitionBy(*DOC).orderBy("block_n", "pos"))
    numbered = pieces.withColumn("s_n", number).withColumn("sid", F.format_string("%s_s%d", "slot", "s_n"))
    return made.drop("cjk"), numbered.select(*DOC, "sid", "s_n", "block_id", "page", "text")


def unreadable_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages with fewer than ``MIN_TEXT`` characters of text; pages without lines count.  ``pages(run_id, slot, page)``."""
    chars = lines.groupBy(*DOC, "page").agg(F.sum(F.length(F.trim("text"))).alias("n"))
    return pages.join(chars, [*DOC, "page"], "left").where(F.coalesce("n", F.lit(0)) < MIN_TEXT).select(*DOC, "page")


def sample_text(blocks: DataFrame, chars: int = 4000) -> DataFrame:
    """(run_id, slot, sample): the first characters of each document, for language detection."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_n", "text"))), lambda x: x["text"]), "\n")
    return blocks.groupBy(*DOC).agg(F.substring(text, 1, chars).alias("sample"))


def first_pages_text(blocks: DataFrame, pages: int = 2, chars: int = 3500) -> DataFrame:
    """(run_id, slot, head): blocks of the first pages until ``chars`` are passed; headings marked."""
    line = F.concat(F.when(F.col("is_heading"), "# ").otherwise(""), F.col("text"))
    before = F.coalesce(F.sum(F.length(line)).over(W.partitionBy(*DOC).orderBy("block_n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = blocks.where(F.col("page") <= pages).withColumn("before", before).where(F.col("before") <= chars)
    return kept.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("head"))
