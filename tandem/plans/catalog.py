"""Registered queries over the driver's tables, with the equivalent SQL.

Typed columns are rendered as sentences in two languages, with deterministic
plants; the operators read them back.  The SQL works on the typed columns, so
that it is independent of the extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import language as lg
from tandem.functions import lexicons as lx
from tandem.functions import tokens as tk
from tandem.operators import align, checks, classify, judge, layout, report
from tandem.plans.audit import audit
from tandem.sources.sample import amount, bilingual_lines, day
from tandem.streaming import review

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where fewer files than cores were read, as a file of one row group keeps one core busy."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


# -- rendering -------------------------------------------------------------------

PRICE = {"en": ("The total price is US$", " in full."), "fr": ("Le prix total est de USD ", " au total."), "de": ("Der Gesamtpreis beträgt USD ", " insgesamt."), "es": ("El precio total es de USD ", " en total.")}
DAY = {"en": ("The order was placed on ", " in writing."), "fr": ("La commande a été passée le ", " par écrit."), "de": ("Der Auftrag wurde am ", " schriftlich erteilt."), "es": ("El pedido se hizo el ", " por escrito.")}


def sentence(frame: tuple[str, str], middle: Column) -> Column:
    return F.concat(F.lit(frame[0]), middle, F.lit(frame[1]))


# -- tokens ----------------------------------------------------------------------


def _number_query(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")).select("o_orderkey", sentence(PRICE[code], amount(F.col("o_totalprice"), code)).alias("text"))
        found = text.select("o_orderkey", F.explode(tk.numbers(F.col("text"), code, tk.none_of(tk.DATE))).alias("n"))
        return found.select("o_orderkey", F.round("n.value", 2).alias("value"), F.col("n.kind").alias("kind"), F.col("n.currency").alias("currency"))

    return run


def _date_query(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")).select("o_orderkey", sentence(DAY[code], day(F.col("o_orderdate"), code)).alias("text"))
        return text.select("o_orderkey", F.explode(tk.dates(F.col("text"), code)).alias("d")).select("o_orderkey", F.col("d.iso").alias("iso"))

    return run


for _code in ("en", "fr", "de", "es"):
    query(f"num_extract_{_code}", f"SELECT o_orderkey, round(o_totalprice, 2) AS value, 'plain' AS kind, '{'US$' if _code == 'en' else 'USD'}' AS currency FROM orders")(_number_query(_code))
    query(f"date_extract_{_code}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")(_date_query(_code))


# -- pair checks -----------------------------------------------------------------


@query("number_mismatch_pairs", "SELECT o_orderkey, 'NUMBER_MISMATCH' AS type, 1 AS n_spans FROM orders WHERE o_orderkey % 97 = 0 AND round(o_totalprice, 2) <> round(o_totalprice + 10.5, 2)")
def number_mismatch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders priced in English and German, every 97th with another amount: the findings."""
    planted = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 10.5).otherwise(F.col("o_totalprice"))
    texts = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")).select("o_orderkey", sentence(PRICE["en"], amount(F.col("o_totalprice"), "en")).alias("a"), sentence(PRICE["de"], amount(planted, "de")).alias("b"))
    found = texts.select("o_orderkey", F.explode(checks.check_pair(F.col("a"), F.col("b"), "en", "de", F.lit("English"), F.lit("German"))).alias("f"))
    return found.select("o_orderkey", F.col("f.type").alias("type"), (F.size("f.en_span") - 1).alias("n_spans"))


@query(
    "date_mismatch_pairs",
    "SELECT o_orderkey, 'DATE_MISMATCH' AS type, 'English date is ' || strftime(o_orderdate, '%-d %B %Y') || '; French is ' || strftime(o_orderdate + INTERVAL 1 DAY, '%-d %B %Y') || '.' AS explanation FROM orders WHERE o_orderkey % 89 = 0",
)
def date_mismatch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dated in English and French, every 89th a day later."""
    planted = F.when(F.col("o_orderkey") % 89 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    texts = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")).select("o_orderkey", sentence(DAY["en"], day(F.col("o_orderdate"), "en")).alias("a"), sentence(DAY["fr"], day(planted, "fr")).alias("b"))
    found = texts.select("o_orderkey", F.explode(checks.check_pair(F.col("a"), F.col("b"), "en", "fr", F.lit("English"), F.lit("French"))).alias("f"))
    return found.select("o_orderkey", F.col("f.type").alias("type"), F.col("f.explanation").alias("explanation"))


_CODES = ("HKD", "USD", "EUR", "GBP", "CAD")
_CODE_SQL = "list_extract(['HKD', 'USD', 'EUR', 'GBP', 'CAD'], CAST({0} % 5 AS INT) + 1)"


@query(
    "currency_mismatch_pairs",
    f"""SELECT c_custkey, 'English uses ' || a || '; Spanish uses ' || b || '.' AS explanation FROM (
  SELECT c_custkey, {_CODE_SQL.format("c_nationkey")} AS a, {_CODE_SQL.format("(c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END)")} AS b FROM customer) WHERE a <> b""",
)
def currency_mismatch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' currencies by nation in two languages, every 11th customer with another one."""
    codes = F.array(*map(F.lit, _CODES))
    shifted = F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0)
    of = lambda n: F.get(codes, (n % 5).cast("int"))
    texts = spread(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")).select("c_custkey", F.concat(F.lit("The account is kept in "), of(F.col("c_nationkey")), F.lit(" only.")).alias("a"), F.concat(F.lit("La cuenta se lleva en "), of(shifted), F.lit(" solamente.")).alias("b"))
    found = texts.select("c_custkey", F.explode(checks.check_pair(F.col("a"), F.col("b"), "en", "es", F.lit("English"), F.lit("Spanish"))).alias("f"))
    return found.select("c_custkey", F.col("f.explanation").alias("explanation"))


@query(
    "bag_match",
    """WITH numbered AS (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY l_linenumber) AS rn FROM lineitem),
shifted AS (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey, v ORDER BY l_linenumber) AS rn FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem)),
joined AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.v AS x, b.v AS y FROM numbered a FULL JOIN shifted b ON a.l_orderkey = b.l_orderkey AND a.v = b.v AND a.rn = b.rn)
SELECT l_orderkey, count(x) FILTER (WHERE y IS NULL) AS n_left, count(y) FILTER (WHERE x IS NULL) AS n_right FROM joined GROUP BY l_orderkey""",
)
def bag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order against the same with every third raised: what finds no equal on either side."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    raised = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    bags = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("a"), raised.alias("b")))).alias("xs"))
    side = lambda c: F.transform("xs", lambda x: x[c])
    left = checks.bag_match(side("a"), side("b"), checks.same, "array<double>")
    return bags.select("l_orderkey", left.alias("m")).select("l_orderkey", F.size("m.a").cast("bigint").alias("n_left"), F.size("m.b").cast("bigint").alias("n_right"))


@query(
    "nearest_pairs",
    """WITH RECURSIVE steps AS (
  SELECT l_orderkey, -1 AS pos, coalesce(list(l_quantity ORDER BY l_linenumber, l_quantity) FILTER (WHERE l_linenumber % 2 = 1), []) AS xs, coalesce(list(l_quantity ORDER BY l_linenumber, l_quantity) FILTER (WHERE l_linenumber % 2 = 0), []) AS ys,
         NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM lineitem GROUP BY l_orderkey
  UNION ALL
  SELECT l_orderkey, pos + 1, xs[2:], ys[1:near - 1] || ys[near + 1:], xs[1], ys[near]
  FROM (SELECT *, CASE WHEN len(xs) = 0 OR len(ys) = 0 THEN 1 ELSE list_position(list_transform(ys, lambda y: abs(y - xs[1])), list_min(list_transform(ys, lambda y: abs(y - xs[1])))) END AS near FROM steps WHERE len(xs) + len(ys) > 0)
)
SELECT l_orderkey, pos, a, b FROM steps WHERE pos >= 0""",
)
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order, odd lines against even ones: nearest first come, first served."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    bags = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("xs"))
    side = lambda odd: F.transform(F.filter("xs", lambda x: (x["l_linenumber"] % 2 == 1) == odd), lambda x: x["l_quantity"])
    pairs = checks.nearest_pairs(side(True), side(False), lambda x, y: F.abs(x - y), "array<double>")
    return bags.select("l_orderkey", F.posexplode(pairs).alias("pos", "p")).select("l_orderkey", "pos", "p.a", "p.b")


# -- text ------------------------------------------------------------------------

_WORDS_SQL = "regexp_extract_all(lower(text), '[a-zà-öø-ÿœ]+')"
_SCORES_SQL = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(s) for s in dict.fromkeys(ws.split()))}], x))) AS {c}_n" for c, ws in lx.STOPWORDS.items())
_BEST_SQL = "greatest(" + ", ".join(f"{c}_n" for c in lx.STOPWORDS) + ")"


@query(
    "lang_detect",
    f"""WITH words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), scored AS (SELECT doc_id, len(w) AS n, {_SCORES_SQL} FROM words),
ranked AS (SELECT *, list_reverse_sort([{', '.join(f'{c}_n' for c in lx.STOPWORDS)}]) AS r FROM scored)
SELECT doc_id, CASE WHEN r[1] < 3 OR r[1] < 0.05 * n OR r[1] < 1.2 * r[2] THEN 'und' {' '.join(f"WHEN {c}_n = r[1] THEN '{c}'" for c in lx.STOPWORDS)} END AS code FROM ranked""",
)
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its function words."""
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", lg.detect_language(F.col("text"))["code"].alias("code"))


@query(
    "lang_confusion",
    f"""WITH words AS (SELECT lang, {_WORDS_SQL} AS w FROM documents), scored AS (SELECT lang, len(w) AS n, {_SCORES_SQL} FROM words),
ranked AS (SELECT *, list_reverse_sort([{', '.join(f'{c}_n' for c in lx.STOPWORDS)}]) AS r FROM scored)
SELECT lang, CASE WHEN r[1] < 3 OR r[1] < 0.05 * n OR r[1] < 1.2 * r[2] THEN 'und' {' '.join(f"WHEN {c}_n = r[1] THEN '{c}'" for c in lx.STOPWORDS)} END AS code, count(*) AS n FROM ranked GROUP BY ALL""",
)
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by given and detected language."""
    found = spread(table(spark, sf_dir, "documents", "lang", "text")).select("lang", lg.detect_language(F.col("text"))["code"].alias("code"))
    return found.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))


@query("script_profile", r"SELECT doc_id, 0 AS han, 0 AS kana, 0 AS hangul, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS latin FROM documents")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every document by script."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(c.cast("bigint").alias(n) for n, c in lg.script_counts(F.col("text")).items()))


_GUARDED_SQL = "text"
for _a in lg.ABBREVIATIONS:
    _GUARDED_SQL = rf"regexp_replace({_GUARDED_SQL}, '{_a.replace('.', chr(92) + '.')}(\s)', '{_a.replace('.', '<DOT>')}\1', 'g')"


@query("sentence_split_counts", rf"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(regexp_replace({_GUARDED_SQL}, '([.!?])\s+([A-ZÀ-ÖØ-Þ("“«])', '\1<SEP>\2', 'g'), '<SEP>')) END AS n_sentences FROM documents""")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", F.size(lg.sentences(F.col("text"), False)).cast("bigint").alias("n_sentences"))


@query("repeated_lines", "SELECT lang, line FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) <= 120 GROUP BY lang, line HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of three documents of a language or more, found as running headers of its pages."""
    lines = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select(F.col("lang").alias("run_id"), F.lit("en").alias("slot"), F.col("doc_id").alias("page"), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("text"))
    return layout.running_headers(lines.withColumn("ls", F.array(F.struct(F.lit(20.0).alias("y0"))))).select(F.col("run_id").alias("lang"), F.col("text").alias("line"))


@query("weighted_median", "SELECT lang, median((n_chars % 97)::DOUBLE) AS median FROM documents, range(0, greatest(1, length(text) // 10)) GROUP BY lang")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median size by language as of a document's body, longer texts weighing more."""
    blocks = table(spark, sf_dir, "documents", "lang", "n_chars", "text").select(F.col("lang").alias("run_id"), F.lit("en").alias("slot"), "text", F.array(F.struct("text", (F.col("n_chars") % 97).cast("double").alias("size"))).alias("ls"))
    return layout.body_median(blocks).select(F.col("run_id").alias("lang"), "median")


_ESCAPED_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query("marked_passages", f"""SELECT doc_id, CASE WHEN length(t) >= 9 THEN {_ESCAPED_SQL.format("t[1:3]")} || '<mark>' || {_ESCAPED_SQL.format("t[4:9]")} || '</mark>' || {_ESCAPED_SQL.format("t[10:]")} ELSE {_ESCAPED_SQL.format("t")} END AS html
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def marked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span [3, 9) of every document marked, as in a report; shorter ones are shown unmarked."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", report.marked(F.coalesce("text", F.lit("")), F.array(F.lit(3), F.lit(9))).alias("html"))


@query("cache_key", "SELECT doc_id, sha256('model' || chr(31) || coalesce(text, '')) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content address of every text as a request."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", judge.cache_key(F.lit("model"), F.coalesce("text", F.lit(""))).alias("key"))


# -- alignment -------------------------------------------------------------------


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("run_id"), F.lit("en").alias("slot"), F.col("turn").cast("int").alias("block_n"), F.lit(1).alias("page"), (F.col("role") == "system").alias("is_heading"), "text", "role", "conv_id", "turn")


@query("section_spans", "SELECT conv_id, turn, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS sec_ord FROM conversations")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of every turn; a system turn opens one."""
    return align.section_spans(conversation_blocks(spark, sf_dir)).select("conv_id", "turn", "sec_ord")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the next turn, as pairs."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    nxt = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("zh_text"))
    made = turns.where("role = 'user'").withColumnRenamed("text", "en_text").join(nxt, ["conv_id", "turn"])
    named = made.withColumns({"run_id": F.col("conv_id").cast("string"), "sec_id": F.lit("sec_1"), "pair_n": F.col("turn").cast("int"), "pair_id": F.format_string("p_%03d", F.col("turn").cast("int"))})
    return named.withColumns({"en_ids": F.array(F.concat(F.lit("en_s"), "turn")), "zh_ids": F.array(F.concat(F.lit("zh_s"), (F.col("turn") + 1)))})


_PAIRS_SQL = "SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'"


@query("context_prev_next", f"SELECT conv_id, turn, lag(a) OVER w AS prev_en, lead(b) OVER w AS next_zh FROM ({_PAIRS_SQL}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring pairs of each pair."""
    return judge.context(conversation_pairs(spark, sf_dir)).select("conv_id", "turn", "prev_en", "next_zh")


@query("batches_of_ten", f"SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10)::INT AS batch_no FROM ({_PAIRS_SQL})")
def batches_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of each pair."""
    return judge.batches(conversation_pairs(spark, sf_dir)).select("conv_id", "turn", "batch_no")


@query(
    "pair_text_join",
    """SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS en_text, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS zh_text
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user' AND trim(text) <> '') > 0 AND count(*) FILTER (WHERE role = 'assistant' AND trim(text) <> '') > 0""",
)
def pair_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and assistant turns of a conversation joined as the two sides of one pair."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("role in ('user', 'assistant')").withColumn("slot", F.when(F.col("role") == "user", "en").otherwise("zh"))
    own = turns.select(F.col("conv_id").cast("string").alias("run_id"), "conv_id", "slot", "turn", F.concat("slot", F.lit("_s"), "turn").alias("sid"), F.lit(1).alias("page"), "text", F.lit("Latn").alias("script"))
    ids = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == s, F.struct("turn", "sid")))), lambda x: x["sid"]).alias(f"{s}_ids")
    pairs = own.groupBy("run_id", "conv_id").agg(ids("en"), ids("zh")).withColumn("pair_id", F.lit("p_001"))
    return checks.pair_texts(pairs, own).where("en_text <> '' AND zh_text <> ''").select("conv_id", "en_text", "zh_text")


@query("unpaired_turns", f"SELECT conv_id, turn FROM conversations WHERE role <> 'system' EXCEPT (SELECT conv_id, turn FROM ({_PAIRS_SQL}) UNION SELECT conv_id, turn + 1 FROM ({_PAIRS_SQL}))")
def unpaired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users and assistants that are in no pair."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").where("role <> 'system'").distinct()
    sid = F.concat(F.when(F.col("role") == "user", "en_s").otherwise("zh_s"), "turn")
    return align.unpaired(turns.withColumns({"run_id": F.col("conv_id").cast("string"), "sid": sid}), conversation_pairs(spark, sf_dir)).select("conv_id", "turn").distinct()


@query("glossary_zip", "SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_name AS en, p_type AS zh FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 40")
def glossary_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of a brand's parts as two term lists of equal length, paired by place; 40 at most."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_type")
    xs = parts.groupBy(F.col("p_brand").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("xs"))
    side = lambda c: F.transform("xs", lambda x: x[c])
    made = align.glossary(xs.select("run_id", side("p_name").alias("en_terms"), side("p_type").alias("zh_terms")))
    return made.select(F.col("run_id").alias("brand"), F.col("ord").cast("bigint").alias("ord"), "en", "zh")


@query(
    "nearest_neighbour",
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, coalesce(min_by(b.event_id, abs(a.n - b.n) * 1000000 + b.n), -1) AS near_id FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'error' GROUP BY a.event_id""",
)
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error of a user the purchase that is nearest by order, as for an omission its neighbour."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("s_n", n)
    own = events.select(F.col("user_id").cast("string").alias("run_id"), F.lit("sec_1").alias("sec_id"), F.lit("en").alias("slot"), F.col("event_id").cast("string").alias("sid"), "s_n", "event_type", "event_id")
    bought = own.where("event_type = 'purchase'")
    pairs = bought.select("run_id", "sec_id", F.col("s_n").alias("pair_n"), F.array("sid").alias("en_ids"), F.array("sid").alias("zh_ids"), F.lit("").alias("en_text"), F.lit(1).alias("en_page"), F.col("sid").alias("zh_text"), F.lit(1).alias("zh_page"))
    near = judge.neighbours(own.where("event_type = 'error'"), own, pairs)
    return near.select(F.col("sid").cast("bigint").alias("event_id"), F.coalesce(F.nullif("other_text", F.lit("")).cast("bigint"), F.lit(-1)).alias("near_id"))


@query("verdict_cascade", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'S' || toxic ELSE 'T' || quality END AS verdict FROM (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id)")
def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two tiers of judgments: the strong one wins where there is one."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    named = rows.select(F.lit("r").alias("run_id"), F.col("doc_id").cast("string").alias("pair_id"), "doc_id", "quality", "toxic")
    triage = named.select("run_id", "pair_id", F.concat(F.lit("T"), "quality").alias("verdict"))
    strong = named.where("doc_id % 3 = 0").select("run_id", "pair_id", F.concat(F.lit("S"), "toxic").alias("verdict"))
    return judge.verdicts(triage, strong).select(F.col("pair_id").cast("bigint").alias("doc_id"), "verdict")


# -- findings --------------------------------------------------------------------

_TYPES = ("NUMBER_MISMATCH", "DATE_MISMATCH", "HEDGE_CHANGE", "WORDING", "MEANING_SHIFT")
_TYPE_SQL = f"list_extract([{', '.join(repr(t) for t in _TYPES)}], CAST(event_id % 5 AS INT) + 1)"
_FINDINGS_SQL = f"""SELECT 'r_' || (user_id % 20) AS run_id, event_id, {_TYPE_SQL} AS type, CASE WHEN event_id % 3 = 0 THEN 'deterministic' ELSE 'llm' END AS source,
  'p_' || lpad((event_id % 60)::VARCHAR, 3, '0') AS pair_id, (event_id % 7)::INT AS page, (event_id % 2)::INT AS s FROM events"""
_DEDUPED_SQL = f"""WITH f AS ({_FINDINGS_SQL}), det AS (SELECT * FROM f WHERE source = 'deterministic' QUALIFY row_number() OVER (PARTITION BY run_id, type, pair_id, s ORDER BY event_id) = 1),
model AS (SELECT * FROM f WHERE source = 'llm' AND (run_id, pair_id) NOT IN (SELECT (run_id, pair_id) FROM det) QUALIFY row_number() OVER (PARTITION BY run_id, type, pair_id ORDER BY event_id) = 1),
kept AS (SELECT *, CASE WHEN type IN ('NUMBER_MISMATCH', 'DATE_MISMATCH') THEN 0 WHEN type IN ('HEDGE_CHANGE', 'MEANING_SHIFT') THEN 1 ELSE 2 END AS r FROM (SELECT * FROM det UNION ALL SELECT * FROM model))"""


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made from events."""
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 5).cast("int"))
    s = (F.col("event_id") % 2).cast("int")
    side = F.struct((F.col("event_id") % 7).cast("int").alias("page"), F.lit("Some words of a text.").alias("text"), F.array(s, s + 4).alias("span"))
    return events.select(
        F.concat(F.lit("r_"), F.col("user_id") % 20).alias("run_id"), F.col("event_id").alias("input_ord"), kind.alias("type"), F.when(F.col("event_id") % 3 == 0, "deterministic").otherwise("llm").alias("source"), F.lit("Terms").alias("section"),
        F.concat(F.lit("p_"), F.lpad((F.col("event_id") % 60).cast("string"), 3, "0")).alias("pair_id"), F.lit(None).cast("string").alias("sentence_id"), side.alias("en"), side.alias("zh"), F.lit("Differs.").alias("explanation"), F.lit(0.875).alias("confidence"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    runs = spark.range(20).select(F.concat(F.lit("r_"), "id").alias("run_id"), F.lit("EN").alias("authoritative"), F.lit("English").alias("name_a"), F.lit("Chinese").alias("name_b"))
    return classify.classify(event_findings(spark, sf_dir), nothing("run_id string, sec_n int, en_heading string, zh_heading string"), nothing("run_id string, en string, zh string"), runs)


@query("finding_dedupe", f"{_DEDUPED_SQL} SELECT run_id, event_id AS input_ord, type, source, pair_id FROM kept")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that stay after both kinds of deduplication."""
    return classify.dedupe(event_findings(spark, sf_dir)).select("run_id", "input_ord", "type", "source", "pair_id")


@query("finding_rank", f"{_DEDUPED_SQL} SELECT run_id, printf('f_%03d', row_number() OVER (PARTITION BY run_id ORDER BY r, page, pair_id, type, CASE source WHEN 'deterministic' THEN 0 ELSE 1 END, event_id)) AS id, type, pair_id, source, 0.88 AS confidence FROM kept")
def finding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the ids that their rank gives them."""
    return classified(spark, sf_dir).select("run_id", "id", "type", "pair_id", "source", "confidence")


@query("finding_counts", f"{_DEDUPED_SQL} SELECT run_id, count(*) FILTER (WHERE r = 0) AS critical, count(*) FILTER (WHERE r = 1) AS material, count(*) FILTER (WHERE r = 2) AS cosmetic, 0 AS reviewed, count(*) AS total, 0 AS unaligned_sections FROM kept GROUP BY run_id")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each run."""
    return classify.recount(classified(spark, sf_dir))


@query("report_rollup", f"{_DEDUPED_SQL} SELECT run_id, count(*) FILTER (WHERE r = 0) AS critical, count(*) FILTER (WHERE r = 1) AS material, count(*) FILTER (WHERE r = 2) AS cosmetic, count(*) AS unreviewed, 0 AS confirmed, 0 AS dismissed, 0 AS unresolved, count(*) AS total FROM kept GROUP BY run_id")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a report's header."""
    return report.rollup(classified(spark, sf_dir))


_DECISIONS_SQL = """SELECT 'r_' || (user_id % 20) AS run_id, 'f_' || lpad((event_id % 90)::VARCHAR, 3, '0') AS finding_id, ts, event_id,
  list_extract(['confirmed', 'dismissed', 'unresolved', 'bogus'], CAST(event_id % 4 AS INT) + 1) AS status, CASE WHEN event_id % 8 < 4 THEN 'false_positive' END AS reason FROM events"""


def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made from events; some are invalid."""
    e = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("confirmed", "dismissed", "unresolved", "bogus"))), (e % 4).cast("int"))
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id").select(
        F.concat(F.lit("r_"), F.col("user_id") % 20).alias("run_id"), F.concat(F.lit("f_"), F.lpad((e % 90).cast("string"), 3, "0")).alias("finding_id"), "ts", status.alias("status"),
        F.when(e % 8 < 4, "false_positive").alias("dismiss_reason"), F.lit(" ").alias("note"), F.lit(True).alias("has_reason"), F.lit(True).alias("has_note"),
    )


@query("decision_last_write", f"SELECT run_id, finding_id, max_by(status, strftime(ts, '%Y%m%d%H%M%S%f') || status) AS status, max_by(CASE WHEN status = 'dismissed' THEN reason ELSE '-' END, strftime(ts, '%Y%m%d%H%M%S%f') || status) AS dismiss_reason FROM ({_DECISIONS_SQL}) WHERE status <> 'bogus' AND NOT (status = 'dismissed' AND reason IS NULL) GROUP BY ALL")
def decision_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision that holds for each finding."""
    last = review.last_decisions(event_decisions(spark, sf_dir))
    return last.select("run_id", "finding_id", F.col("decision.status").alias("status"), F.coalesce("decision.dismiss_reason", F.lit("-")).alias("dismiss_reason"))


@query("decision_errors", f"SELECT CASE WHEN status = 'bogus' THEN 'unknown status' WHEN status = 'dismissed' AND reason IS NULL THEN 'a dismissal needs a reason' ELSE 'none' END AS error, count(*) AS n FROM ({_DECISIONS_SQL}) GROUP BY ALL")
def decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by what is wrong with them."""
    return review.validated(event_decisions(spark, sf_dir)).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("export_gate", f"{_DEDUPED_SQL} SELECT run_id, count(*) FILTER (WHERE r = 0) = 0 AS ready FROM kept GROUP BY run_id")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose critical findings are all decided."""
    return classify.export_gate(classified(spark, sf_dir))


@query("topk_terms", "SELECT p_brand, p_name FROM (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k) <= 40")
def topk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 distinct names of each brand, found as defined terms in a text that defines them all."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    line = F.concat(F.lit('"'), "p_name", F.lit('" means a part.'))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return parts.groupBy("p_brand").agg(text.alias("text")).select("p_brand", F.explode(align.terms(F.col("text"))).alias("p_name"))


# -- more operators ----------------------------------------------------------------


@query("num_extract_zh", "SELECT o_orderkey, round(o_totalprice, 2) AS value, '港幣' AS currency FROM orders")
def num_extract_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices read back from Chinese sentences."""
    text = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.concat(F.lit("總代價為港幣"), F.format_number("o_totalprice", 2), F.lit("元，以現金支付。")).alias("text"))
    return text.select("o_orderkey", F.explode(tk.numbers(F.col("text"), "zh", tk.none_of(tk.DATE))).alias("n")).select("o_orderkey", F.round("n.value", 2).alias("value"), F.col("n.currency").alias("currency"))


@query("date_extract_zh", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_extract_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read back from Chinese sentences, the month in Chinese numerals."""
    months = F.array(*map(F.lit, ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")))
    d = F.col("o_orderdate")
    text = F.concat(F.lit("於"), F.year(d).cast("string"), F.lit("年"), F.element_at(months, F.month(d)), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日訂立。"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.explode(tk.dates(text, "zh")).alias("d")).select("o_orderkey", F.col("d.iso").alias("iso"))


@query("cjk_numerals", "SELECT p_partkey, p_size::DOUBLE AS value FROM part")
def cjk_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written in Chinese numerals and evaluated again."""
    digits = F.array(*map(F.lit, ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")))
    tens, ones = F.get(digits, F.floor(F.col("p_size") / 10).cast("int")), F.get(digits, F.col("p_size") % 10)
    text = F.when(F.col("p_size") >= 20, F.concat(tens, F.lit("十"), ones)).when(F.col("p_size") >= 10, F.concat(F.lit("十"), ones)).otherwise(ones)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", tk.cjk_number(text).alias("value"))


@query("formatted_values", r"SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) AND abs(c_acctbal) < 1000 THEN c_acctbal::BIGINT::VARCHAR WHEN c_acctbal = floor(c_acctbal) THEN format('{:,}', c_acctbal::BIGINT) ELSE regexp_replace(regexp_replace(printf('%.4f', c_acctbal), '0+$', ''), '\.$', '') END AS shown FROM customer")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as an explanation shows them."""
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select("c_custkey", checks.trimmed(F.col("c_acctbal")).alias("shown"))


@query("quoted_spans", "SELECT doc_id, CASE WHEN text[30:45] <> '' THEN strpos(text, text[30:45]) - 1 END AS s FROM documents")
def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of quotations of sixteen characters; none where a document is too short to be quoted."""
    quoted = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("needle", F.substring("text", 30, 16))
    return quoted.select("doc_id", F.get(judge.find_span("text", "needle"), 0).cast("bigint").alias("s"))


@query("prevailing_language", "SELECT n_nationkey, list_extract(['en', 'fr', 'de', 'zh', 'es'], CAST(n_nationkey % 6 AS INT) + 1) AS code FROM nation WHERE n_nationkey % 6 < 5")
def prevailing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each nation's clause names; one speaks of the laws of a country and names none."""
    clauses = F.array(*map(F.lit, ("The English text shall prevail over the others.", "La version française fait foi.", "Maßgeblich ist der Text; die deutsche Fassung ist verbindlich.", "概以中文版本為準。", "En caso de duda prevalecerá la versión española.", "It is subject to the laws of the People's Republic of China, which shall govern its interpretation.")))
    blocks = table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").cast("string").alias("run_id"), F.lit("en").alias("slot"), F.lit(1).alias("block_n"), F.get(clauses, (F.col("n_nationkey") % 6).cast("int")).alias("text"))
    return align.prevailing(blocks).select(F.col("run_id").cast("int").alias("n_nationkey"), "code")


@query(
    "first_pages_text",
    """WITH lined AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '# ' ELSE '' END || text AS line FROM conversations),
summed AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lined)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS head FROM summed WHERE before <= 3500 GROUP BY conv_id""",
)
def first_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation until 3500 characters are passed."""
    return layout.first_pages_text(conversation_blocks(spark, sf_dir)).select(F.col("run_id").cast("bigint").alias("conv_id"), "head")


@query("unreadable_pages", "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) < 20 OR role = 'system'")
def unreadable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages; those of the system have no lines, others are unreadable if short."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("run_id"), F.lit("en").alias("slot"), F.col("turn").alias("page"), "role", "text")
    found = layout.unreadable_pages(turns.select("run_id", "slot", "page"), turns.where("role <> 'system'").select("run_id", "slot", "page", "text"))
    return found.select(F.col("run_id").cast("bigint").alias("conv_id"), F.col("page").alias("turn"))


@query(
    "omission_escalation",
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, '\\p{{Nd}}') OR regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{"|".join(lx.MODALS["en"])})($|[^\\p{{L}}\\p{{N}}_])') OR lower(t) LIKE '%and%' THEN 'Critical' ELSE 'Cosmetic' END AS severity
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def omission_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as minor omissions: material with a number, a modal word or a glossary term."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    words = F.coalesce("text", F.lit(""))
    side = lambda t, span: F.struct(F.lit(1).alias("page"), t.alias("text"), span.alias("span"))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("run_id"), F.lit(1).alias("input_ord"), F.lit("OMISSION_MINOR").alias("type"), F.lit("llm").alias("source"), F.lit("Terms").alias("section"), F.lit(None).cast("string").alias("pair_id"), F.lit("en_s1").alias("sentence_id"),
        side(words, F.array(F.lit(0), F.length(words))).alias("en"), side(F.lit(""), F.lit(None).cast("array<int>")).alias("zh"), F.lit("Left out.").alias("explanation"), F.lit(0.7).alias("confidence"),
    )
    runs = rows.select("run_id", F.lit("EN").alias("authoritative"), F.lit("English").alias("name_a"), F.lit("Chinese").alias("name_b")).distinct()
    glossary = runs.select("run_id", F.lit("and").alias("en"), F.lit("").alias("zh"))
    made = classify.classify(rows, spark.createDataFrame([], "run_id string, sec_n int, en_heading string, zh_heading string"), glossary, runs)
    return made.select(F.col("run_id").cast("bigint").alias("doc_id"), "severity")


@query("progress_stages", "SELECT user_id, max(event_id % 8 + 1)::BIGINT AS reached, max(CASE WHEN event_id % 8 = 7 THEN 1 ELSE 0 END) AS finished FROM events GROUP BY user_id")
def progress_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress of runs: the furthest stage of each."""
    stage = F.get(F.array(*map(F.lit, review.STAGES)), (F.col("event_id") % 8).cast("int"))
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts", stage.alias("stage"), F.lit(True).alias("done"))
    return review.stage_state(events).select(F.col("run_id").cast("bigint").alias("user_id"), "reached", "finished")


@query(
    "accepted_matches",
    """WITH RECURSIVE steps AS (
  SELECT user_id, 0 AS n, list(event_id ORDER BY event_id) AS es, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM events GROUP BY user_id
  UNION ALL
  SELECT user_id, n + 1, es, CASE WHEN free THEN list_append(ls, i) ELSE ls END, CASE WHEN free THEN list_append(rs, j) ELSE rs END
  FROM (SELECT *, i < 20 AND j < 20 AND NOT list_contains(ls, i) AND NOT list_contains(rs, j) AS free FROM (SELECT *, es[n + 1] % 23 AS i, es[n + 1] % 19 AS j FROM steps WHERE n < len(es)))
)
SELECT user_id::VARCHAR AS run_id, unnest(ls)::INT AS i, unnest(rs)::INT AS j FROM steps WHERE n = len(es)""",
)
def accepted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as proposed matches, each accepted if both its places are free."""
    events = table(spark, sf_dir, "events", "event_id", "user_id").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("ord"), (F.col("event_id") % 23).cast("int").alias("i"), (F.col("event_id") % 19).cast("int").alias("j"), F.lit(0.7).alias("score"))
    sides = events.select("run_id", F.lit(20).alias("n_en"), F.lit(20).alias("n_zh")).distinct()
    return align.accept_matches(events, sides).select("run_id", "i", "j")


@query("layout_sentences", None)
def layout_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents laid out into blocks and sentences (tested on a fixture)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select(F.col("doc_id").cast("string").alias("run_id"), F.lit("en").alias("slot"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text")).where(F.trim("text") != "")
    y = (60 + 15 * (F.col("n") % 40)).cast("double")
    placed = lines.select("run_id", "slot", (1 + F.floor(F.col("n") / 40)).cast("int").alias("page"), F.col("n").cast("int").alias("block_no"), F.lit(0).alias("line_no"), "text", F.lit(10.0).alias("size"), (F.length("text") < 40).alias("bold"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(300.0).alias("x1"), (y + 10).alias("y1"))
    scripts = lines.select("run_id", "slot").distinct().withColumn("script", F.lit("Latn"))
    return layout.layout(placed, scripts)[1].select("run_id", "sid", "block_id", "text")


@query(
    "audit_planted",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS numbers, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS dates, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS unaligned, 'EN' AS authoritative, 'en' AS en_code, 'fr' AS zh_code, 4 AS sections,
  'Alpine Trading Limited' AS en_title FROM nation""",
)
def audit_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit of one pair of documents for each nation: every fifth has another price, every fourth another day, every third a section more."""
    n = F.col("n_nationkey")
    at = F.expr("date_add(date'2024-01-01', cast(n_nationkey * 17 as int))")
    price = (n + 1) * 1234.5
    runs = table(spark, sf_dir, "nation", "n_nationkey").select(n.cast("string").alias("run_id"), price.alias("amount"), at.alias("day"), F.when(n % 5 == 0, price + 100).otherwise(price).alias("other_amount"), F.when(n % 4 == 0, F.date_add(at, 3)).otherwise(at).alias("other_day"), (n % 3 == 0).alias("extra"))
    made = audit(bilingual_lines(runs), provider=judge.rule_provider("en", "fr"))
    count = lambda kind: F.count_if(F.col("type") == kind).alias(kind)
    found = made.findings.groupBy("run_id").agg(count("NUMBER_MISMATCH"), count("DATE_MISMATCH"))
    rows = made.meta.join(found, "run_id", "left").join(made.unaligned_sections.groupBy("run_id").agg(F.count(F.lit(1)).alias("u")), "run_id", "left").join(made.sections.groupBy("run_id").agg(F.count(F.lit(1)).alias("sections")), "run_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return rows.select(F.col("run_id").cast("int").alias("n_nationkey"), zero("NUMBER_MISMATCH").alias("numbers"), zero("DATE_MISMATCH").alias("dates"), zero("u").alias("unaligned"), "authoritative", "en_code", "zh_code", F.col("sections").cast("int").alias("sections"), "en_title")


from tandem.plans import vectors  # noqa: E402, F401  (registers its queries here)
