"""Personal data: patterns, and terms that give protected values away; native.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers.
Their values are the protected entities.  A term (a run of letters and digits)
can reveal one without being personal data itself: the name that always stands
by one phone number.  How strongly it does is estimated from the corpus,
following information-theoretic sanitisation: the pointwise mutual information
of entity c and term t, against the information content of c,

    PMI(c, t) = log2(N n(c, t) / (n(c) n(t)))  >=  IC(c) / ALPHA,  IC(c) = log2(N / n(c)).

All four counts are of documents: N of all, n(c) and n(t) of those that hold c
or t anywhere, n(c, t) of those that hold t within ``CONTEXT`` code points of c.
A pair counts if documents with two different texts hold it, so that a text does
not give itself away by being copied.  A term above the threshold discloses its
entity in every document that holds the entity, wherever the term stands there:
all its occurrences become spans.  ``sanitise`` generalises all spans to a tag
of their kind.

Scale: texts are scanned once for the patterns; contexts are a few rows for each
value found.  Where a pair qualifies, document frequencies are counted over all
documents, combined by term before they are shuffled, and then joined to the
candidates.  Results are narrow rows by document.

Offsets are code points, end exclusive.  The patterns are written so that the
regex engine neither backtracks nor recurses over long runs; they match what
the plain ones do.

Defined results: null and empty texts have no spans, an empty table no rows;
very long texts are scanned whole; repeated rows each count as a document and
get the same spans; rows that share an id with other texts are told apart by a
hash of the text; extra columns pass through, and ``spans`` and the text are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import find_all, let, lower_ascii, materialize, text_of, with_results

CONTEXT = 120
ALPHA = 1.25

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match: cheap to test.
_HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_TERM = r"[\p{L}\p{N}]+"


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if above it; the sum ends in 0."""

    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the patterns, by kind as in ``KINDS``, then start."""

    def of_kind(kind: str) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        hit = F.instr(text, _HINTS[kind]) > 0 if _HINTS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
        matches = F.when(hit, find_all(text, PATTERNS[kind])).otherwise(none)
        good = F.filter(matches, lambda m: _accepted(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*map(of_kind, KINDS))


def _words(text: Column) -> Column:
    """(start, end, value) of the terms of a text, lower-cased."""
    return F.transform(find_all(text, _TERM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), lower_ascii(m["value"]).alias("value")))


def _clear(words: Column, spans: Column) -> Column:
    """The words that overlap no span."""
    return F.filter(words, lambda m: ~F.exists(spans, lambda s: (m["start"] < s["end"]) & (m["end"] > s["start"])))


def _contexts(text: Column, spans: Column) -> Column:
    """Distinct (entity, term) of a text: the terms within ``CONTEXT`` of each span."""

    def of(span: Column) -> Column:
        low = F.greatest(span["start"] - CONTEXT, F.lit(0))
        left, right = F.substring(text, low + 1, span["start"] - low), F.substring(text, span["end"] + 1, F.lit(CONTEXT))
        moved = lambda side, by: F.transform(_words(side), lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))
        # words cut by the edge of the context are no terms
        inner = F.filter(moved(left, low), lambda m: (m["start"] > low) | (low == 0))
        outer = F.filter(moved(right, span["end"]), lambda m: (m["end"] < span["end"] + CONTEXT) | (m["end"] == F.length(text)))
        near = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < span["end"] + CONTEXT))
        return F.transform(_clear(F.concat(inner, outer), near), lambda m: F.struct(_entity(span).alias("entity"), m["value"].alias("term")))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["value"])


def _span_rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Base spans by row (written out), and term spans by document if there are any."""
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    spans = rows.withColumn("base", base_spans(F.col("t")))
    none = F.array().cast("array<struct<entity:string,term:string>>")
    base = materialize(spans.select("k", "th", "base", F.when(F.size("base") > 0, _contexts(F.col("t"), F.col("base"))).otherwise(none).alias("near")))

    entities = base.where(F.size("base") > 0).select("k", "th", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    near = base.select("th", F.explode("near").alias("x")).select("th", "x.*")
    counted = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("nct"), F.min("th").alias("a"), F.max("th").alias("b"))
    pairs = materialize(counted.where("a <> b").select("entity", "term", "nct"))
    if pairs.isEmpty():
        return base, None
    own = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(_TERM), F.lit(0)))
    frequency = rows.select(F.explode(own).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    by_entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("nc"))
    joint = pairs.join(by_entity, "entity").join(frequency, "term")
    n = F.lit(float(base.count()))
    pmi = F.log2(n * F.col("nct") / (F.col("nc") * F.col("nt")))
    content = F.log2(n / F.col("nc"))
    telling = materialize(joint.where((content > 0) & (pmi >= content / ALPHA)).select("entity", "term"))
    told = materialize(entities.join(telling, "entity").groupBy(F.col("k").alias("tk"), F.col("th").alias("tth")).agg(F.collect_set("term").alias("told")))

    same = F.col("k").eqNullSafe(F.col("tk")) & (F.col("th") == F.col("tth"))
    marked = rows.join(told, same).select("tk", "tth", "told", "t").dropDuplicates(["tk", "tth"])
    hits = F.filter(_words(F.col("t")), lambda m: F.array_contains("told", m["value"]))
    terms = _clear(hits, base_spans(F.col("t")))
    made = F.transform(terms, lambda m: F.struct(F.lit(TERM).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return base, materialize(marked.select("tk", "tth", made.alias("terms")))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): pattern spans, and these with the terms that reveal them, for every row."""
    base, terms = _span_rows(docs, key, text)
    if terms is None:
        return base.select(F.col("k").alias(key), "base", F.col("base").alias("spans"))
    joined = base.join(terms, F.col("k").eqNullSafe(F.col("tk")) & (F.col("th") == F.col("tth")), "left")
    return joined.select(F.col("k").alias(key), "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", "terms")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span as a tag of its kind; of overlapping spans the first one names the tag."""

    def fold(x: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            tag = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(tag)).alias("out")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(x, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(by_place, fold))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its ``spans``, and its text with these generalised to tags of their kind."""
    base, terms = _span_rows(docs, key, text)
    marked = base.select(F.col("k").alias("sk"), F.col("th").alias("sth"), F.col("base").alias("spans_"))
    if terms is not None:
        joined = base.join(terms, F.col("k").eqNullSafe(F.col("tk")) & (F.col("th") == F.col("tth")), "left")
        marked = joined.select(F.col("k").alias("sk"), F.col("th").alias("sth"), F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", "terms")).alias("spans_"))
    marked = marked.where(F.size("spans_") > 0).dropDuplicates(["sk", "sth"])
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t"))
    joined = rows.join(marked, F.col("k").eqNullSafe(F.col("sk")) & (F.xxhash64("t") == F.col("sth")), "left")
    spans = F.coalesce("spans_", F.array().cast(SPAN))
    return with_results(joined, {text: replaced(F.col("t"), spans), "spans": spans})


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ACCEPTED = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})'))) = 0",
    "card": """length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN d[length(d) + 1 - j]::INT
      WHEN d[length(d) + 1 - j]::INT > 4 THEN 2 * d[length(d) + 1 - j]::INT - 9 ELSE 2 * d[length(d) + 1 - j]::INT END)) % 10 = 0""",
    "phone": "length(d) BETWEEN 8 AND 15",
}


def _placed_sql(source: str, keys: str, text: str, pattern: str) -> str:
    """DuckDB: keys, m, s, e of the matches in a text; places by the lengths of what lies before."""
    return f"""SELECT {keys}, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s,
    list_sum(list_transform(gs[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS e
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms, regexp_split_to_array({text}, '{pattern}') AS gs FROM {source}) WHERE len(ms) > 0)"""


def _kind_sql(n: int, kind: str) -> str:
    return f"""SELECT doc_id, text, '{kind}' AS kind, {n} AS ord, s, e, m AS value FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({_placed_sql('base', 'doc_id, text', 'text', _PLAIN[kind])})) WHERE {_ACCEPTED[kind]}"""


_LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB: the contract's digest of ``find_spans``, with the terms.
PII_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), spans AS (
  {" UNION ALL ".join(_kind_sql(n, kind) for n, kind in enumerate(KINDS))}
), near AS (
  SELECT doc_id, kind || ':' || value AS entity, s AS at, e AS stop, greatest(s - {CONTEXT}, 0) AS low, length(text) AS size, md5(text) AS th,
         text[greatest(s - {CONTEXT}, 0) + 1:s] AS before, text[e + 1:e + {CONTEXT}] AS behind FROM spans
), tokens AS (
  SELECT doc_id, th, entity, {_LOWER_SQL.format('m')} AS term, low + s AS s, low + e AS e
  FROM ({_placed_sql('near', 'doc_id, th, entity, low', 'before', '[\\p{L}\\p{N}]+')}) WHERE s > 0 OR low = 0
  UNION ALL
  SELECT doc_id, th, entity, {_LOWER_SQL.format('m')} AS term, stop + s AS s, stop + e AS e
  FROM ({_placed_sql('near', 'doc_id, th, entity, stop, size', 'behind', '[\\p{L}\\p{N}]+')}) WHERE e < {CONTEXT} OR stop + e = size
), clear AS (
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = t.doc_id AND t.s < x.e AND t.e > x.s)
), pairs AS (
  SELECT entity, term, count(DISTINCT doc_id) AS nct FROM clear GROUP BY ALL HAVING count(DISTINCT th) >= 2
), entities AS (
  SELECT entity, count(DISTINCT doc_id) AS nc FROM near GROUP BY entity
), frequencies AS (
  SELECT term, count(*) AS nt FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_LOWER_SQL.format('text')}, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM base) WHERE term IN (SELECT term FROM pairs) GROUP BY term
), n AS (
  SELECT count(*)::DOUBLE AS n FROM base
), telling AS (
  SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN frequencies USING (term), n
  WHERE n > nc AND log2(n * nct / (nc * nt)) >= log2(n / nc) / {ALPHA}
), told AS (
  SELECT DISTINCT doc_id, term FROM near JOIN telling USING (entity)
), holders AS (
  SELECT doc_id, text FROM base WHERE doc_id IN (SELECT doc_id FROM told)
), places AS (
  SELECT doc_id, {_LOWER_SQL.format('m')} AS term, s, e FROM ({_placed_sql('holders', 'doc_id', 'text', '[\\p{L}\\p{N}]+')})
), every AS (
  SELECT doc_id, kind, ord, s, e FROM spans
  UNION ALL
  SELECT doc_id, '{TERM}', {len(KINDS)}, s, e FROM places p JOIN told USING (doc_id, term)
  WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = p.doc_id AND p.s < x.e AND p.e > x.s)
), summed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in KINDS)},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s, e) FILTER (WHERE ord < {len(KINDS)}) AS own, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s, e) AS spans
  FROM every GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM base LEFT JOIN summed USING (doc_id)
"""
