"""Line deduplication over the corpus, native.

Explode the normalised lines, hash them, count distinct documents per hash,
drop the lines whose count reaches the threshold, and put the rest together by
position.

A line's key is the line without white space at both ends, A-Z lower-cased; the
hash is 128 bits wide.  A key of ``min_chars`` code points or more that occurs
in ``min_docs`` documents or more loses all its lines, except those in the
largest document that holds it.

Scale: counts are pre-aggregated before both shuffles, so a line that a third
of all documents hold is a few rows for each task.  The table of frequent
hashes is written out; it meets the occurrences in a plain join, which Spark
broadcasts only below its size threshold and whose hot keys it splits
otherwise.  Texts move once, to meet the positions to drop.

Defined results: a null or empty text is one empty line; very long texts are
split whole; an empty table stays empty.  Rows that repeat a
document id count once and are all treated alike; rows with one id and
different texts count as one document too.  A null id is a document of its own
that never counts as the largest.  Extra columns pass through; ``n_lines``,
``n_dropped`` and the text are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import SPACES, hash128, lower_ascii, materialize, text_of, with_results


def line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: lower_ascii(F.btrim(line, F.lit(SPACES))))


def frequent_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, last): hashes of keys in ``min_docs`` documents, and the largest of these."""
    own = F.array_distinct(F.filter(line_keys(F.col("t")), lambda x: F.length(x) >= min_chars))
    h1, h2 = hash128(F.col("line"))
    held = rows.select("k", F.explode(own).alias("line")).select("k", h1.alias("h1"), h2.alias("h2")).distinct()
    counted = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))
    return materialize(counted.where(F.col("n") >= min_docs).select("h1", "h2", "last"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row with its text less the dropped lines, ``n_lines`` before and ``n_dropped``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t"))
    frequent = frequent_lines(rows, min_chars, min_docs)
    h1, h2 = hash128(F.col("line"))
    placed = rows.select("k", F.xxhash64("t").alias("th"), F.posexplode(line_keys(F.col("t"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    hit = placed.select("k", "th", "pos", h1.alias("h1"), h2.alias("h2")).join(frequent, ["h1", "h2"]).where(~F.col("k").eqNullSafe(F.col("last")))
    drops = hit.groupBy(F.col("k").alias("dk"), F.col("th").alias("dth")).agg(F.collect_set("pos").alias("drop"))
    found = rows.join(drops, F.col("k").eqNullSafe(F.col("dk")) & (F.xxhash64("t") == F.col("dth")), "left")
    lines = F.split(F.col("t"), "\n", -1)
    n_lines = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("drop"))
    kept = F.array_join(F.transform(F.arrays_zip(stay.alias("i")), lambda x: F.get(F.col("ls"), x["i"])), "\n")
    return with_results(
        found.withColumn("ls", lines),
        {text: F.when(F.col("drop").isNull(), F.col("t")).otherwise(kept), "n_lines": n_lines.cast("bigint"), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("bigint")},
    )


#: DuckDB: the contract's digest of ``line_dedup``.
LINES_SQL = """
WITH exploded AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM exploded
), frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS dropped FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
