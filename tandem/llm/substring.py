"""Removal of word passages that occur earlier in the corpus: difference-cover anchors.

A word goes if it lies in a window of ``window`` words whose words also stand
earlier: in a document with a smaller id, or further up in the same one.

Hashing every window would move a row for each word of the corpus.  Instead
short anchors are hashed, and only at positions whose remainder modulo a period
lies in a difference cover.  For any two positions some offset below the period
brings both onto the cover, so two equal windows always share an anchor at the
same offset, if anchor and period together fit the window.  (Window 20, period
13, cover of 4: anchors of 8 words at 4 of 13 positions.)

1. Count the anchors by hash; those that occur twice or more are written out.
2. Find where they occur: the places around which a long match can lie.
3. Extend: hash (128 bits) every window that holds such a place, and take the
   first occurrence of each.
4. In each document, windows at such places that are not first occurrences go.

Of whole copies only the first has its windows hashed: in the others every
window starts earlier.

Scale: texts are hashed in Arrow batches, whose rows leave in small batches; a
worker holds one document's hashes and about ``ROWS`` rows.  Counts and first
occurrences are combined before they are shuffled, so that a passage that a
third of all documents share is a few rows for each task.  Step 2 is a plain
join of two written or scanned tables, whose hot keys Spark splits.  No pairs
of documents are ever formed.  Texts move by document id.

Defined results: null and empty texts and texts below ``window`` words lose
nothing; very long texts are judged whole; an empty table stays empty.  Repeated rows (same id, same text) are one document and lose the same
words; rows with one id and different texts are documents ordered by a hash of
the text.  A null id counts as smaller than any other.  Extra columns pass
through; ``n_words``, ``n_removed`` and the text are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import hash128, materialize, text_of, with_results
from tandem.llm.hashing import run_hashes, word_hashes

WINDOW = 20

#: Rows that a worker holds before it passes them on.
ROWS = 100_000

#: Words of an anchor, at least: shorter ones would occur everywhere.
ANCHOR_WORDS = 8


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences modulo ``period`` are all remainders."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


def plan_anchors(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor words: the sparsest cover of which anchors fit the window."""
    periods = range(1, max(2, min(31, window - ANCHOR_WORDS + 2)))
    period = min(periods, key=lambda p: (len(difference_cover(p)) / p, -p))
    return period, difference_cover(period), window - period + 1


def cover_positions(n_words: int, period: int, cover: tuple[int, ...], size: int) -> np.ndarray:
    """Positions on the cover at which an anchor fits, sorted."""
    last = n_words - size
    if last < 0:
        return np.zeros(0, np.int64)
    periods = np.arange(0, last + 1, period)
    at = (periods[:, None] + np.array(cover)).ravel()
    return at[at <= last]


def starts_near(places: np.ndarray, n_words: int, window: int, size: int) -> np.ndarray:
    """Sorted starts of the windows that hold an anchor at one of the places."""
    last = n_words - window
    if last < 0 or not len(places):
        return np.zeros(0, np.int64)
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.clip(places - (window - size), 0, last + 1), 1)
    np.add.at(edge, np.clip(places + 1, 0, last + 1), -1)
    return np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """For each word whether a window at one of the starts covers it."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n_words] > 0


def first_windows(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, start) of the windows at ``starts``, the first of equal ones only."""
    h1, h2 = run_hashes(words, window, starts), run_hashes(words, window, starts, second=True)
    order = np.lexsort((starts, h2, h1))
    same = np.zeros(len(order), bool)
    same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    stay = np.sort(order[~same])
    return h1[stay], h2[stay], starts[stay]


def _flat(batches: Iterator[pa.RecordBatch], own: list[str], of_row: Callable[[pa.RecordBatch, int], tuple[np.ndarray, ...]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Some rows for each row: its columns ``own``, and the arrays that ``of_row`` returns; in batches of about ``ROWS`` rows."""
    for batch in batches:
        rows, parts, n = [], [], 0
        for r in range(batch.num_rows):
            found = of_row(batch, r)
            if len(found[0]):
                rows.append(r)
                parts.append(found)
                n += len(found[0])
            if parts and (n > ROWS or r + 1 == batch.num_rows):
                at = pa.array(np.repeat(rows, [len(p[0]) for p in parts]))
                made = [pa.array(np.concatenate(x).view(np.int64) if t == pa.int64() else np.concatenate(x).astype(np.int32), t) for x, t in zip(zip(*parts, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own), *made], names=own + names)
                rows, parts, n = [], [], 0


def later_copies(rows: DataFrame) -> DataFrame:
    """(k): documents whose whole text is that of a document with a smaller id."""
    hashed = rows.select("k", *(h.alias(f"h{i}") for i, h in enumerate(hash128(F.col("t")))))
    first = materialize(hashed.groupBy("h0", "h1").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last"))
    return materialize(hashed.join(first, ["h0", "h1"]).where("k > first").select("k").distinct())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row with its kept words joined by a space, ``n_words`` before and ``n_removed``."""
    period, cover, size = plan_anchors(window)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), text_of(text).alias("t"), F.hash(F.col(text)).alias("th"))
    by_id = rows.groupBy("k").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b OR k IS NULL").isEmpty()
    own = ["k"] if by_id else ["k", "th"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)

    def same(left: str, right: str) -> Column:
        return F.expr(" AND ".join(f"{left}{c} <=> {right}{c}" for c in own))

    def named(prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in own]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_row(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
            words = word_hashes(batch.column("t")[r].as_py(), lower=False)
            at = cover_positions(len(words), period, cover, size)
            return at, run_hashes(words, size, at)

        return _flat(batches, own, of_row, ["p", "h"], [pa.int32(), pa.int64()])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_row(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words = word_hashes(batch.column("t")[r].as_py(), lower=False)
            places = batch.column("places")[r].values.to_numpy()
            return first_windows(words, starts_near(places, len(words), window, size), window)

        return _flat(batches, own, of_row, ["h1", "h2", "i"], [pa.int64(), pa.int64(), pa.int32()])

    placed = rows.select(*own, "t").mapInArrow(anchors, f"{kinds}, p int, h bigint")
    repeated = materialize(placed.groupBy("h").count().where("count > 1").select("h"))
    places = materialize(placed.join(repeated, "h").groupBy(*named("p")).agg(F.collect_list("p").alias("places")))

    near = rows.select(*own, "t").join(places, same("", "p"))
    copies = later_copies(rows) if by_id else None
    if copies is not None:
        near = near.join(copies, "k", "left_anti")
    seen = near.select(*own, "t", "places").mapInArrow(windows, f"{kinds}, h1 bigint, h2 bigint, i int").groupBy("h1", "h2")
    if by_id:
        first = seen.agg(F.min_by("i", "k").alias("i"), F.min("k").alias("k"))
    else:
        first = seen.agg(F.min(F.struct("k", "th", "i")).alias("f")).select("f.*")
    firsts = materialize(first.groupBy(*named("f")).agg(F.collect_list("i").alias("firsts")))

    marks = places.join(firsts, same("p", "f"), "left").drop(*("f" + c for c in own))
    copied = F.lit(False)
    if copies is not None:
        marks = marks.join(copies.select(F.col("k").alias("ck"), F.lit(True).alias("copy")), F.col("pk") == F.col("ck"), "left").drop("ck")
        copied = F.coalesce("copy", F.lit(False))
    joined = rows.join(marks, same("", "p"), "left")

    def judged(texts: pa.Array, places: pa.Array, firsts: pa.Array, copied: pa.Array) -> pa.Array:
        out = []
        for t, p, f, copy in zip(texts, places, firsts, copied, strict=True):
            words = t.as_py().encode("utf-8").split()
            n = len(words)
            if p.is_valid and n >= window:
                if copy.as_py():
                    gone = np.ones(n, bool)
                else:
                    starts = starts_near(p.values.to_numpy(), n, window, size)
                    gone = covered(np.setdiff1d(starts, f.values.to_numpy(), assume_unique=True) if f.is_valid else starts, n, window)
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8")))
        n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n", "gone", "kept"])

    out = joined.withColumn("j", F.arrow_udf(judged, "n bigint, gone bigint, kept string")(F.col("t"), F.col("places"), F.col("firsts"), copied))
    return with_results(out, {text: F.col("j.kept"), "n_words": F.col("j.n"), "n_removed": F.col("j.gone")})


#: DuckDB: the contract's digest of ``remove_repeats``.
REPEATS_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), placed AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM words WHERE len(w) >= {WINDOW}
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM placed
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM later, range(0, {WINDOW}) AS r(j)
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), judged AS (
  SELECT e.doc_id, e.p, e.word, g.p IS NOT NULL AS removed FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""
