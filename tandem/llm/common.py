"""Shared pieces of the training-data operators: words, row keys, scratch tables."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import rx
from tandem.functions.rx import let
from tandem.sources import scratch

#: The characters that separate words, as text and as a character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-separator characters; empty for an empty text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+", -1))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other scripts too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash128(col: Column) -> list[Column]:
    """Two 64-bit hashes with unrelated seeds: together a key without chance collisions."""
    return [F.xxhash64(col), F.xxhash64(F.lit("second"), col)]


#: Session settings while a table is written: shuffle files go with their query, and
#: joins with a counted key table (``wanted``) filter the other side's scan by a
#: Bloom filter of bounded size before it is shuffled.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


_lock = threading.Lock()
_before: dict[SparkSession, list] = {}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The settings hold while any thread writes; the last one puts back what was there before the first."""
    with _lock:
        if spark not in _before:
            _before[spark] = [0, {k: spark.conf.get(k, None) for k in _WRITING}]
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
        _before[spark][0] += 1
    try:
        yield
    finally:
        with _lock:
            _before[spark][0] -= 1
            if not _before[spark][0]:
                for k, v in _before.pop(spark)[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage with files that outlive any executor, and lets Spark
    delete the shuffle files of the finished query right away.
    """
    with _settings(df.sparkSession):
        return scratch.materialize(df)


def wanted(rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``rows``, written out with their counts.

    The test of the count lets Spark build a Bloom filter from the keys and
    apply it to the scan that they are joined with.
    """
    return materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where(F.col(key).isNotNull())).where("times >= 1").select(key)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_results(source: DataFrame, results: dict[str, Column], row: str = "row") -> DataFrame:
    """The columns of the struct ``row``, and the results; a result takes the place of a column of its name."""
    names = source.schema[row].dataType.names
    taken = {n.lower() for n in results}
    return source.select(*(F.col(row)[n].alias(n) for n in names if n.lower() not in taken), *(c.alias(n) for n, c in results.items()))


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that do not overlap."""
    return rx.find_all(text, pattern, ("start", "end", "value"))
