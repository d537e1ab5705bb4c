"""Files of documents as layout lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tandem.sources.runs import LINES, check_uploads

#: Lines of one file that leave a worker at once.
ROWS = 10_000


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(run_id, slot, path, content) of files ``<run_id>/<slot>.<ending>`` below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("slot"), "path", "content")


def lines_of(files: DataFrame, parse: Callable[[bytes], Iterable[tuple]], checked: bool = True) -> DataFrame:
    """Layout lines of the files that ``parse`` reads; empty files and files that are no PDF are left out if ``checked``.

    ``parse`` gives (page, block_no, line_no, text, size, bold, x0, y0, x1, y1) of
    one file; which library it uses is the caller's choice.  A file is parsed
    where it is read, and its lines leave in bounded batches.
    """
    schema = StructType.fromDDL(LINES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, slot, content in zip(*(batch.column(c) for c in ("run_id", "slot", "content")), strict=True):
                rows = []
                for line in parse(content.as_py()):
                    rows.append((run_id.as_py(), slot.as_py(), *line))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    good = check_uploads(files).where("error is null") if checked else files
    return good.select("run_id", "slot", "content").mapInArrow(run, schema)
