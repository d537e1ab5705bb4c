"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows_of(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(([_cell(x) for x in r] for r in frame[columns].astype(object).itertuples(index=False)), key=str)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Assert equal columns and rows; the number of rows."""
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return len(got)
