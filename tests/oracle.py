"""Comparison of a query with its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def cell(v) -> str:
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "NULL"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(query, sql: str, spark, folder: str) -> None:
    a, b = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
