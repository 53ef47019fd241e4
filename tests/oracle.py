"""Differential check helpers: Spark job vs the DuckDB oracle on the same raw tables."""


import duckdb
import pandas as pd

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "pages", "benchmark", "labels"]


def duck(sf_dir):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
        return "NULL"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))          # an int column holding NULLs arrives as float
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def canon(df):
    cols = sorted(df.columns)
    return sorted(tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
