"""SQL twins on DuckDB, and a comparison that ignores order."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return v.item() if hasattr(v, "item") else v

    return Counter(tuple(plain(v) for v in row) for row in df.itertuples(index=False))
