"""Comparing rows of Spark and DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v != v:
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)
