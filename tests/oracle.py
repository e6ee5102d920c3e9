"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd


def connect(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(directory):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{directory}/{f}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return None
    if type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    if isinstance(x, str):
        return x
    f = float(x)
    return int(f) if f == int(f) else f


def canon(df: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))
