"""Compare a query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def answer(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect(config={"threads": 2})
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (float, np.floating)):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(_plain, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, np.integer):
        return int(x)
    return x


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(_plain(x) for x in r) for r in df[columns].itertuples(index=False, name=None)), key=repr)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, (int, float)) and not isinstance(v, bool):
                assert u == v or abs(u - v) <= 1e-6 * max(1.0, abs(u)), (x, y)
            else:
                assert u == v, (x, y)
