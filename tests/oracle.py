"""Compare a registered query with its SQL in DuckDB: names, rows and values in any order, floats to nine digits."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connected(sf_dir: str = DATA):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _cell(x) -> str:
    if isinstance(x, (list, tuple)) or (hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict))):
        return repr([_cell(y) for y in x])
    if x is None or x != x:
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 9))
    return str(int(x)) if hasattr(x, "__int__") and not isinstance(x, (str, bytes)) else str(x)


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    differ = (a != b).any(axis=1)
    assert not differ.any(), (a[differ].head(3).to_dict("records"), b[differ].head(3).to_dict("records"))
