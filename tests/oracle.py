"""Compares a query with its oracle: row sets by column name."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    out = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    left, right = list(map(repr, a)), set(map(repr, b))
    return f"{len(a)} and {len(b)} rows; e.g. {[x for x in left if x not in right][:3]} for {sorted(right - set(left))[:3]}"
