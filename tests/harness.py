"""Runs registered queries beside their SQL, as sorted rows with rounded floats."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(tidy(r[i]) for i in order) for r in rows], key=repr)


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted(names), as_rows(names, out.fetchall())


def spark_rows(df):
    return sorted(df.columns), as_rows(df.columns, df.collect())
