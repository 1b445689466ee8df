"""Table access: Parquet scans and the edge typing of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one Parquet table of a dataset folder; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known(column: str | Column, missing: int = 0) -> Column:
    """``column`` with its raw missing code written as NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(missing), c)


def without_codes(df: DataFrame, ids: list[str] = (), codes: list[str] = (), amounts: list[str] = ()) -> DataFrame:
    """Write every way of saying "missing" as NULL: 0 in ids, -1 in codes, NaN in amounts."""
    out = {c: known(c, 0) for c in ids}
    out |= {c: known(c, -1) for c in codes}
    out |= {c: F.when(~F.isnan(c), F.col(c)) for c in amounts}
    return df.withColumns(out) if out else df
