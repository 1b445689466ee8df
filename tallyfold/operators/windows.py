"""Ranks, ladders, moving averages and running products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def place(df: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """``df`` with the position of each row from 1 by ``order`` within ``by``, and the size of its group as ``{name}_of``.

    Without ``by`` rows are ranged by the first order column: each task ranks its own range on top of the sizes of the
    ranges before it, so a global rank needs no single task for all rows.
    """
    if by:
        return df.withColumns({name: F.row_number().over(W.partitionBy(*by).orderBy(*order)), f"{name}_of": F.count(F.lit(1)).over(W.partitionBy(*by))})
    from tallyfold.session import stored

    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per task
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    total = sizes.agg(F.sum("__n").alias(f"{name}_of"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").crossJoin(F.broadcast(total)).withColumn(name, inside + F.col("__before")).drop("__part", "__before")


def rank_uniform(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank01") -> DataFrame:
    """Rank from 0 to 1 by value, ties in the order of ``tie``; 0.5 where a group holds one row or one distinct value."""
    ranked = place(df, by, [F.col(value).asc(), F.col(tie).asc()], "__p")
    if by:
        span = {"__lo": F.min(value).over(W.partitionBy(*by)), "__hi": F.max(value).over(W.partitionBy(*by))}
        ranked = ranked.withColumns(span)
    else:
        ranked = ranked.crossJoin(F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))))
    flat = (F.col("__p_of") < 2) | (F.col("__lo") == F.col("__hi"))
    return ranked.withColumn(name, F.when(flat, 0.5).otherwise((F.col("__p") - 1) / (F.col("__p_of") - 1))).drop("__p", "__p_of", "__lo", "__hi")


def quintile_band(df: DataFrame, value: str, tie: str, name: str = "quintile") -> DataFrame:
    """0 to 4 by rank among the positive values, 0 for the others (not ``ntile``: bands are cut at ranks of fifths)."""
    positive = rank_uniform(df.where(F.col(value) > 0), [], value, tie, "__r").withColumn(name, F.least(F.lit(4), F.floor(F.col("__r") * 5)).cast("int")).drop("__r")
    return positive.unionByName(df.where(~F.coalesce(F.col(value) > 0, F.lit(False))).withColumn(name, F.lit(0)))


def ladder(df: DataFrame, by: list[str], value: str, tie: str, low: float, high: float, name: str = "weight") -> DataFrame:
    """Log-spaced weights from ``low`` to ``high`` by rank of ``value``."""
    ranked = rank_uniform(df, by, value, tie, "__r")
    return ranked.withColumn(name, F.exp(F.log(F.lit(low)) + F.col("__r") * (F.log(F.lit(high)) - F.log(F.lit(low))))).drop("__r")


def trailing_mean(value: str, by: list[str], order: str, n: int) -> Column:
    return F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0))


def centred_mean(value: str, by: list[str], order: str, n: int) -> Column:
    """Centred mean over ``n`` rows with zeros beyond the ends."""
    return F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(n // 2), n // 2)) / n


def running_product(factor: Column, by: list[str], order: str) -> Column:
    """Product of positive factors so far; zero from the first factor that is not above zero."""
    up = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    dead = F.max(F.when(factor <= 0, 1).otherwise(0)).over(up)
    return F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(factor > 0, factor))).over(up)))


def share_of_total(value: str | Column, by: list[str]) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return v / F.nullif(F.sum(v).over(W.partitionBy(*by)), F.lit(0))


def pairwise_slope(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of points per group (Theil-Sen). For short series: pairs of one group are formed."""
    a, b = (df.select(*by, F.col(x).alias(f"x{i}"), F.col(y).alias(f"y{i}")) for i in (1, 2))
    pairs = a.join(b, by).where(F.col("x1") < F.col("x2")) if by else a.crossJoin(b).where(F.col("x1") < F.col("x2"))
    return pairs.groupBy(*by).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))
