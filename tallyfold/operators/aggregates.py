"""Grouped statistics: hierarchy rollups, medians and order statistics, inequality, regression by moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rollup_levels(df: DataFrame, state: str, county: str, measures: dict[str, Column]) -> DataFrame:
    """Nation, states and counties in one pass: ``level, unit, *measures``; medians are recomputed at each level.

    NULL counties and states are groups of their own (unit NULL below the nation).
    """
    sets = df.groupingSets([[], [state], [state, county]], state, county)
    marked = sets.agg(F.grouping(state).alias("__s"), F.grouping(county).alias("__c"), *[m.alias(k) for k, m in measures.items()])
    level = F.when(F.col("__s") == 1, "nation").when(F.col("__c") == 1, "state").otherwise("county")
    unit = F.when(F.col("__s") == 1, F.lit(0).cast("long")).when(F.col("__c") == 1, F.col(state).cast("long")).otherwise(F.col(county).cast("long"))
    return marked.select(level.alias("level"), unit.alias("unit"), *measures)


def densify(df: DataFrame, dims: list[DataFrame], fill: dict[str, object]) -> DataFrame:
    """``df`` completed to the product of (small) dimension tables, missing rows filled."""
    full = dims[0]
    for d in dims[1:]:
        full = full.crossJoin(F.broadcast(d))
    return full.join(df, full.columns, "left").na.fill(fill)


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Per group the smallest value at which the running weight reaches half the total: ``*by, weighted_median``.

    Rows with NULL value or weight, or weight not above zero, are left out. Weights are first added up per value, with
    map-side combining, so the running sum of a hot group goes over distinct values, not rows.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    part = W.partitionBy(*by)
    up = part.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"__up": F.sum("__w").over(up), "__all": F.sum("__w").over(part)})
    return rows.where(F.col("__up") >= 0.5 * F.col("__all")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def order_statistic(level: float, value: str) -> Column:
    """The value of rank ceil(level n), without interpolation."""
    return F.expr(f"percentile_disc({level}) WITHIN GROUP (ORDER BY {value})")


def quantile_higher(df: DataFrame, by: list[str], value: str, level: float) -> DataFrame:
    """The order statistic at or above the linear quantile: rank ceil(level (n - 1)) from zero. Equal values are counted, not sorted."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    part = W.partitionBy(*by)
    rows = rows.withColumns({"__up": F.sum("__n").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)), "__all": F.sum("__n").over(part)})
    return rows.where(F.col("__up") > F.ceil(F.lit(level) * (F.col("__all") - 1))).groupBy(*by).agg(F.min(value).alias("quantile_higher"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; NULL keys form a group like any other.

    A minimum over a struct, combined on the map side: a key with very many rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient per group from ranks: ``*by, gini``; equal values share their summed ranks. NULL where the sum is not above zero."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    up = F.sum("__n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = rows.withColumn("__up", up).withColumn("__ranks", F.col("__n") * (2 * F.col("__up") - F.col("__n") + 1) / 2)
    sums = ranks.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col(value)).alias("s"), F.sum(F.col("__ranks") * F.col(value)).alias("r"))
    return sums.select(*by, F.when(F.col("s") > 0, 2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def weighted_line(df: DataFrame, by: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least squares by moments: ``*by, slope, intercept``; NULL where x does not vary."""
    m = df.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") > 0))
    s = m.groupBy(*by).agg(
        F.sum("w").alias("w"), F.sum(F.expr("w*x")).alias("wx"), F.sum(F.expr("w*y")).alias("wy"), F.sum(F.expr("w*x*x")).alias("wxx"), F.sum(F.expr("w*x*y")).alias("wxy")
    )
    slope = F.expr("(w*wxy - wx*wy) / nullif(w*wxx - wx*wx, 0)")
    return s.withColumn("slope", slope).select(*by, "slope", F.expr("(wy - slope*wx) / w").alias("intercept"))


def effective_size(weight: str) -> Column:
    """Kish's effective sample size."""
    return F.sum(weight) * F.sum(weight) / F.nullif(F.sum(F.col(weight) * F.col(weight)), F.lit(0))


def apportion(df: DataFrame, by: list[str], order: list[str], weight: str, total: str, name: str = "seats") -> DataFrame:
    """``df`` with integers in proportion to ``weight`` that add up to ``total`` per group (largest remainders, ties to the first by ``order``)."""
    part = W.partitionBy(*by)
    share = F.coalesce(F.col(weight) / F.nullif(F.sum(weight).over(part), F.lit(0)), F.lit(0.0)) * F.col(total)
    cut = df.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    place = F.row_number().over(part.orderBy((F.col("__share") - F.col("__floor")).desc(), *order))
    left = F.col(total) - F.sum("__floor").over(part)
    return cut.withColumns({"__place": place, "__left": left}).withColumn(name, F.col("__floor") + (F.col("__place") <= F.col("__left")).cast("long")).drop("__share", "__floor", "__place", "__left")
