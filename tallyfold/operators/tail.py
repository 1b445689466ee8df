"""Tails of ensembles of losses, scores of their forecasts, and the allocation of a reserve."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.operators.aggregates import order_statistic


def tail(losses: DataFrame, region: str, loss: str, level: float = 0.95) -> DataFrame:
    """Per region mean, order-statistic quantile, and the mean of all losses at or above it: ``region, mean, quantile, shortfall``.

    Losses are counted by value first; the second pass is over the counts, and a region's values are never in one task at once.
    """
    counted = losses.where(F.col(loss).isNotNull()).groupBy(region, loss).agg(F.count(F.lit(1)).alias("__n"))
    q = losses.groupBy(region).agg(F.avg(loss).alias("mean"), order_statistic(level, loss).alias("quantile"))
    beyond = counted.join(q, region).where(F.col(loss) >= F.col("quantile")).groupBy(region).agg((F.sum(F.col(loss) * F.col("__n")) / F.sum("__n")).alias("shortfall"))
    return q.join(beyond, region)


def exceedance(losses: DataFrame, quantiles: DataFrame, region: str, loss: str, quantile: str) -> DataFrame:
    """Share of losses strictly above each region's quantile."""
    above = F.avg((F.col(loss) > F.col(quantile)).cast("double")).alias("exceedance")
    return losses.select(region, loss).join(quantiles.select(region, quantile), region).groupBy(region).agg(above)


def pinball(loss: Column, quantile: Column, level: float) -> Column:
    """Quantile score of one outcome."""
    return (F.lit(level) - (loss <= quantile).cast("double")) * (loss - quantile)


def width_relative_error(value: Column, truth: Column, width: Column, floor: float) -> Column:
    return F.abs(value - truth) / F.greatest(width, F.lit(floor))


def reserve_total(exposure: Column, rate: str, unit: str) -> Column:
    """Exposure times rate, rounded up to a unit, in exact decimals from the shortest decimal strings."""
    amount = exposure.cast("decimal(20,6)") * F.lit(Decimal(rate)).cast("decimal(12,6)")
    return (F.ceil(amount / F.lit(Decimal(unit)).cast("decimal(12,0)")) * F.lit(Decimal(unit)).cast("decimal(12,0)")).cast("decimal(38,0)")


def proportional(rows: DataFrame, weight: str, total: float, name: str = "allocation") -> DataFrame:
    whole = rows.agg(F.sum(weight).alias("__w"))
    return rows.crossJoin(F.broadcast(whole)).withColumn(name, F.lit(total) * F.col(weight) / F.col("__w")).drop("__w")


def uncovered(losses: DataFrame, allocation: DataFrame, region: str, member: str, loss: str, weight: str | None = None) -> DataFrame:
    """Expected loss beyond the allocation, summed over regions with their weights: one row ``uncovered``."""
    w = F.col(weight) if weight else F.lit(1.0)
    over = losses.join(allocation, region).groupBy(region).agg(F.avg(F.greatest(F.col(loss) - F.col("allocation"), F.lit(0.0))).alias("u"), F.max(w).alias("w"))
    return over.agg(F.sum(F.col("u") * F.col("w")).alias("uncovered"))


def greedy_fill(losses: DataFrame, region: str, loss: str, total: float, weights: DataFrame | None = None) -> DataFrame:
    """The allocation that minimises the expected uncovered loss, as if the ensemble were the truth: ``region, allocation``.

    Between one loss of a region and its next larger one, money covers as many members as lie above; these segments are filled
    in the order of slope, region and segment until the total is used up, the rest going to the first region. Segments
    are aggregated to slope and region before the running sum over their global order, which has at most one row per region and distinct slope.
    """
    m = losses.groupBy(region).agg(F.count(F.lit(1)).alias("__m"))
    steps = losses.where(F.col(loss).isNotNull()).groupBy(region, loss).agg(F.count(F.lit(1)).alias("__n"))
    part = W.partitionBy(region).orderBy(loss)
    below = F.coalesce(F.sum("__n").over(part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    width = F.greatest(F.col(loss), F.lit(0.0)) - F.greatest(F.coalesce(F.lag(loss).over(part), F.lit(0.0)), F.lit(0.0))
    seg = steps.withColumns({"__below": below, "__width": width}).where(F.col("__width") > 0).join(m, region)
    seg = seg.join(weights, region) if weights is not None else seg.withColumn("weight", F.lit(1.0))
    seg = seg.withColumn("__slope", F.col("weight") * (F.col("__m") - F.col("__below")) / F.col("__m")).groupBy("__slope", region).agg(F.sum("__width").alias("__width"))
    order = W.orderBy(F.col("__slope").desc(), region)
    before = F.coalesce(F.sum("__width").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    used = seg.withColumn("__used", F.least(F.col("__width"), F.greatest(F.lit(0.0), F.lit(float(total)) - before)))
    filled = used.groupBy(region).agg(F.sum("__used").alias("allocation"))
    rest = filled.agg((F.lit(float(total)) - F.sum("allocation")).alias("__rest"), F.min(region).alias("__first"))
    return filled.crossJoin(F.broadcast(rest)).select(region, (F.col("allocation") + F.when(F.col(region) == F.col("__first"), F.col("__rest")).otherwise(0.0)).alias("allocation"))


def skill(baseline: Column, value: Column, best: Column) -> Column:
    """How much of the way from baseline to best was gone; NULL where there is no way to go."""
    return F.when(baseline - best > 0, (baseline - value) / (baseline - best))


def rate_sweep(worlds: DataFrame, world: str, margin: str, rates: list[float], least: float = 0.01) -> DataFrame:
    """The largest rate at which every world keeps a relative margin of at least ``least``: margin is a column of need per unit of rate."""
    grid = worlds.sparkSession.createDataFrame([(r,) for r in rates], "rate double")
    kept = worlds.crossJoin(F.broadcast(grid)).groupBy("rate").agg(F.min(1 - F.col("rate") * F.col(margin)).alias("worst"))
    return kept.where(F.col("worst") >= least).agg(F.max("rate").alias("rate"))
