"""Occurrence over exposure, credibility, shrinkage, year effects and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.functions.scalars import clip, ratio
from tallyfold.operators.aggregates import weighted_line, weighted_median


def rates(cells: DataFrame, levels: list[list[str]], events: str, exposure: str) -> DataFrame:
    """Events, exposure and their ratio at several sets of keys in one pass; NULL rate without exposure."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    out = cells.groupingSets(levels, *keys).agg(F.grouping_id().alias("grouping"), F.sum(events).alias(events), F.sum(exposure).alias(exposure))
    return out.withColumn("rate", ratio(events, exposure))


def credibility(cells: DataFrame, group: str, events: str, exposure: str) -> DataFrame:
    """Buhlmann-Straub over groups with Poisson counts: ``group, rate, weight, credible_rate``.

    Expected process variance is the overall rate; the variance between groups is what their rates spread beyond it,
    not below zero (then all weight goes to the overall rate).
    """
    g = cells.groupBy(group).agg(F.sum(events).alias("d"), F.sum(exposure).alias("e")).where(F.col("e") > 0)
    t = g.agg(F.sum("d").alias("D"), F.sum("e").alias("E"), F.sum(F.col("e") * F.col("e")).alias("EE"), F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d") / F.col("e")).alias("dd"))
    mu = F.col("D") / F.col("E")
    between = (F.col("dd") - F.col("D") * mu - (F.col("n") - 1) * mu) / F.nullif(F.col("E") - F.col("EE") / F.col("E"), F.lit(0.0))
    t = t.select(mu.alias("mu"), F.greatest(F.coalesce(between, F.lit(0.0)), F.lit(0.0)).alias("vhm"))
    z = F.when(F.col("vhm") > 0, F.col("e") / (F.col("e") + F.col("mu") / F.col("vhm"))).otherwise(0.0)
    return g.crossJoin(F.broadcast(t)).select(group, (F.col("d") / F.col("e")).alias("rate"), z.alias("weight"), (z * F.col("d") / F.col("e") + (1 - z) * F.col("mu")).alias("credible_rate"))


def deviations(cells: DataFrame, county: str, state: str, events: str, exposure: str, k: float) -> DataFrame:
    """County rates as state rate times a deviation drawn to 1 by expected events: ``county, state, deviation, rate``."""
    c = cells.groupBy(state, county).agg(F.sum(events).alias("d"), F.sum(exposure).alias("e"))
    s = cells.groupBy(state).agg((F.sum(events) / F.nullif(F.sum(exposure), F.lit(0))).alias("base"))
    j = c.join(s, state).withColumn("expected", F.col("e") * F.col("base"))
    dev = (F.col("d") + k) / (F.col("expected") + k)
    return j.select(county, state, dev.alias("deviation"), (F.col("base") * dev).alias("rate"))


def blend(a: Column, var_a: Column, b: Column, var_b: Column) -> Column:
    """Two positive levels combined on the log scale with inverse variances; one alone where the other is missing."""
    wa, wb = 1 / var_a, 1 / var_b
    both = F.exp((wa * F.log(a) + wb * F.log(b)) / (wa + wb))
    return F.coalesce(F.when((a > 0) & (b > 0), both), a, b)


def year_effects(cells: DataFrame, cell: list[str], year: str, events: str, exposure: str) -> DataFrame:
    """Log rates less their cell's event-weighted mean, pooled per year with events as weights: ``year, effect``."""
    y = cells.groupBy(*cell, year).agg(F.sum(events).alias("d"), F.sum(exposure).alias("e")).where((F.col("d") > 0) & (F.col("e") > 0))
    y = y.withColumn("l", F.log(F.col("d") / F.col("e")))
    mean = F.sum(F.col("d") * F.col("l")).over(W.partitionBy(*cell)) / F.sum("d").over(W.partitionBy(*cell))
    return y.withColumn("x", F.col("l") - mean).groupBy(year).agg((F.sum(F.col("d") * F.col("x")) / F.sum("d")).alias("effect"))


def stratified_trend(cells: DataFrame, cell: list[str], year: str, events: str, exposure: str) -> DataFrame:
    """Weighted median over cells of their log-rate slopes per year, weights being events: one row ``trend``."""
    y = cells.where((F.col(events) > 0) & (F.col(exposure) > 0))
    lines = weighted_line(y, cell, F.col(year), F.log(F.col(events) / F.col(exposure)), F.col(events))
    n = y.groupBy(*cell).agg(F.sum(events).cast("double").alias("w"))
    return weighted_median(lines.join(n, cell), [], "slope", "w").withColumnRenamed("weighted_median", "trend")


def loading_posterior(observed: DataFrame, unit: str, lift: str, variance: str, shock: float, grid: list[float]) -> DataFrame:
    """Posterior mean of each unit's loading on a shock, over a grid with a flat prior: ``unit, loading``. Lifts are 1 + L (m - 1) with normal errors."""
    g = observed.sparkSession.createDataFrame([(x,) for x in grid], "l double")
    miss = F.col(lift) - (1 + F.col("l") * (shock - 1))
    fit = observed.crossJoin(F.broadcast(g)).groupBy(unit, "l").agg(F.sum(-miss * miss / (2 * F.col(variance))).alias("f"))
    top = fit.withColumn("w", F.exp(F.col("f") - F.max("f").over(W.partitionBy(unit))))
    return top.groupBy(unit).agg((F.sum(F.col("w") * F.col("l")) / F.sum("w")).alias("loading"))


def propagated_interval(rate: Column, log_variance: Column, z: float = 1.645) -> tuple[Column, Column]:
    """Limits of a rate from the variance of its logarithm."""
    half = z * F.sqrt(log_variance)
    return rate * F.exp(-half), rate * F.exp(half)


def relative_factor(value: Column, target: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """The factor that brings a value to a target, kept within limits; 1 where it is undefined."""
    return F.coalesce(clip(ratio(target, value), low, high), F.lit(1.0))
