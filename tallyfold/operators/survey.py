"""Survey weights, calibration, imputation, variance, resampling and reconciliation with benchmarks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.functions.scalars import clip, ratio, uniform
from tallyfold.session import cut, sent_by_value, stored

sent_by_value(__name__)


def pps_sample(cells: DataFrame, strata: list[str], cell: str, size: str, m: int, seed: int) -> DataFrame:
    """``m`` cells per stratum without replacement, in proportion to size (exponential priorities), with
    ``first_stage`` = min(1, m size / total). Cells without size are never drawn."""
    rows = cells.where(F.col(size) > 0)
    priority = -F.log(uniform(seed, *strata, cell)) / F.col(size)
    part = W.partitionBy(*strata)
    rows = rows.withColumns({"__place": F.row_number().over(part.orderBy(priority, cell)), "__all": F.sum(size).over(part)})
    return rows.where(F.col("__place") <= m).withColumn("first_stage", F.least(F.lit(1.0), m * F.col(size) / F.col("__all"))).drop("__place", "__all")


def nonresponse_factor(rows: DataFrame, psu: list[str], household: str, sampled: Column) -> DataFrame:
    """Per PSU sampled over responding households, at least 1, and 1 where none responded: ``*psu, factor``."""
    n = rows.groupBy(*psu).agg(F.count_distinct(household).alias("__n"), F.max(sampled).alias("__s"))
    return n.select(*psu, F.greatest(F.lit(1.0), ratio("__s", "__n")).alias("factor"))


def response_weights(psus: DataFrame, by: list[str], covariate: str, responding: str, sampled: str, weight: str) -> DataFrame:
    """Weights over response propensities: a weighted line of the PSUs' logit response rates on a covariate; weights are
    rescaled within ``by`` to their former total."""
    from tallyfold.operators.aggregates import weighted_line

    rate = clip((F.col(responding) + 0.5) / (F.col(sampled) + 1), 0.02, 0.98)
    line = weighted_line(psus, [], F.col(covariate), F.log(rate / (1 - rate)), F.col(sampled))
    fitted = psus.crossJoin(F.broadcast(line)).withColumn("__p", 1 / (1 + F.exp(-(F.col("intercept") + F.coalesce("slope", F.lit(0.0)) * F.col(covariate)))))
    raised = fitted.withColumn("__w", F.col(weight) / F.col("__p"))
    scale = F.sum(weight).over(W.partitionBy(*by)) / F.sum("__w").over(W.partitionBy(*by))
    return raised.withColumn("response_weight", F.col("__w") * scale).drop("__w", "__p", "slope", "intercept")


#: Cells of the margins together up to which they are fitted on the driver; more are fitted by joins.
CELLS_ON_DRIVER = 50_000


def _rake_small(cells: DataFrame, margins: list, sweeps: int, low: float, high: float) -> DataFrame:
    """Fit at most ``CELLS_ON_DRIVER`` cell totals in memory."""
    rows = cells.collect()
    w = np.array([r["__w"] or 0.0 for r in rows])
    whole = w.sum()
    fits = []
    for on, targets, target in margins:
        goal = {tuple(r[k] for k in on): r[target] for r in targets.select(*on, target).collect() if (r[target] or 0) > 0}
        at = {x: i for i, x in enumerate(goal)}
        fits.append((np.array([-1 if None in (x := tuple(r[k] for k in on)) else at.get(x, -1) for r in rows], int), np.array(list(goal.values()), float)))
    for _ in range(sweeps):
        for group, goal in fits:
            inside = group >= 0
            now = np.bincount(group[inside], w[inside], len(goal))
            factor = np.where(now > 0, np.clip(np.divide(goal, now, out=np.ones_like(goal), where=now > 0), low, high), 1.0)
            w[inside] *= factor[group[inside]]
        w *= whole / w.sum() if w.sum() else 1.0
    return cells.sparkSession.createDataFrame([(*r[:-1], float(x)) for r, x in zip(rows, w, strict=True)], cells.schema)


def _rake_large(cells: DataFrame, margins: list, sweeps: int, low: float, high: float) -> DataFrame:
    """Fit any number of cell totals: each margin is an aggregation and a join, lineage is cut every sweep."""
    whole = cells.agg(F.sum("__base").alias("t")).first()["t"] or 0.0
    for _ in range(sweeps):
        for on, targets, target in margins:
            now = cells.groupBy(*on).agg(F.sum("__w").alias("__now"))
            factor = now.join(targets.select(*on, F.col(target).alias("__t")), on).where((F.col("__t") > 0) & (F.col("__now") > 0))
            factor = factor.select(*on, clip(F.col("__t") / F.col("__now"), low, high).alias("__f"))
            cells = cells.join(factor, on, "left").withColumn("__w", F.col("__w") * F.coalesce("__f", F.lit(1.0))).drop("__f")
        total = cells.agg(F.sum("__w").alias("__s"))
        cells = cut(cells.crossJoin(F.broadcast(total)).withColumn("__w", F.col("__w") * F.lit(float(whole)) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__s"))
    return cells


def rake(rows: DataFrame, weight: str, margins: list[tuple[list[str], DataFrame, str]], sweeps: int = 12, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """``rows`` with ``raked``, the weight calibrated to margins (keys, targets, target column) by proportional fitting.

    All rows of a cell (the keys of all margins together) get the same factor, so only cell totals are iterated, in a
    fixed number of sweeps: each margin scales its cells by target over current total, the factor clipped; margins
    without a positive target, and cells with a NULL key of the margin, are left alone. The total is restored after each sweep.
    """
    keys = list(dict.fromkeys(k for m in margins for k in m[0]))
    cells = rows.groupBy(*keys).agg(F.sum(weight).cast("double").alias("__base"))
    cells = stored(cells.withColumn("__w", F.col("__base")), "cells")
    few = cells.limit(CELLS_ON_DRIVER + 1).count() <= CELLS_ON_DRIVER
    cells = _rake_small(cells, margins, sweeps, low, high) if few else _rake_large(cells, margins, sweeps, low, high)
    factors = cells.withColumns({f"__k_{k}": F.col(k) for k in keys}).select(*[f"__k_{k}" for k in keys], (F.col("__w") / F.nullif(F.col("__base"), F.lit(0.0))).alias("__f"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return rows.join(factors, match, "left").withColumn("raked", F.col(weight) * F.col("__f")).drop("__f", *[f"__k_{k}" for k in keys])


def hot_deck(rows: DataFrame, value: str, ladders: list[list[str]], name: str = "imputed") -> DataFrame:
    """``rows`` with missing values filled by the median of donors over the first set of keys that has any."""
    out = rows
    for i, keys in enumerate(ladders):
        donors = rows.where(F.col(value).isNotNull())
        if not keys:
            out = out.crossJoin(F.broadcast(donors.agg(F.median(value).alias(f"__m{i}"))))
        else:
            out = out.join(donors.groupBy(*keys).agg(F.median(value).alias(f"__m{i}")), keys, "left")
    return out.withColumn(name, F.coalesce(value, *[f"__m{i}" for i in range(len(ladders))])).drop(*[f"__m{i}" for i in range(len(ladders))])


def design_variance(rows: DataFrame, domain: list[str], stratum: list[str], psu: str, psus: DataFrame, value: Column, weight: str) -> DataFrame:
    """Weighted total per domain and its between-PSU variance n/(n-1)(sum x^2 - (sum x)^2/n) over strata, PSUs without
    rows of the domain counting as zero; at least the total itself (Poisson): ``*domain, total, variance``."""
    n = psus.select(*stratum, psu).distinct().groupBy(*stratum).agg(F.count(F.lit(1)).alias("__n"))
    x = rows.groupBy(*domain, *[s for s in stratum if s not in domain], psu).agg(F.sum(value * F.col(weight)).alias("__x"))
    keys = list(dict.fromkeys([*domain, *stratum]))
    s = x.groupBy(*keys).agg(F.sum("__x").alias("__s"), F.sum(F.col("__x") * F.col("__x")).alias("__q")).join(n, stratum)
    spread = F.when(F.col("__n") > 1, F.col("__n") / (F.col("__n") - 1) * (F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n"))).otherwise(0.0)
    return s.groupBy(*domain).agg(F.sum("__s").alias("total"), F.sum(spread).alias("__v")).select(*domain, "total", F.greatest("__v", F.abs("total")).alias("variance"))


def jackknife_mean(rows: DataFrame, by: list[str], psu: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per group and its delete-one-PSU variance, from PSU sums: ``*by, mean, variance``."""
    p = rows.where(F.col(value).isNotNull()).groupBy(*by, psu).agg(F.sum(F.col(value) * F.col(weight)).alias("__x"), F.sum(weight).alias("__w"))
    part = W.partitionBy(*by)
    p = p.withColumns({"__sum_x": F.sum("__x").over(part), "__sum_w": F.sum("__w").over(part), "__n": F.count(F.lit(1)).over(part)})
    p = p.withColumn("__d", (F.col("__sum_x") - F.col("__x")) / F.nullif(F.col("__sum_w") - F.col("__w"), F.lit(0.0)) - F.col("__sum_x") / F.col("__sum_w"))
    return p.groupBy(*by).agg((F.max("__sum_x") / F.max("__sum_w")).alias("mean"), ((F.max("__n") - 1) / F.max("__n") * F.sum(F.col("__d") * F.col("__d"))).alias("variance"))


def rescaled_bootstrap(psus: DataFrame, stratum: list[str], psu: str, draws: int, seed: int) -> DataFrame:
    """Rao-Wu factors ``draw, *stratum, psu, factor``: m - 1 of the m PSUs of a stratum drawn with replacement, factor
    k m / (m - 1). Draw j of a stratum picks PSU number floor(m u_j), keyed; PSUs never drawn have factor 0."""
    numbered = psus.select(*stratum, psu).distinct().withColumn("__i", F.row_number().over(W.partitionBy(*stratum).orderBy(psu)) - 1)
    m = numbered.groupBy(*stratum).agg(F.count(F.lit(1)).alias("__m"))
    drawn = m.where(F.col("__m") > 1).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m") - 1)))
    hits = drawn.groupBy("draw", *stratum, F.floor(F.col("__m") * uniform(seed, "draw", *stratum, "__j")).alias("__i")).agg(F.count(F.lit(1)).alias("__k"))
    every = numbered.join(m, stratum).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    out = every.join(hits, ["draw", *stratum, "__i"], "left")
    return out.select("draw", *stratum, psu, F.when(F.col("__m") > 1, F.coalesce("__k", F.lit(0)) * F.col("__m") / (F.col("__m") - 1)).otherwise(1.0).alias("factor"))


def poisson_redraws(cells: DataFrame, key: str, mean: str, draws: int, seed: int) -> DataFrame:
    """``key, draw, n``: Poisson counts around the cell means, each drawn by its key and number alone."""
    kind = cells.schema[key].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, m in zip(b["key"], b["mean"], strict=True):
                rng = np.random.default_rng([seed, int(k) & (2**63 - 1)])
                yield pd.DataFrame({"key": [k] * draws, "draw": np.arange(1, draws + 1, dtype=np.int32), "n": rng.poisson(max(float(m), 0.0), draws)})

    rows = cells.select(F.col(key).alias("key"), F.coalesce(F.col(mean).cast("double"), F.lit(0.0)).alias("mean")).where(F.col("key").isNotNull())
    return rows.mapInPandas(draw, f"key {kind}, draw int, n bigint").withColumnRenamed("key", key)


def shrink(estimate: Column, n: Column, toward: Column, k: float) -> Column:
    """An estimate drawn to another by n / (n + k); the other alone where the first is missing."""
    z = n / (n + k)
    return F.when(estimate.isNull() | (n <= 0), toward).otherwise(z * estimate + (1 - z) * toward)


def reconcile(estimates: DataFrame, by: list[str], value: str, variance: str, targets: DataFrame, target: str) -> DataFrame:
    """``estimates`` with ``reconciled``: per group the gap to the target is shared out in proportion to variances."""
    part = W.partitionBy(*by)
    rows = estimates.join(targets.select(*by, F.col(target).alias("__t")), by, "left")
    gap = F.coalesce(F.col("__t") - F.sum(value).over(part), F.lit(0.0))
    share = ratio(F.col(variance), F.sum(variance).over(part), 0.0)
    return rows.withColumn("reconciled", F.col(value) + gap * share).drop("__t")


def additive(rows: DataFrame, child: str, parent: str, key: str, values: list[str], level: str = "level") -> DataFrame:
    """Rows of the ``parent`` level (whose unit is ``key`` of the child rows) replaced by sums over the ``child`` level."""
    sums = rows.where(F.col(level) == child).groupBy(F.col(key).alias("unit")).agg(*[F.sum(v).alias(v) for v in values]).withColumn(level, F.lit(parent))
    others = rows.where(F.col(level) != parent)
    return others.unionByName(sums, allowMissingColumns=True)


def heaping(rows: DataFrame, by: list[str], age: str, n: str, least: int = 200) -> DataFrame:
    """How much of the reported ages sits on multiples of five: ``*by, excess``.

    The mass at 25, 30, .. 90 beyond the five-point moving mean there, over the mass from 22 to 93, between 0 and 0.6; 0
    for fewer than ``least`` persons aged 20 to 95. Every age from 23 to 92 stands in the window of just one multiple
    of five, so the moving means add up to a fifth of that mass and one aggregate suffices.
    """
    mass = lambda lo, hi, more=None: F.sum(F.when(F.col(age).between(lo, hi) & (F.lit(True) if more is None else more), F.col(n)).otherwise(0)).cast("double")
    s = rows.groupBy(*by).agg(mass(25, 90, F.col(age) % 5 == 0).alias("__f"), mass(23, 92).alias("__w"), mass(22, 93).alias("__t"), mass(20, 95).alias("__all"))
    usable = (F.col("__all") >= least) & (F.col("__w") > 0)
    return s.select(*by, F.when(usable, clip((F.col("__f") - F.col("__w") / 5) / F.col("__t"), 0.0, 0.6)).otherwise(0.0).alias("excess"))


def deheap(rows: DataFrame, by: list[str], age: str, n: str, last: int = 110) -> DataFrame:
    """Counts by age with the excess share of the mass at multiples of five from 25 on given back to the two ages on either side,
    in proportion to what these hold, in equal parts where they hold nothing (``smoothed``). ``rows`` has every age, with zeros."""
    five = F.floor((F.col(age) + 2) / 5) * 5
    part = W.partitionBy(*by, "__m")
    at = F.col(age) == F.col("__m")
    out = rows.join(heaping(rows, by, age, n), by).withColumn("__m", five)
    out = out.withColumns({"__c": F.sum(F.when(at, F.col(n)).otherwise(0)).over(part) * F.col("excess"), "__s": F.sum(F.when(at, 0).otherwise(F.col(n))).over(part)})
    moved = F.when(at, -F.col("__c")).otherwise(F.col("__c") * F.when(F.col("__s") > 0, F.col(n) / F.col("__s")).otherwise(0.25))
    inside = F.col("__m").between(25, last - 2)
    return out.withColumn("smoothed", F.greatest(F.col(n) + F.when(inside, moved).otherwise(0.0), F.lit(0.0))).drop("__m", "__c", "__s", "excess")


def gompertz_grid(rows: DataFrame, by: list[str], age: str, deaths: str, exposure: str, a: list[float], b: list[float]) -> DataFrame:
    """The grid point (log level, slope) with the largest Poisson likelihood of deaths: ``*by, a, b, fit``. Ages are aggregated first."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a for y in b], "a double, b double")
    cells = rows.groupBy(*by, age).agg(F.sum(deaths).alias("__d"), F.sum(exposure).alias("__e")).where(F.col("__e") > 0)
    line = F.col("a") + F.col("b") * F.col(age)
    fits = cells.crossJoin(F.broadcast(grid)).groupBy(*by, "a", "b").agg(F.sum(F.col("__d") * line - F.col("__e") * F.exp(line)).alias("fit"))
    return fits.groupBy(*by).agg(F.max(F.struct("fit", "a", "b")).alias("z")).select(*by, "z.a", "z.b", "z.fit")


def posterior_grid(fits: DataFrame, by: list[str], fit: str = "fit") -> DataFrame:
    """Grid points with ``weight``, the softmax of their log likelihoods."""
    part = W.partitionBy(*by)
    top = fits.withColumn("__w", F.exp(F.col(fit) - F.max(fit).over(part)))
    return top.withColumn("weight", F.col("__w") / F.sum("__w").over(part)).drop("__w")


def interval_rows(draws: DataFrame, keys: list[str], value: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """``*keys, estimate, low, high``: mean of draws, plus or minus half the width from the 5th to the 95th percentile, kept in range."""
    s = draws.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.percentile(value, F.lit(0.05)).alias("__lo"), F.percentile(value, F.lit(0.95)).alias("__hi"))
    half = (F.col("__hi") - F.col("__lo")) / 2
    lo, hi = F.col("estimate") - half, F.col("estimate") + half
    lo = F.greatest(lo, F.lit(lower)) if lower is not None else lo
    hi = F.least(hi, F.lit(upper)) if upper is not None else hi
    return s.select(*keys, "estimate", lo.alias("low"), hi.alias("high"))
