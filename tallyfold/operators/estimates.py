"""Estimates from linked registers and cubes: error rates, ratios, churn, fertility, least squares, bands and ages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.functions.scalars import clip, ratio


def birth_error(pairs: DataFrame, band: str, moved: Column, least: int = 50) -> DataFrame:
    """Share of linked pairs whose birth was moved, by band: ``band, pairs, moved, rate``; bands with fewer than ``least`` pairs
    take the rate of all bands together. No pairs give no rows; a NULL comparison counts as not moved."""
    m = F.coalesce(moved.cast("int"), F.lit(0))
    by = pairs.groupBy(band).agg(F.count(F.lit(1)).alias("pairs"), F.sum(m).alias("moved"))
    whole = W.partitionBy(F.lit(0))  # one row per band
    pooled = F.sum("moved").over(whole) / F.sum("pairs").over(whole)
    return by.withColumn("rate", F.when(F.col("pairs") >= least, F.col("moved") / F.col("pairs")).otherwise(pooled))


def churn(cells: DataFrame, unit: str, at_risk: str, residual: str, mobility: str, error: str) -> DataFrame:
    """False disappearances fitted by two shapes: ``unit, raw, weight, kappa, mix_mobility, mix_error``.

    ``cells`` has, per unit and group, those at risk, the disappearance rate beyond mortality, and the two shapes
    (mobility, birth error). Two coefficients not below zero fit the national residual by least squares with those at
    risk as weights; the mixed shape is scaled to mean 1, each unit gets its own factor, and factors are drawn to the
    national one by credibility (between-unit variance by moments). Sums only; one row reaches every unit.
    """
    n, r, a, b = (F.col(c).cast("double") for c in (at_risk, residual, mobility, error))
    sums = cells.agg(F.sum(n * a * a).alias("aa"), F.sum(n * a * b).alias("ab"), F.sum(n * b * b).alias("bb"), F.sum(n * a * r).alias("ar"), F.sum(n * b * r).alias("br"), F.sum(n).alias("n"), F.sum(n * a).alias("na"), F.sum(n * b).alias("nb"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    x = ratio(F.col("ar") * F.col("bb") - F.col("br") * F.col("ab"), det)
    y = ratio(F.col("br") * F.col("aa") - F.col("ar") * F.col("ab"), det)
    alone_a, alone_b = F.greatest(ratio("ar", "aa", 0.0), F.lit(0.0)), F.greatest(ratio("br", "bb", 0.0), F.lit(0.0))
    # where the free solution leaves the quadrant, the better of the two edges
    both = (x >= 0) & (y >= 0)
    edge_a = F.coalesce(alone_a * F.col("ar") >= alone_b * F.col("br"), F.lit(True))
    mixed = sums.select(
        F.when(both, x).when(edge_a, alone_a).otherwise(0.0).alias("mix_mobility"), F.when(both, y).when(edge_a, 0.0).otherwise(alone_b).alias("mix_error"), "n", "na", "nb",
    )
    mixed = mixed.withColumn("__mean", (F.col("mix_mobility") * F.col("na") + F.col("mix_error") * F.col("nb")) / F.nullif(F.col("n"), F.lit(0.0))).drop("n", "na", "nb")
    shape = ratio(F.col("mix_mobility") * a + F.col("mix_error") * b, F.col("__mean"), 1.0)
    shaped = cells.crossJoin(F.broadcast(mixed)).withColumn("__q", shape)
    per = shaped.groupBy(unit, "mix_mobility", "mix_error").agg(F.sum(n * r * F.col("__q")).alias("d"), F.sum(n * F.col("__q") * F.col("__q")).alias("e")).where("e > 0")
    t = per.agg(F.sum("d").alias("D"), F.sum("e").alias("E"), F.sum(F.col("e") * F.col("e")).alias("EE"), F.sum(F.col("d") * F.col("d") / F.col("e")).alias("dd"), F.count(F.lit(1)).alias("m"))
    mu = F.col("D") / F.col("E")
    between = ratio(F.col("dd") - F.col("D") * mu - (F.col("m") - 1) * mu, F.col("E") - F.col("EE") / F.col("E"), 0.0)
    t = t.select(mu.alias("mu"), F.greatest(F.coalesce(between, F.lit(0.0)), F.lit(0.0)).alias("v"))
    z = F.when(F.col("v") > 0, F.col("e") / (F.col("e") + F.col("mu") / F.col("v"))).otherwise(0.0)
    raw = F.col("d") / F.col("e")
    return per.crossJoin(F.broadcast(t)).select(unit, raw.alias("raw"), z.alias("weight"), F.greatest(z * raw + (1 - z) * F.col("mu"), F.lit(0.0)).alias("kappa"), "mix_mobility", "mix_error")


def source_ratios(observed: DataFrame, expected: DataFrame, keys: list[str], value: str, n: str, least: int = 30, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """How far one source stands from another per group: ``*keys, ratio``, kept within limits; 1 where either has fewer than ``least``."""
    both = observed.select(*keys, F.col(value).alias("__a"), F.col(n).alias("__n")).join(expected.select(*keys, F.col(value).alias("__b"), F.col(n).alias("__m")), keys)
    usable = (F.col("__n") >= least) & (F.col("__m") >= least) & (F.col("__b") > 0)
    return both.select(*keys, F.when(usable, clip(F.col("__a") / F.col("__b"), low, high)).otherwise(1.0).alias("ratio"))


def log_exponent(rows: DataFrame, x: Column, y: Column, low: float = 0.0, high: float = 1.5) -> DataFrame:
    """The exponent k of y = x ** k by least squares of the logarithms through the origin, kept within limits: one row ``exponent``."""
    known = (x > 0) & (y > 0)
    lx, ly = F.log(F.when(known, x)), F.log(F.when(known, y))
    s = rows.agg(F.sum(lx * ly).alias("xy"), F.sum(lx * lx).alias("xx"))
    return s.select(clip(F.coalesce(ratio("xy", "xx"), F.lit(1.0)), low, high).alias("exponent"))


def inclusion(cells: DataFrame, by: list[str], seen: str, expected: str, k: float = 25.0) -> DataFrame:
    """Share of the expected that a source holds, per group, drawn to the share of all by expected / (expected + k): ``*by, inclusion``; at most 1."""
    g = cells.groupBy(*by).agg(F.sum(seen).alias("__s"), F.sum(expected).alias("__e"))
    whole = cells.agg((F.sum(seen) / F.nullif(F.sum(expected), F.lit(0))).alias("__p"))
    z = F.col("__e") / (F.col("__e") + k)
    return g.crossJoin(F.broadcast(whole)).select(*by, F.least(F.lit(1.0), z * ratio("__s", "__e", 0.0) + (1 - z) * F.col("__p")).alias("inclusion"))


def fertility(cube: DataFrame, by: list[str], age: str, sex: str, n: str, female: int = 1, mothers: tuple[int, int] = (18, 45)) -> DataFrame:
    """Infants per woman of childbearing age: ``*by, infants, women, fertility``."""
    s = cube.groupBy(*by).agg(F.sum(F.when(F.col(age) == 0, F.col(n)).otherwise(0)).alias("infants"), F.sum(F.when((F.col(sex) == female) & F.col(age).between(*mothers), F.col(n)).otherwise(0)).alias("women"))
    return s.withColumn("fertility", ratio("infants", "women"))


def least_squares(rows: DataFrame, x: list[str], y: str, weight: str | None = None) -> dict[str, float]:
    """Coefficients of a weighted linear fit with an intercept, and ``r2``: normal equations by one aggregate, solved on the driver
    (a matrix of as many rows as there are columns). Rows with a NULL in any column are left out; collinear columns share by least norm."""
    names = ["intercept", *x]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.dropna(subset=[*x, y, *([weight] if weight else [])])
    t = F.col(y).cast("double")
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    r = known.agg(*sums, *[F.sum(w * c * t).alias(f"b{i}") for i, c in enumerate(cols)], F.sum(w * t * t).alias("tt")).first()
    if r["a0_0"] is None:
        return {**dict.fromkeys(names, 0.0), "r2": 0.0}
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    b = np.array([r[f"b{i}"] for i in range(len(cols))])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    total = r["tt"] - b[0] ** 2 / a[0, 0]
    left = r["tt"] - 2 * beta @ b + beta @ a @ beta
    return {**dict(zip(names, map(float, beta), strict=True)), "r2": float(1 - left / total) if total > 0 else 0.0}


def incremental_r2(rows: DataFrame, base: list[str], more: list[str], y: str) -> float:
    """How much further columns explain beyond the base ones."""
    return max(0.0, least_squares(rows, [*base, *more], y)["r2"] - least_squares(rows, base, y)["r2"])


def ages_of_bands(bands, last: int = 110) -> list[tuple[int, str]]:
    return [(a, b) for b, lo, hi in bands for a in range(lo, min(hi, last) + 1)]


def bands_to_ages(rates: DataFrame, band: str, value: str, ages: DataFrame, keys: list[str]) -> DataFrame:
    """Rates by band spread over the single ages of each band: ``*keys, age, value``. ``ages`` (age, band) is a list of ages."""
    return rates.join(F.broadcast(ages), band).select(*keys, "age", value)


def ages_to_bands(cube: DataFrame, ages: DataFrame, keys: list[str], n: str, events: str) -> DataFrame:
    """Counts and events by age gathered into bands, with their rate: ``*keys, band, n, events, rate``."""
    out = cube.join(F.broadcast(ages), "age").groupBy(*keys, "band").agg(F.sum(n).alias(n), F.sum(events).alias(events))
    return out.withColumn("rate", ratio(events, n))


def rake_to_shares(draws: DataFrame, groups: list[str], unit: str, value: str, shares: DataFrame, share: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Simulated values scaled so that the units' mean shares of a group meet given ones: ``draws`` with ``raked``.

    One factor per group and unit, from the mean over draws, kept within limits, so that every draw moves alike. Units
    without a given share stay as they are.
    """
    mean = draws.groupBy(*groups, unit).agg(F.avg(value).alias("__m"))
    total = F.sum("__m").over(W.partitionBy(*groups))
    factor = mean.withColumn("__now", F.col("__m") / F.nullif(total, F.lit(0.0))).join(shares.select(*groups, unit, F.col(share).alias("__s")), [*groups, unit], "left")
    factor = factor.select(*groups, unit, F.coalesce(clip(ratio("__s", "__now"), low, high), F.lit(1.0)).alias("__f"))
    return draws.join(factor, [*groups, unit]).withColumn("raked", F.col(value) * F.col("__f")).drop("__f")


def tertiary_share(cube: DataFrame, by: list[str], age: str, education: str, n: str, survival: DataFrame, years: int, adult: int = 25, tertiary: int = 3) -> DataFrame:
    """Share with tertiary education among those who will be ``adult`` or older in ``years``, each weighted by the chance to live
    until then: ``*by, share``. ``survival`` has age and p, the chance to live from that age on for the years asked."""
    alive = cube.where((F.col(age) >= adult - years) & F.col(education).isNotNull()).join(F.broadcast(survival.select(F.col("age").alias(age), "p")), age)
    w = F.col(n) * F.col("p")
    return alive.groupBy(*by).agg((F.sum(F.when(F.col(education) >= tertiary, w).otherwise(0.0)) / F.nullif(F.sum(w), F.lit(0.0))).alias("share"))


def rate_violations(rows: DataFrame, group: list[str], level: str, fine: str, broad: str, exposure: str, rate: str, tolerance: float = 1e-6) -> DataFrame:
    """Groups in which the events (rate times exposure) or the exposure of the fine level don't add up to the broad one's: ``*group, gap_exposure, gap_events``."""
    part = lambda which, v: F.sum(F.when(F.col(level) == which, v))
    ev = F.col(exposure) * F.col(rate)
    s = rows.groupBy(*group).agg(part(fine, F.col(exposure)).alias("a"), part(broad, F.col(exposure)).alias("b"), part(fine, ev).alias("c"), part(broad, ev).alias("d"))
    gaps = s.select(*group, F.abs(F.col("a") - F.col("b")).alias("gap_exposure"), F.abs(F.col("c") - F.col("d")).alias("gap_events"), "b", "d")
    off = lambda gap, of: F.coalesce(F.col(gap) > tolerance * F.greatest(F.abs(F.col(of)), F.lit(1.0)), F.lit(True))
    return gaps.where(off("gap_exposure", "b") | off("gap_events", "d")).drop("b", "d")


def rate_scores(submitted: DataFrame, truth: DataFrame, keys: list[str], floor: float, z: float = 0.1) -> DataFrame:
    """Scores of rates with intervals on the cells whose true exposure reaches ``floor``, chosen before anything submitted is read:
    one row ``cells, missing, relative_error, interval_score``.

    ``submitted`` has estimate, low, high; ``truth`` exposure and rate. A cell without a row counts as missing and with
    the full error 1. The interval score adds ``2 / z`` times the miss to the width, over the true rate.
    """
    t = truth.where((F.col("exposure") >= floor) & (F.col("rate") > 0)).join(submitted.select(*keys, "estimate", "low", "high"), keys, "left")
    miss = F.greatest(F.col("low") - F.col("rate"), F.lit(0.0)) + F.greatest(F.col("rate") - F.col("high"), F.lit(0.0))
    score = (F.col("high") - F.col("low") + 2 / z * miss) / F.col("rate")
    return t.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("estimate").isNull()).alias("missing"),
        F.avg(F.coalesce(F.abs(F.col("estimate") - F.col("rate")) / F.col("rate"), F.lit(1.0))).alias("relative_error"), F.avg(score).alias("interval_score"),
    )


def separation(failures: DataFrame, control: str, gate: str, world: str, failed: str) -> DataFrame:
    """Which gates catch which control: per control and gate the worlds and those failed, and ``separates`` where all fail: one aggregate."""
    s = failures.groupBy(control, gate).agg(F.count_distinct(world).alias("worlds"), F.count_distinct(F.when(F.col(failed), F.col(world))).alias("failed_worlds"))
    return s.withColumn("separates", F.col("failed_worlds") == F.col("worlds"))


def level_gap(rows: DataFrame, region: str, a: str, b: str, weight: str) -> DataFrame:
    """Disagreement of two level estimates: per region the log gap of the weighted sums, with the national one in quadrature:
    ``region, gap``; NULL where a sum is zero."""
    gap = F.log(ratio(F.sum(F.col(a) * F.col(weight)), F.sum(F.col(b) * F.col(weight))))
    r, whole = rows.groupBy(region).agg(gap.alias("__g")), rows.agg(gap.alias("__n"))
    return r.crossJoin(F.broadcast(whole)).select(region, F.sqrt(F.col("__g") * F.col("__g") + F.col("__n") * F.col("__n")).alias("gap"))
