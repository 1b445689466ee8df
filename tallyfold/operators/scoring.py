"""Checks and scores of published tables against truth: schema, additivity, accuracy, intervals, gates, disclosure."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.aggregates import order_statistic
from tallyfold.session import sent_by_value

sent_by_value(__name__)

KEYS = ["estimand", "level", "unit"]


def scaled_error(kind: Column, estimate: Column, truth: Column) -> Column:
    """Absolute for proportions, else relative to the truth, at least to 1."""
    return F.when(kind == "proportion", F.abs(estimate - truth)).otherwise(F.abs(estimate - truth) / F.greatest(F.abs(truth), F.lit(1.0)))


def interval_score(low: Column, high: Column, truth: Column, alpha: float = 0.1) -> Column:
    """Width plus 2 / alpha times the distance by which the truth lies outside."""
    return high - low + F.lit(2 / alpha) * (F.greatest(low - truth, F.lit(0.0)) + F.greatest(truth - high, F.lit(0.0)))


def release_violations(release: DataFrame, required: DataFrame) -> DataFrame:
    """Broken rules of a release with their keys: duplicate, missing, unexpected, not finite, low above high, estimate outside,
    negative, above one."""
    say = lambda df, rule: df.select(*KEYS, F.lit(rule).alias("rule"))
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("estimate", "low", "high")])
    kinds = required.select(*KEYS, "kind")
    known = release.join(kinds, KEYS)
    parts = [
        say(release.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate"),
        say(required.join(release.select(*KEYS), KEYS, "left_anti"), "missing"), say(release.join(kinds, KEYS, "left_anti"), "unexpected"),
        say(known.where(~finite), "not finite"), say(known.where(finite & (F.col("low") > F.col("high"))), "low above high"),
        say(known.where(finite & ~F.col("estimate").between(F.col("low"), F.col("high"))), "estimate outside"),
        say(known.where(finite & (F.col("low") < 0)), "negative"), say(known.where(finite & (F.col("kind") == "proportion") & (F.col("high") > 1)), "above one"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def additivity_violations(release: DataFrame, parents: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Parents whose estimate is not the sum of their children's: ``parents`` has level, unit, parent_level, parent_unit."""
    sums = release.join(parents, ["level", "unit"]).groupBy("estimand", F.col("parent_level").alias("level"), F.col("parent_unit").alias("unit")).agg(F.sum("estimate").alias("__sum"))
    both = release.join(sums, KEYS)
    return both.where(F.abs(F.col("estimate") - F.col("__sum")) > tolerance * F.greatest(F.abs("estimate"), F.lit(1.0))).select(*KEYS, "estimate", F.col("__sum").alias("summed"))


def score_release(release: DataFrame, truth: DataFrame) -> DataFrame:
    """Per estimand and level, and per estimand over all levels (level NULL): worst, 95th, mean error, coverage, mean
    interval score, n. ``truth`` has kind and value; units whose truth is undefined are skipped."""
    rows = truth.where(F.col("value").isNotNull() & ~F.isnan("value")).join(release, KEYS)
    scored = rows.select(
        "estimand", "level", scaled_error(F.col("kind"), F.col("estimate"), F.col("value")).alias("error"),
        F.col("value").between(F.col("low"), F.col("high")).cast("double").alias("covered"), interval_score(F.col("low"), F.col("high"), F.col("value")).alias("interval"),
    )
    return scored.groupingSets([["estimand", "level"], ["estimand"]], "estimand", "level").agg(
        F.max("error").alias("worst"), order_statistic(0.95, "error").alias("p95"), F.avg("error").alias("mean_error"), F.avg("covered").alias("coverage"),
        F.avg("interval").alias("interval_score"), F.count(F.lit(1)).alias("n"),
    )


def relative_error(value: Column, truth: Column, stabiliser: float) -> Column:
    return F.abs(value - truth) / (F.abs(truth) + F.lit(stabiliser))


def composites(scores: DataFrame) -> DataFrame:
    """Accuracy (largest p95), coverage gap (largest distance from 0.9) and mean interval score by number of units; an
    undefined part makes the composite undefined."""
    keep = lambda c, out: F.when(F.count_if(F.col(c).isNull() | F.isnan(c)) == 0, out)
    by_level = scores.where(F.col("level").isNotNull())
    return by_level.agg(
        keep("p95", F.max("p95")).alias("accuracy"), keep("coverage", F.max(F.abs(F.col("coverage") - 0.9))).alias("coverage_gap"),
        keep("interval_score", F.sum(F.col("interval_score") * F.col("n")) / F.sum("n")).alias("interval_quality"),
    )


def gates(values: DataFrame, bars: DataFrame) -> DataFrame:
    """``component, value, ceiling, decides, passed`` and one verdict row (component NULL): all deciding components are
    at or below their ceiling; a value that is not finite fails where it decides."""
    rows = bars.join(values, "component", "left")
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") <= F.col("ceiling"))
    rows = rows.select("component", "value", "ceiling", "decides", F.coalesce(ok, F.lit(False)).alias("passed"))
    verdict = rows.agg(F.coalesce(F.bool_and(F.col("passed") | ~F.col("decides")), F.lit(True)).alias("passed"))
    return rows.unionByName(verdict, allowMissingColumns=True)


def primary_cells(cube: DataFrame, count: str, least: int) -> DataFrame:
    """Cells to protect: positive counts below ``least``."""
    return cube.where((F.col(count) > 0) & (F.col(count) < least))


def recoverable_cells(cube: DataFrame, block: list[str], margins: list[list[str]], suppressed: str) -> DataFrame:
    """Suppressed cells that the published margins and cells determine, per block: ``*block, *cell keys, recoverable``.

    A cell is determined when its unit vector lies in the row space of the margins restricted to suppressed cells. The
    test is linear algebra on the suppressed cells of one block (a county: at most bands times sexes), in one task per block.
    """
    keys = list(dict.fromkeys(k for m in margins for k in m if k not in block))
    hidden = cube.where(F.col(suppressed)).select(*block, *keys).distinct()

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for m in margins:
            on = [k for k in m if k not in block]
            groups = pdf.groupby(on, dropna=False).indices.values() if on else [np.arange(len(pdf))]
            rows += [np.bincount(g, minlength=len(pdf)).astype(float) for g in groups]
        a = np.array(rows)
        basis = np.linalg.svd(a, full_matrices=False)
        space = basis[2][basis[1] > 1e-9]
        return pdf.assign(recoverable=(space**2).sum(0) > 1 - 1e-9)

    return hidden.groupBy(*block).applyInPandas(test, T.StructType([*hidden.schema.fields, T.StructField("recoverable", T.BooleanType())]))


def allocation_regret(demand: DataFrame, unit: str, need: str, given: str) -> DataFrame:
    """Unmet and wasted amounts of an allocation: one row."""
    return demand.agg(F.sum(F.greatest(F.col(need) - F.col(given), F.lit(0.0))).alias("unmet"), F.sum(F.greatest(F.col(given) - F.col(need), F.lit(0.0))).alias("wasted"))
