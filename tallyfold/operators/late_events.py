"""Per-period statistics by event time, corrected as late events arrive and closed after a cut-off.

The state of a period is a multiset: how often each value occurred, by the lateness at which it arrived. A late event
adds to a count; medians, distincts and extremes of any version are re-derived from cumulative counts, never from the
events again. The state is additive, so it is combined on the map side and a hot key shuffles one row per distinct
value and lateness, not one per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

VERSION, VALUE, COUNT = "version", "value", "n"


def multiset_state(events: DataFrame, keys: list[str], period: str, arrival: str, cutoff: int, value: str | Column | None = None) -> DataFrame:
    """The value counts of every period by lateness: ``*keys, period, version, value, n``.

    ``version`` is arrival minus period; an arrival before its period counts as version 0. Events more than ``cutoff``
    late, or without a key, period or arrival, are left out. A NULL value is counted (it adds to n of the period, not
    to its distincts, extremes or median). Repeated rows are events of their own: collapse deliveries first.
    """
    late = F.greatest(F.col(arrival) - F.col(period), F.lit(0))
    v = F.lit(None).cast("long") if value is None else F.col(value) if isinstance(value, str) else value
    known = [F.col(c).isNotNull() for c in (*keys, period, arrival)]
    rows = events.where(known[0])
    for k in known[1:]:
        rows = rows.where(k)
    return (
        rows.select(*keys, period, late.cast("int").alias(VERSION), v.alias(VALUE))
        .where(F.col(VERSION) <= cutoff)
        .groupBy(*keys, period, VERSION, VALUE)
        .agg(F.count(F.lit(1)).alias(COUNT))
    )


def period_versions(state: DataFrame, keys: list[str], period: str, cutoff: int, ranges: int = 64) -> DataFrame:
    """Every version of every period in which something arrived, with statistics over all that had arrived by then.

    Returns ``*keys, period, version, n_new, n, n_distinct, min_value, max_value, median_value``; the median averages
    the two middle values and is exact. Values are cut into ``ranges`` ranges at quantiles of all values (an aggregate
    over the whole state; only the range edges reach the driver). Counts are accumulated over ranges first, then over
    the values of just the ranges that hold a middle rank, so no task sorts all values of a hot period.
    """
    group = [*keys, period, VERSION]
    edges = state.where(F.col(VALUE).isNotNull()).agg(
        F.percentile_approx(VALUE, [i / ranges for i in range(1, ranges)], 10_000).alias("e")
    ).first()["e"] or []
    edges = sorted({float(e) for e in edges})
    # a balanced tree of comparisons: log2(ranges) per row, all in generated code
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(VALUE) < edges[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    grown = state.withColumn("range", F.when(F.col(VALUE).isNotNull(), place(0, len(edges)))).select(
        *keys, period, VALUE, "range", COUNT, F.col(VERSION).alias("arrived"), F.explode(F.sequence(F.col(VERSION), F.lit(cutoff))).alias(VERSION)
    )
    counted = grown.groupBy(*group, "range", VALUE).agg(
        F.sum(COUNT).alias(COUNT), F.sum(F.when(F.col("arrived") == F.col(VERSION), F.col(COUNT)).otherwise(0)).alias("n_new")
    )
    by_range = counted.groupBy(*group, "range").agg(
        F.sum(COUNT).alias("c"), F.sum("n_new").alias("new"), F.count(VALUE).alias("d"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")
    )
    whole = W.partitionBy(*group)
    running = whole.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    valued = F.when(F.col("range").isNotNull(), F.col("c")).otherwise(0)
    ranks = (
        by_range.withColumns({"cum": F.sum(valued).over(running), "m": F.sum(valued).over(whole), "n_new": F.sum("new").over(whole)})
        .where(F.col("n_new") > 0)
        .withColumns({"before": F.col("cum") - valued, "r1": F.floor((F.col("m") + 1) / 2), "r2": F.floor(F.col("m") / 2) + 1})
    )
    holds = F.col("range").isNotNull() & (F.col("m") > 0) & (
        ((F.col("r1") > F.col("before")) & (F.col("r1") <= F.col("cum"))) | ((F.col("r2") > F.col("before")) & (F.col("r2") <= F.col("cum")))
    )
    middle = counted.join(ranks.where(holds).select(*group, "range", "before", "r1", "r2"), [*group, "range"])
    inside = W.partitionBy(*group, "range").orderBy(VALUE).rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.col("before") + F.sum(COUNT).over(inside)
    medians = (
        middle.withColumns({"to": at}).withColumn("from", F.col("to") - F.col(COUNT))
        .groupBy(*group)
        .agg(
            F.max(F.when((F.col("r1") > F.col("from")) & (F.col("r1") <= F.col("to")), F.col(VALUE))).alias("v1"),
            F.max(F.when((F.col("r2") > F.col("from")) & (F.col("r2") <= F.col("to")), F.col(VALUE))).alias("v2"),
        )
        .select(*group, ((F.col("v1") + F.col("v2")) / 2).cast("double").alias("median_value"))
    )
    totals = ranks.groupBy(*group).agg(
        F.sum("new").alias("n_new"), F.sum("c").alias("n"), F.sum("d").alias("n_distinct"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value")
    )
    return totals.join(medians, group, "left")


def corrections(versions: DataFrame, keys: list[str], period: str, arrival: str) -> DataFrame:
    """The arrivals that changed a period after its first count: ``*keys, period, arrival, n_late``, one row each.

    ``versions`` are those of ``period_versions``: a correction is a version after the first at which the counts of the
    period's state grew.
    """
    late = versions.where((F.col(VERSION) > 0) & (F.col("n_new") > 0) & (F.col("n") >= F.col("n_new")))
    return late.select(*keys, period, (F.col(period) + F.col(VERSION)).alias(arrival), F.col("n_new").alias("n_late"))
