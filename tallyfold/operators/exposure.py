"""Exposure by attained age and residence, in closed form over intervals, and checks of state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.functions.scalars import RATE_BANDS


def spells(changes: DataFrame, entity: str, at: str, order: str, value: str, last: int) -> DataFrame:
    """What held when: ``entity, value, s, e`` with half-open months [s, e), from changes ``entity, at, order, value``.

    The last change of a month in ``order`` holds from that month on; one row per entity and month of change is left
    before any sort. Changes without entity or month are skipped; a NULL value ends what held before and gives no spell.
    """
    steps = changes.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(entity, F.col(at).alias("s")).agg(F.max_by(value, order).alias(value))
    following = F.lead("s").over(W.partitionBy(entity).orderBy("s"))
    return steps.withColumn("e", F.coalesce(following, F.lit(last + 1))).where(F.col(value).isNotNull())


def residence_exposure(people: DataFrame, stays: DataFrame, places: DataFrame, person: str, household: str, unit: str, last: int, bands=RATE_BANDS) -> DataFrame:
    """Person-months by residence, sex and age attained in each month, after the month's events: ``unit, sex, band, months``.

    ``people`` has person, sex, birth and the months [s, e) in which each lives; ``stays`` the households of a person and
    ``places`` the units of a household, both as ``spells``. Months are counted by the overlap of intervals, never one by
    one: a row per person, stay, place and band that meet. People without sex, and months without a known place, count nowhere.
    """
    alive = people.where(F.col("sex").isNotNull() & F.col("birth").isNotNull()).withColumnsRenamed({"s": "s0", "e": "e0"})
    home = alive.join(stays.withColumnsRenamed({"s": "s1", "e": "e1"}), person)
    home = home.withColumns({"s": F.greatest("s0", "s1", F.lit(1)), "e": F.least("e0", "e1", F.lit(last + 1))}).where("s < e")
    there = home.select("sex", "birth", household, "s", "e").join(places.withColumnsRenamed({"s": "s2", "e": "e2"}), household)
    there = there.withColumns({"s": F.greatest("s", "s2"), "e": F.least("e", "e2")}).where("s < e")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), (F.col("birth") + 12 * lo).alias("lo"), (F.col("birth") + 12 * (hi + 1)).alias("hi")) for b, lo, hi in bands]))
    cut = there.withColumn("z", each).withColumn("months", F.least("e", "z.hi") - F.greatest("s", "z.lo")).where("months > 0")
    return cut.groupBy(unit, "sex", F.col("z.band").alias("band")).agg(F.sum("months").alias("months"))


def in_month_order(events: DataFrame, kind: str, priority: dict[int, int], tick: str, event_id: str, name: str = "seq") -> DataFrame:
    """``events`` with their place within a month: by the priority of their kind, then by id (ends come before deaths, deaths
    before closings, whatever the ids). Ranked per month, which is a time domain."""
    rank = F.lit(len(priority))
    for k, p in priority.items():
        rank = F.when(F.col(kind) == k, p).otherwise(rank)
    return events.withColumn(name, F.row_number().over(W.partitionBy(tick).orderBy(rank, F.col(kind), event_id)))


def broken_transitions(events: DataFrame, entity: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Entities whose openings and closings don't take turns: ``entity, opened_twice, closed_unopened``, those with any.

    A running state per entity: an opening while open, and a closing while not open, break the rules. Events of one
    entity are put in order in one task; they are as many as its openings and closings.
    """
    rows = events.where(F.col(entity).isNotNull() & (opens | closes)).select(entity, *order, F.when(opens, 1).otherwise(0).alias("__o"))
    before = F.lag("__o", 1, 0).over(W.partitionBy(entity).orderBy(*order))
    flagged = rows.withColumn("__b", before)
    out = flagged.groupBy(entity).agg(F.count_if((F.col("__o") == 1) & (F.col("__b") == 1)).alias("opened_twice"), F.count_if((F.col("__o") == 0) & (F.col("__b") == 0)).alias("closed_unopened"))
    return out.where("opened_twice > 0 or closed_unopened > 0")
