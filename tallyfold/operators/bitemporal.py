"""Folds over the event ledger: what was visible when, the state at a tick, exposure, migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.operators import deliveries


def visible_at(events: DataFrame, recorded: str, vintage: int | Column) -> DataFrame:
    """The ledger as it stood at a vintage."""
    return events.where(F.col(recorded) <= vintage)


def effective(events: DataFrame, event_id: str, target: str, vintage: int | None = None, recorded: str = "recorded_tick") -> DataFrame:
    """Events no other event withdraws. With a vintage only what was visible then counts, corrections included;
    without one all corrections of the ledger count."""
    seen = events if vintage is None else visible_at(events, recorded, vintage)
    return deliveries.not_withdrawn(seen, deliveries.withdrawals(seen, event_id, target), event_id)


def last_state(events: DataFrame, entity: str, order: list[str], values: list[str], upto: Column | None = None, base: DataFrame | None = None) -> DataFrame:
    """The values of each entity's last event in ``order`` (valid time, not arrival), over an opening state ``base``."""
    rows = events.where(F.col(entity).isNotNull())
    rows = rows.where(upto) if upto is not None else rows
    last = rows.groupBy(entity).agg(F.max(F.struct(*[F.col(c) for c in order], *[F.col(v).alias(f"__{v}") for v in values])).alias("__last"))
    last = last.select(entity, *[F.col(f"__last.__{v}").alias(v) for v in values], F.lit(1).alias("__p"))
    if base is None:
        return last.drop("__p")
    opening = base.select(entity, *values, F.lit(0).alias("__p"))
    merged = last.unionByName(opening).groupBy(entity).agg(F.max_by(F.struct(*values), "__p").alias("__s"))
    return merged.select(entity, "__s.*")


def month_counts(spans: DataFrame, by: list[str], start: Column, end: Column, first: int, last: int, month: str = "tick", name: str = "n") -> DataFrame:
    """How many spans [start, end) cover each month from ``first`` to ``last``: ``*by, month, n``.

    Spans enter and leave: +1 and -1 are added up per group and month, and the running sum over at most
    ``last - first + 1`` months is the count, so rows are not multiplied by the months they cover.
    """
    lo, hi = F.greatest(start, F.lit(first)), F.least(end, F.lit(last + 1))
    steps = spans.select(*by, lo.cast("long").alias("__lo"), hi.cast("long").alias("__hi")).where(F.col("__hi") > F.col("__lo"))
    steps = steps.select(*by, F.explode(F.array(F.struct(F.col("__lo").alias("m"), F.lit(1).alias("d")), F.struct(F.col("__hi").alias("m"), F.lit(-1).alias("d")))).alias("__e"))
    sums = steps.groupBy(*by, F.col("__e.m").alias(month)).agg(F.sum("__e.d").alias("__d"))
    part = W.partitionBy(*by).orderBy(month)
    runs = sums.withColumns({"__n": F.sum("__d").over(part.rowsBetween(W.unboundedPreceding, W.currentRow)), "__next": F.coalesce(F.lead(month).over(part), F.lit(last + 1))})
    return runs.where((F.col("__n") > 0) & (F.col(month) <= last)).select(*by, F.explode(F.sequence(F.col(month), F.col("__next") - 1)).alias(month), F.col("__n").alias(name))


def residence_spans(changes: DataFrame, entity: str, at: str, order: str, place: str, base: DataFrame | None = None) -> DataFrame:
    """Half-open stays ``entity, place, since, until`` (NULL: open) from changes of place; the last change of a month counts.

    ``base`` (entity, place) is where an entity was before its first change (since NULL).
    """
    steps = changes.where(F.col(entity).isNotNull()).groupBy(entity, F.col(at).cast("long").alias("since")).agg(F.max_by(place, order).alias(place))
    if base is not None:
        steps = steps.unionByName(base.where(F.col(entity).isNotNull()).select(entity, F.lit(None).cast("long").alias("since"), place))
    until = F.lead("since").over(W.partitionBy(entity).orderBy(F.col("since").asc_nulls_first()))
    return steps.withColumn("until", until).select(entity, place, "since", "until")


def net_migration(before: DataFrame, after: DataFrame, entity: str, place: str) -> DataFrame:
    """Arrivals minus departures per place, of entities that are in both states and changed place: ``place, net``."""
    moved = before.select(entity, F.col(place).alias("__from")).join(after.select(entity, F.col(place).alias("__to")), entity).where(F.col("__from") != F.col("__to"))
    ends = moved.select(F.explode(F.array(F.struct(F.col("__from").alias("p"), F.lit(-1).alias("d")), F.struct(F.col("__to").alias("p"), F.lit(1).alias("d")))).alias("e"))
    return ends.groupBy(F.col("e.p").alias(place)).agg(F.sum("e.d").alias("net"))


def recent_flag(entities: DataFrame, events: DataFrame, entity: str, at: str, now: int, months: int, name: str) -> DataFrame:
    """``entities`` with whether they had an event in (now - months, now]."""
    hit = events.where((F.col(at) > now - months) & (F.col(at) <= now)).select(entity).distinct().withColumn("__hit", F.lit(True))
    return entities.join(hit, entity, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def first_per_entity(events: DataFrame, entity: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first event of each entity by ``order``."""
    first = events.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("__f"))
    return first.select(entity, *[F.col(f"__f.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """Each named query of broken rows as one row ``rule, n``."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("rule"), "n") for k, df in checks.items()])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the contents of a table whatever its order: ``n, total, folded``."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("folded"))
