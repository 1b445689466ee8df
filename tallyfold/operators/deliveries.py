"""Repeated deliveries of one change, and the changes that later changes withdraw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _missing_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns], F.lit(0).cast("long"))


def order_of_delivery(arrival: str, keep: list[str], arrival_type: T.DataType) -> Column:
    """Orders deliveries of one change: the smallest arrival first, of equal ones the fullest, then by a hash of the contents.

    Whole numbers are packed with the rest into one decimal, which aggregates in place with map-side combining, whatever
    their size; other types are ordered as a struct.
    """
    full, mark = _missing_count(keep), F.shiftrightunsigned(F.xxhash64(*keep), 16)
    if isinstance(arrival_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.col(arrival).cast("long") * F.lit(2**31) + full * F.lit(2**22) + F.shiftrightunsigned(mark, 26)
    if isinstance(arrival_type, T.LongType):
        # 19 digits of arrival, then 18 of the rest
        return (F.col(arrival).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + (full * F.lit(10**15) + mark).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(F.col(arrival), full, mark)


def first_deliveries(events: DataFrame, event_id: str, arrival: str, keep: list[str]) -> DataFrame:
    """One row per event: its first delivery, the one with the smallest arrival.

    Of several rows with the smallest arrival the one with the fewest NULLs among ``keep`` counts; equally full
    ones are ordered by a hash of their contents, so repeated runs agree. Rows without an id or an arrival are
    left out. Any orderable arrival works. An empty table gives an empty one. Returns ``event_id, arrival, *keep``;
    other columns are pruned.
    """
    rows = events.select(event_id, arrival, *keep).where(F.col(event_id).isNotNull() & F.col(arrival).isNotNull())
    if not keep:
        return rows.groupBy(event_id).agg(F.min(arrival).alias(arrival))
    return (
        rows.withColumn("__order", order_of_delivery(arrival, keep, events.schema[arrival].dataType))
        .groupBy(event_id)
        .agg(F.min(arrival).alias(arrival), *[F.min_by(c, "__order").alias(c) for c in keep])
    )


def withdrawals(events: DataFrame, event_id: str, target: str, arrival: str | None = None) -> DataFrame:
    """The ids that another event names in ``target``, once each; with ``arrival``, the first arrival of such an event.

    An event that names itself withdraws nothing, NULL and 0 name nothing, and a name that no event bears is kept.
    Returns ``event_id[, withdrawn_at]``.
    """
    named = events.where((F.col(target) != 0) & (F.col(target) != F.col(event_id)))
    ids = named.groupBy(F.col(target).alias(event_id))
    return ids.agg(F.min(arrival).alias("withdrawn_at")) if arrival else named.select(F.col(target).alias(event_id)).distinct()


def not_withdrawn(events: DataFrame, withdrawn: DataFrame, event_id: str) -> DataFrame:
    """``events`` without those whose id is withdrawn."""
    return events.join(withdrawn.select(event_id), event_id, "left_anti")

