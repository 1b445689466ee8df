"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _reach(spans: DataFrame, entity: str, start: str, end: str, chunk: Column | None) -> DataFrame:
    """Each span with ``reach``, the largest end of the spans that start before it (NULL for the first)."""
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    if chunk is None:
        return spans.withColumn("reach", F.max(end).over(before(W.partitionBy(entity).orderBy(start))))
    cut = spans.withColumn("chunk", chunk)
    carried = (
        cut.groupBy(entity, "chunk").agg(F.max(end).alias("e"))
        .withColumn("carry", F.max("e").over(before(W.partitionBy(entity).orderBy("chunk")))).drop("e")
    )
    inside = F.max(end).over(before(W.partitionBy(entity, "chunk").orderBy(start)))
    return cut.withColumn("own", inside).join(carried, [entity, "chunk"]).withColumn("reach", F.greatest("own", "carry")).drop("own", "carry", "chunk")


def distinct_starts(spans: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The longest span of each entity and start. Merging needs no other; this combines on the map side.

    Spans without an entity, start or end, and those that do not end after their start, cover nothing and are left out.
    """
    return (
        spans.where(F.col(entity).isNotNull() & (F.col(end) > F.col(start)))
        .groupBy(entity, start).agg(F.max(end).alias(end))
    )


def periods(spans: DataFrame, entity: str, start: str, end: str, chunk: Column | None = None) -> DataFrame:
    """Continuous covered periods ``entity, start, end`` of half-open spans [start, end).

    Spans are sorted by start, each start is compared with the running maximum of the ends before it, and a start
    beyond it opens a new island. Spans that touch are one period. Extra columns are dropped, repeated spans change
    nothing. The spans of an entity are first reduced to the longest of each start, so the sort holds at most as many
    rows as there are distinct starts. Where that is still large, ``chunk`` (an expression that rises with ``start``)
    cuts an entity into pieces sorted apart, with the running maximum of earlier pieces carried in.
    """
    reached = _reach(distinct_starts(spans, entity, start, end), entity, start, end, chunk)
    opens = (F.col("reach").isNull() | (F.col(start) > F.col("reach"))).cast("long")
    if chunk is None:
        island = F.sum(opens).over(W.partitionBy(entity).orderBy(start).rowsBetween(W.unboundedPreceding, W.currentRow))
        return (
            reached.withColumn("island", island).groupBy(entity, "island")
            .agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")
        )
    # in pieces: a period ends where the next one opens, or at the last end
    opened = reached.where(opens == 1).select(entity, start, "reach")
    last = spans.where(F.col(end) > F.col(start)).groupBy(entity).agg(F.max(end).alias("last"))
    next_reach = F.lead("reach").over(W.partitionBy(entity).orderBy(start))
    return opened.withColumn("next", next_reach).join(last, entity).select(entity, start, F.coalesce("next", "last").alias(end))


def gaps(spans: DataFrame, entity: str, start: str, end: str, chunk: Column | None = None, names: tuple[str, str] = ("gap_start", "gap_end")) -> DataFrame:
    """The holes between two covered periods of an entity: first point not covered, first point covered again."""
    reached = _reach(distinct_starts(spans, entity, start, end), entity, start, end, chunk)
    return reached.where(F.col(start) > F.col("reach")).select(entity, F.col("reach").alias(names[0]), F.col(start).alias(names[1]))
