"""Attributes of an entity as they were known at the time of an event.

Two times matter: from when a change holds and between which times it was on record. Both are turned into numbers by
counting changes over narrow rows of timestamps; the wide attributes are then fetched by an equi-join on entity and
number, never by a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.session import stored


def _count_up(rows: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """``rows`` with ``number``, how many rows with is_change = 1 lie at or before each within its entity."""
    running = W.partitionBy(entity).orderBy(*order, F.col("is_change").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("number", F.sum("is_change").over(running))


def version_numbers(
    points: DataFrame, changes: DataFrame, entity: str, at: str, known_at: str,
    holds_from: str, order: str, known_from: str, known_until: str,
) -> tuple[DataFrame, DataFrame]:
    """Number the versions of every entity and tell which number each distinct point sees.

    ``points`` has ``entity, at, known_at``; ``changes`` has ``entity, holds_from, order, known_from, known_until``
    (NULL: on record for good). A point sees the changes with holds_from <= at and known_from <= known_at < known_until;
    its version is the last of them by (holds_from, order).

    Record time first: the moments at which the knowledge about an entity changes are counted up to each known_at, which
    gives its epoch. Then valid time: within the epochs that any point asks for, changes on record are counted up to
    each at. Returns ``(entity, at, known_at, number)`` for the points that see something, and ``(entity, number, order)``.
    Rows of an entity are reduced to one per distinct time before any sort, so a hot entity sorts distinct times, not rows.
    The narrow tables that are read more than once are stored in between. Cost: per entity, changes with distinct times times epochs asked for.
    """
    asked = points.where(F.col(entity).isNotNull() & F.col(at).isNotNull() & F.col(known_at).isNotNull()).select(entity, at, known_at).distinct()
    narrow = (
        changes.where(F.col(entity).isNotNull() & F.col(holds_from).isNotNull() & F.col(known_from).isNotNull())
        .where(F.col(known_until).isNull() | (F.col(known_until) > F.col(known_from)))
        .groupBy(entity, F.col(holds_from).alias("t"), F.col(known_from).alias("r"), F.col(known_until).alias("v"))
        .agg(F.max(order).alias("o"))
    )
    narrow = stored(narrow, "changes")
    moments = (
        narrow.select(entity, F.explode(F.array("r", "v")).alias("r")).where(F.col("r").isNotNull()).distinct()
        .select(entity, "r", F.lit(1).alias("is_change"), F.lit(None).cast(points.schema[at].dataType).alias("t"))
    )
    epochs = _count_up(moments.unionByName(asked.select(entity, F.col(known_at).alias("r"), F.lit(0).alias("is_change"), F.col(at).alias("t"))), entity, ["r"])
    asking = stored(epochs.where((F.col("is_change") == 0) & (F.col("number") > 0)).select(entity, F.col("number").alias("epoch"), "t", "r"), "epochs")
    # all known_at of one epoch see the same changes, so any of them stands for it
    used = asking.groupBy(entity, "epoch").agg(F.min("r").alias("now"))
    on_record = (
        narrow.join(used, entity).where((F.col("r") <= F.col("now")) & (F.col("v").isNull() | (F.col("v") > F.col("now"))))
        .groupBy(entity, "epoch", "t").agg(F.max("o").alias("o"))
    )
    both = on_record.select(entity, "epoch", "t", "o", F.lit(1).alias("is_change"), F.lit(None).cast(points.schema[known_at].dataType).alias("r")).unionByName(
        asking.select(entity, "epoch", "t", F.lit(None).cast(changes.schema[order].dataType).alias("o"), F.lit(0).alias("is_change"), "r")
    )
    # the first number of the epoch, so that a point before all changes of its epoch does not see the epoch before
    in_epoch = W.partitionBy(entity, "epoch").orderBy("t", F.col("is_change").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = _count_up(both, entity, ["epoch", "t"]).withColumn("own", F.sum("is_change").over(in_epoch))
    numbered = stored(numbered, "numbers")
    sees = numbered.where((F.col("is_change") == 0) & (F.col("own") > 0)).select(entity, F.col("t").alias(at), F.col("r").alias(known_at), "number")
    versions = numbered.where(F.col("is_change") == 1).select(entity, "number", F.col("o").alias(order))
    return sees, versions


def as_known(
    facts: DataFrame, changes: DataFrame, entity: str, at: str, known_at: str, attributes: list[str],
    holds_from: str, order: str, known_from: str, known_until: str, seen: str = "seen",
) -> DataFrame:
    """``facts`` with the attributes of the version that each one sees, and ``seen``, whether it sees any.

    See ``version_numbers``. ``changes`` also has ``attributes``, whose names must not occur in ``facts`` (else the query
    is refused); an attribute may be NULL in the version seen, which is not filled from an older one. Facts without an
    entity or a time, and those of entities without changes, are kept and see nothing. Repeated facts are each answered.
    Repeats of a change with equal ``order`` must agree; the larger value counts where they do not.
    """
    if clash := sorted({*attributes, seen} & set(facts.columns)):
        raise ValueError(f"facts already have {clash}")
    sees, versions = version_numbers(facts, changes, entity, at, known_at, holds_from, order, known_from, known_until)
    wide = changes.groupBy(entity, order).agg(*[F.max(a).alias(a) for a in attributes])
    answers = sees.join(versions, [entity, "number"]).join(wide, [entity, order]).select(entity, at, known_at, *attributes, F.lit(True).alias(seen))
    return facts.join(answers, [entity, at, known_at], "left").withColumn(seen, F.coalesce(seen, F.lit(False))).select(*facts.columns, *attributes, seen)
