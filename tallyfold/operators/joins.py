"""Joins beyond the built-in ones: unique keys, blocked candidates, as-of and nearest lookups, snapshots side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.session import stored

def unique_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key occurs once; decided by aggregation, so a key with very many rows is never gathered."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__only")).where(F.col("__n") == 1)
    # equality that takes NULL for a value: a missing part of a key repeats like any other
    match = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return df.alias("l").join(once.alias("r"), match, "left_semi")


def exact_unique_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: str, order_b: str, positive: list[str] = ()) -> DataFrame:
    """Inner join on keys that occur once on both sides. Uniqueness is judged first, then rows whose ``positive`` keys
    are NULL or not above zero are dropped, so unknown codes can make no pair but can spoil a key."""
    left, right = unique_rows(a, keys, order_a), unique_rows(b, keys, order_b)
    for k in positive:
        left = left.where(F.col(k) > 0)
    return left.join(right, keys)


def block_pairs(a: DataFrame, b: DataFrame, id_a: str, id_b: str, block: list[str], either: list[str]) -> DataFrame:
    """Distinct pairs of ids in the same block that agree on one of ``either``: a union of equi-joins, never block pairs."""
    parts = [a.select(F.col(id_a).alias("id_a"), *block, c).join(b.select(F.col(id_b).alias("id_b"), *block, c), [*block, c]).select("id_a", "id_b") for c in either]
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()


def asof_join(facts: DataFrame, changes: DataFrame, by: str, at: str, since: str, value: str, tie: str, default: Column | None = None, bucket: int | None = None) -> DataFrame:
    """``facts`` with the ``value`` of the last change at or before ``at`` (ties on ``since``: the largest ``tie``).

    Changes are reduced to one per entity and time and merged with the distinct times asked for; a running last value
    fills the latter. With ``bucket`` an entity is cut into pieces of that many time units, each carrying in the last
    value of the pieces before, so that a hot entity is spread.
    """
    steps = changes.where(F.col(by).isNotNull() & F.col(since).isNotNull()).groupBy(by, F.col(since).alias("__t")).agg(F.max_by(value, tie).alias("__v"), F.lit(0).alias("__q"))
    asked = facts.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, F.col(at).alias("__t")).distinct().select(by, "__t", F.lit(None).cast(changes.schema[value].dataType).alias("__v"), F.lit(1).alias("__q"))
    both = steps.unionByName(asked).withColumn("__s", F.when(F.col("__q") == 0, F.struct(F.col("__v").alias("v"))))
    frame = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    if bucket:
        both = both.withColumn("__b", F.floor(F.col("__t") / bucket))
        own = F.last("__s", True).over(frame(W.partitionBy(by, "__b").orderBy("__t", "__q")))
        ends = both.groupBy(by, "__b").agg(F.max_by("__s", F.when(F.col("__q") == 0, F.col("__t"))).alias("__e"))
        ends = ends.withColumn("__carry", F.last("__e", True).over(W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__e")
        seen = both.withColumn("__own", own).join(ends, [by, "__b"]).withColumn("__x", F.coalesce("__own", "__carry"))
    else:
        seen = both.withColumn("__x", F.last("__s", True).over(frame(W.partitionBy(by).orderBy("__t", "__q"))))
    found = seen.where(F.col("__q") == 1).select(by, F.col("__t").alias(at), F.col("__x.v").alias(value), F.col("__x").isNotNull().alias("__found"))
    out = facts.join(found, [by, at], "left")
    if default is not None:
        out = out.withColumn(value, F.when(F.coalesce("__found", F.lit(False)), F.col(value)).otherwise(default))
    return out.select(*facts.columns, value)


def nearest_site(points: DataFrame, sites: DataFrame, row: str = "row", col: str = "col", site: str = "site") -> DataFrame:
    """``points`` with the site at the smallest Chebyshev distance (ties: the smallest site id) and that distance.

    Places are searched in squares that double in size: a place meets the sites of its own square and the eight around
    it by an equi-join, and is done once it has one within the length of a square; the others go on. Any number of sites
    and points; points of one place are searched once. Both columns are NULL for a point without a place, or if there are no sites.
    """
    near = sites.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("__r"), F.col(col).alias("__c")).agg(F.min(site).alias("__s"))
    left = points.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(row, col).distinct()
    ends = [df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first() for df, a, b in ((near, "__r", "__c"), (left, row, col))]
    found, length = None, 1
    if all(e[0] is not None for e in ends):
        span = max(max(e[1] for e in ends) - min(e[0] for e in ends), max(e[3] for e in ends) - min(e[2] for e in ends)) + 1
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        while True:
            square = lambda c: F.floor(F.col(c) / length)  # noqa: B023, E731
            sent = near.withColumn("__z", F.explode(steps)).select("__r", "__c", "__s", (square("__r") + F.col("__z.i")).alias("__i"), (square("__c") + F.col("__z.j")).alias("__j"))
            far = F.greatest(F.abs(F.col("__r") - F.col(row)), F.abs(F.col("__c") - F.col(col)))
            met = left.withColumns({"__i": square(row), "__j": square(col)}).join(sent, ["__i", "__j"], "left")
            best = met.groupBy(row, col).agg(F.min(F.struct(far.alias("distance"), F.col("__s").alias("site"))).alias("__b"))
            best = stored(best.withColumn("__done", F.coalesce(F.col("__b.distance") <= length, F.lit(False))), "nearest")
            done = best.where("__done").select(row, col, "__b")
            found = done if found is None else found.unionByName(done)
            left = best.where("not __done").select(row, col)
            if length > span or left.isEmpty():
                break
            length *= 2
    if found is None:
        found = left.limit(0).select(row, col, F.lit(None).cast(f"struct<distance:bigint, site:{sites.schema[site].dataType.simpleString()}>").alias("__b"))
    return points.join(found, [row, col], "left").select(*points.columns, F.col("__b.site").alias("nearest"), F.col("__b.distance").alias("distance"))


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails where a key occurs twice on a side."""
    def checked(df: DataFrame, flag: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        return df.join(n, keys).withColumn(flag, F.when(F.col("__n") > 1, F.raise_error(F.lit("a key occurs twice")).cast("int")).otherwise(1)).where(F.col(flag) == 1).drop("__n", flag)
    return checked(a, "__ca").join(checked(b, "__cb"), keys, how)


def overlay(base: DataFrame, by: list[str], replacement: DataFrame) -> DataFrame:
    """``base`` with the rows of the keys in ``replacement`` replaced."""
    return base.join(replacement.select(*by).distinct(), by, "left_anti").unionByName(replacement, allowMissingColumns=True)


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of either side with a flag per column, whether it differs (NULL equals NULL); an absent row differs from any value."""
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key, "full")
    return both.select(key, *[(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"{c}_differs") for c in columns])
