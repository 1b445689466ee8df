"""What changed between two full snapshots, by Merkle trees over hash ranges of the key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import stored

#: Rows that one leaf of the tree is meant to hold, and children of a node as a power of two.
ROWS_PER_LEAF, STEP_BITS = 64, 4


def leaf_bits(rows: int) -> int:
    """Bits of the hash that number the leaves, so that leaves hold ``ROWS_PER_LEAF`` to half as many rows."""
    return max(1, min(62, math.ceil(math.log2(max(rows, 1) / ROWS_PER_LEAF + 1))))


def _leaf(key: str, bits: int) -> Column:
    """The range of the key's hash that the leaf stands for."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _marked(content: list[str]) -> list[Column]:
    """The content with a mark per column for NULL, which the hash functions skip: a value moved across a NULL is another content."""
    return [c for name in content for c in (F.col(name).isNull(), F.col(name))]


def _combined(*marks: str) -> list[Column]:
    """Digest of a multiset of rows; adding up makes it independent of order, the count tells repeats apart."""
    return [F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in marks]]


def leaf_digests(snapshot: DataFrame, key: str, content: list[str], bits: int) -> DataFrame:
    """Per hash range: number of rows and two sums of 64-bit row hashes with different seeds (kept as wide decimals).

    Combined on the map side; a shuffle carries one row per leaf and task, however hot a key is.
    """
    marked = snapshot.where(F.col(key).isNotNull()).select(
        _leaf(key, bits).alias("leaf"), F.lit(1).cast("long").alias("rows"),
        F.xxhash64(key, *_marked(content)).cast("decimal(20,0)").alias("h1"), F.xxhash64(F.lit(7), *reversed(_marked(content)), key).cast("decimal(20,0)").alias("h2"),
    )
    return marked.groupBy("leaf").agg(*_combined("h1", "h2"))


def differing_leaves(before: DataFrame, after: DataFrame, bits: int) -> DataFrame:
    """Leaves whose digests differ, found from the root down: children are compared only below a differing parent.

    The digests are stored, one row per leaf, and so are the differing nodes of each level; equal snapshots end at the top.
    """
    before, after = stored(before, "leaves"), stored(after, "leaves")

    def level(leaves: DataFrame, depth: int) -> DataFrame:
        node = F.shiftrightunsigned("leaf", bits - depth).alias("leaf")
        return leaves if depth == bits else leaves.groupBy(node).agg(*_combined("h1", "h2"))

    differ, above = None, 0
    for depth in [*range(STEP_BITS, bits, STEP_BITS), bits]:
        a, b = level(before, depth), level(after, depth)
        if differ is not None:  # only children of differing parents
            parent = F.shiftrightunsigned("leaf", depth - above).alias("parent")
            up = differ.select(F.col("leaf").alias("parent"))
            a, b = (x.withColumn("parent", parent).join(up, "parent", "left_semi").drop("parent") for x in (a, b))
        a = a.select("leaf", F.struct("rows", "h1", "h2").alias("a"))
        b = b.select("leaf", F.struct("rows", "h1", "h2").alias("b"))
        differ, above = stored(a.join(b, "leaf", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("leaf"), "nodes"), depth
        if differ.isEmpty():
            break
    return differ


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, content: list[str], bits: int | None = None) -> DataFrame:
    """Keys ``added``, ``removed`` or ``changed`` between two full snapshots: ``key, change``, one row per key.

    The content of a key is the set of its distinct rows over ``content`` (NULL equals NULL; write other codes for
    missing as NULL first), so repeated rows change nothing. Rows without a key are left out. Leaves are digests of all
    rows; equal digests (two sums of 64-bit hashes with different seeds, and a count) are taken as equal content, wrong for
    about one in 2**128 differing leaves, and only rows of differing leaves are
    compared, by their full contents. That comparison groups by key and content first, with map-side combining, so a
    key that holds a third of the rows is spread. Columns other than key and content are pruned.
    """
    if bits is None:
        bits = leaf_bits(max(before.select(key).count(), after.select(key).count()))
    differ = differing_leaves(leaf_digests(before, key, content, bits), leaf_digests(after, key, content, bits), bits)

    def rows(snapshot: DataFrame, side: str) -> DataFrame:
        kept = snapshot.where(F.col(key).isNotNull()).select(key, *content)
        kept = kept.withColumn("leaf", _leaf(key, bits)).join(differ, "leaf", "left_semi").drop("leaf")
        return kept.withColumns({"was": F.lit(side == "before"), "is": F.lit(side == "after")})

    per_content = rows(before, "before").unionByName(rows(after, "after")).groupBy(key, *content).agg(F.max("was").alias("was"), F.max("is").alias("is"))
    per_key = per_content.groupBy(key).agg(F.max("was").alias("was"), F.max("is").alias("is"), F.max(F.col("was") != F.col("is")).alias("differs"))
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").when(F.col("differs"), "changed")
    return per_key.select(key, change.alias("change")).where(F.col("change").isNotNull())
