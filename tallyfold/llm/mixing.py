"""Mixtures of sources by target shares of tokens, written out as shards that each mirror the mixture.

The texts of a source are put in a random order by hash and cut into blocks, once per permitted repetition. Exact
numbers of blocks per source are split among the output shards down a binary tree, each node drawing its left half
from a multivariate hypergeometric distribution, as if all blocks had been shuffled and dealt. A shard then takes that
many of the next blocks of each source's permutation, and its rows are shuffled by hash among themselves. The driver
splits the top of the tree; tasks split the subtrees and permute the blocks, which are nowhere listed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.session import sent_by_value, stored

sent_by_value(__name__)

#: Tokens that a block and an output shard are meant to hold.
BLOCK_TOKENS, SHARD_TOKENS = 50_000, 2_000_000
#: Subtrees of the splitting tree that the driver deals out to tasks, children per step of a search for the end of a quota
#: (as a power of two), and texts among which the last step may look on the driver. None of them changes a result.
SUBTREES, FAN_BITS, LAST_TEXTS = 4_096, 12, 20_000


@dataclass
class Mixture:
    """``rows``: shard, place, doc_id, source, copy, n_tokens. ``report``: per source what was asked for and reached."""

    rows: DataFrame
    report: DataFrame


def canonical_source(column: str | Column) -> Column:
    """One spelling per source: lower case, spaces and hyphens as underscores, none around; NULL for a blank one."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.regexp_replace(F.trim(F.lower(c)), r"[\s\-_]+", "_")
    return F.nullif(F.regexp_replace(c, "^_+|_+$", ""), F.lit(""))


#: Fixed value: how byte-level BPE parts a text before merging, where a file of ranks doesn't say.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(tokenizer_file: str, pattern: str = BYTE_BPE_PATTERN):
    """A function from texts to their numbers of tokens, for a file of BPE ranks (``.tiktoken``) or a ``tokenizers``
    JSON file. The strings of special tokens are ordinary text."""
    if tokenizer_file.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer_file, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e) for at in range(0, len(texts), 500) for e in tokenizer.encode_batch(texts[at : at + 500], add_special_tokens=False)]


def with_token_counts(docs: DataFrame, text: str, tokenizer_file: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; NULL for NULL. Each Python worker reads the file once per task."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = token_counter(tokenizer_file)
        for texts in batches:
            yield pd.Series(counts(texts.fillna("").tolist()), index=texts.index)

    return docs.withColumn(name, F.when(F.col(text).isNotNull(), count(text)))


def distinct_texts(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer_file: str) -> DataFrame:
    """``source, mark, doc_id, n_tokens``: every text of a source once (told apart by SHA-256), under its smallest id."""
    rows = docs.select(canonical_source(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_token_counts(rows.where(F.col("source").isNotNull() & F.col("text").isNotNull()), "text", tokenizer_file)
    return (
        rows.select("source", F.sha2("text", 256).alias("mark"), "doc_id", "n_tokens").where(F.col("n_tokens") > 0)
        .groupBy("source", "mark").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    )


def split_node(lo: int, hi: int, here: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Where the shards [lo, hi) part, and the blocks of each source that go to the left; keyed by the node, so that any task draws the same."""
    mid = (lo + hi) // 2
    take = int(round(int(here.sum()) * (mid - lo) / (hi - lo)))
    left, rest = np.zeros_like(here), int(here.sum())
    rng = np.random.default_rng([seed, lo, hi])
    # source by source: of the ``take`` still to be drawn from ``rest`` blocks, how many are of this source
    for i, n in enumerate(here):
        left[i] = _hypergeometric(int(n), rest - int(n), take, rng)
        take, rest = take - int(left[i]), rest - int(n)
    return mid, left


def _hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """One draw; sizes of a billion and more, which the generator refuses, by the normal limit, kept in range."""
    low, high = max(0, take - bad), min(good, take)
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, take)) if take and good else low
    n = good + bad
    spread = (take / n * good * (bad / n) * ((n - take) / max(n - 1, 1))) ** 0.5
    return min(max(round(take / n * good + spread * rng.standard_normal()), low), high)


def split_tree(quotas: np.ndarray, lo: int, hi: int, first: np.ndarray, seed: int, most: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, first, blocks)`` of the single shards in [lo, hi), or of ``most`` subtrees about: the blocks of each source that they
    get, and where these start in the source's permutation. Sums to ``quotas`` exactly."""
    out, stack, width = [], [(lo, hi, np.asarray(first, np.int64), np.asarray(quotas, np.int64))], max(1, (hi - lo) // most) if most else 1
    while stack:
        lo, hi, start, here = stack.pop()
        if hi - lo <= width:
            out.append((lo, hi, start, here))
            continue
        mid, left = split_node(lo, hi, here, seed)
        stack += [(mid, hi, start + left, here - left), (lo, mid, start, left)]
    return out


def permuted(place: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), at some places: a Feistel network on the next power of four, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for i in range(5):
            z = (b + np.uint64((key + i * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z >> np.uint64(29)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def quota_ends(texts: DataFrame, room: dict[str, int]) -> dict[str, tuple[int, str]]:
    """Where a quota ends: per source the first ``(order, mark)`` that no longer fits into its room, for those that don't fit whole.

    ``texts`` (source, order, mark, n_tokens) are filled in ascending order. The hash range that holds the end is narrowed
    step by step, each an aggregate of at most ``2 ** FAN_BITS`` sums a source, until few texts are left in it.
    """
    spark, ends = texts.sparkSession, {}
    texts = texts.select("source", "order", "mark", "n_tokens")
    at = {s: (0, 0, r) for s, r in room.items()}  # prefix, its bits, room that is left
    while at:
        where = spark.createDataFrame([(s, p, bits) for s, (p, bits, _) in at.items()], "source string, prefix bigint, bits int")
        inside = texts.join(F.broadcast(where), "source").where(F.expr("shiftrightunsigned(order, 63 - bits) = prefix"))
        bits = next(iter(at.values()))[1]
        child = F.shiftrightunsigned("order", 63 - bits - FAN_BITS).bitwiseAND(F.lit(2**FAN_BITS - 1))
        sums: dict[str, list] = {s: [] for s in at}
        for r in inside.groupBy("source", child.alias("child")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            sums[r["source"]].append((r["child"], r["t"], r["n"]))
        following, last = {}, {}
        for s, (prefix, _, left) in at.items():
            for c, t, n in sorted(sums[s]):
                if t > left:
                    step = (prefix << FAN_BITS | c, bits + FAN_BITS, left)
                    (last if n <= LAST_TEXTS or bits + 2 * FAN_BITS > 63 else following)[s] = step
                    break
                left -= t
        if last:
            where = spark.createDataFrame([(s, p, b) for s, (p, b, _) in last.items()], "source string, prefix bigint, bits int")
            rows = texts.join(F.broadcast(where), "source").where(F.expr("shiftrightunsigned(order, 63 - bits) = prefix")).select("source", "order", "mark", "n_tokens").collect()
            for s, (_, _, left) in last.items():
                for order, mark, n in sorted((r["order"], r["mark"], r["n_tokens"]) for r in rows if r["source"] == s):
                    if n > left:
                        ends[s] = (order, mark)
                        break
                    left -= n
        at = following
    return ends


def mix(docs: DataFrame, targets: DataFrame, tokenizer_file: str, total_tokens: int | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mixture:
    """Mix the sources of ``docs`` to ``targets`` (source, target_share, max_repeats), a list of sources that the driver holds.

    Sizes are tokens of whole texts. A text of a source is used at most ``max_repeats`` times, copies of it included,
    and no text a second time before all others once. Without ``total_tokens`` the total is the largest at which every
    source that has texts gets its share; with it, a source that is too small gives all it may and the report shows
    the shortfall. Sources without targets, or with a share or repeats of zero or NULL, give nothing; targets without texts are
    reported with nothing reached. Spellings of a source are unified on both sides; targets that then coincide add up
    their shares and take the smaller number of repeats. Documents without source, without text or without any token are left out. A source
    misses its quota by less than one text. The same seed gives the same mixture.
    """
    spark = docs.sparkSession
    wanted = (
        targets.select(canonical_source("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
        .where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).na.fill(0)
    )
    goals = {r["source"]: (r["share"], r["repeats"]) for r in wanted.collect()}
    usable = spark.createDataFrame([(s,) for s, (share, n) in goals.items() if share > 0 and n > 0], "source string")
    texts = stored(distinct_texts(docs, doc_id, text, source, tokenizer_file).join(F.broadcast(usable), "source", "left_semi"), "texts")
    sizes = {r["source"]: r["t"] for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    if total_tokens is None:
        total_tokens = min((int(t * goals[s][1] / goals[s][0]) for s, t in sizes.items()), default=0)
    quota = {s: min(int(total_tokens * goals[s][0]), t * goals[s][1]) for s, t in sizes.items()}
    # copies, bits that number the blocks of one copy; all copies but the last are used whole
    plan = {s: (-(-quota[s] // sizes[s]), int(np.log2(max(sizes[s] / BLOCK_TOKENS, 1)))) for s in sorted(sizes) if quota[s] > 0}

    def ordered(copy: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), copy, "source", "mark"), 1)

    setting = F.broadcast(spark.createDataFrame([(s, c, k) for s, (c, k) in plan.items()], "source string, copies int, bits int"))
    last = texts.join(setting, "source").withColumn("order", ordered(F.col("copies") - 1))
    ends = quota_ends(last, {s: quota[s] - (c - 1) * sizes[s] for s, (c, _) in plan.items() if quota[s] < c * sizes[s]})
    # blocks in use, the one in which the quota ends included
    blocks = np.array([(c - 1 << k) + ((ends[s][0] >> 63 - k) + 1 if s in ends else 1 << k) for s, (c, k) in plan.items()], np.int64)
    names, bits, shards = list(plan), [k for _, k in plan.values()], max(1, round(sum(quota.values()) / SHARD_TOKENS))
    trees = [(lo, hi, first.tolist(), n.tolist()) for lo, hi, first, n in split_tree(blocks, 0, shards, np.zeros(len(names), np.int64), seed, SUBTREES)] if names else []

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, first, n in zip(batch["lo"], batch["hi"], batch["first"], batch["n"], strict=True):
                leaves = split_tree(np.array(n), lo, hi, np.array(first), seed)
                # the shards of a subtree take neighbouring places of each source's permutation
                for i in np.flatnonzero(n):
                    for at in range(first[i], first[i] + n[i], 1_000_000):
                        place = np.arange(at, min(at + 1_000_000, first[i] + n[i]))
                        block = permuted(place, int(blocks[i]), seed * 1_000_003 + int(i))
                        owner = np.searchsorted([start[i] for _, _, start, _ in leaves], place, side="right") - 1
                        yield pd.DataFrame({"source": names[i], "copy": (block >> bits[i]).astype(np.int32), "block": block & ((1 << bits[i]) - 1), "shard": np.array([leaf[0] for leaf in leaves], np.int64)[owner]})

    subtrees = spark.createDataFrame(trees, "lo bigint, hi bigint, first array<bigint>, n array<bigint>").repartition(max(1, min(len(trees), 512)))
    shard_of = subtrees.mapInPandas(dealt, "source string, copy int, block bigint, shard bigint")
    until = F.broadcast(spark.createDataFrame([(s, plan[s][0] - 1, *e) for s, e in ends.items()], "source string, copy int, end_order bigint, end_mark string"))
    items = (
        texts.join(setting, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("order", ordered(F.col("copy")))
        .join(until, ["source", "copy"], "left")
        .where(F.col("end_order").isNull() | (F.col("order") < F.col("end_order")) | ((F.col("order") == F.col("end_order")) & (F.col("mark") < F.col("end_mark"))))
        .select("source", "mark", "doc_id", "n_tokens", "copy", F.expr("shiftrightunsigned(order, 63 - bits)").alias("block"))
    )
    # Spark broadcasts the placement of blocks where it is small, else both sides are shuffled by block
    used = items.join(shard_of, ["source", "copy", "block"])
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "mark", "copy"), "mark", "copy", "source"))
    rows = stored(used.withColumn("place", place).select("shard", "place", "doc_id", "source", "copy", "n_tokens"), "mixture")
    reached = rows.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_texts"), (F.max("copy") + 1).alias("most_uses"))
    whole = rows.agg(F.sum("n_tokens").alias("whole"))
    report = (
        spark.createDataFrame([(s, *g) for s, g in goals.items()], "source string, target_share double, max_repeats int")
        .join(reached, "source", "left").crossJoin(whole).na.fill(0, ["n_tokens", "n_texts", "most_uses"])
        .withColumn("reached_share", F.col("n_tokens") / F.nullif(F.col("whole"), F.lit(0))).drop("whole")
    )
    return Mixture(rows, report)
