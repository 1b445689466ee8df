"""Classic record linkage: agreement patterns, Fellegi-Sunter weights by EM over pattern counts, one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.scalars import uniform
from tallyfold.session import cut, sent_by_value

sent_by_value(__name__)


def agreement_pattern(a: str, b: str, fields: list[str]) -> Column:
    """Agreements of two aliased sides as bits, the first field in bit 0; a missing value does not agree."""
    out = F.lit(0)
    for i, f in enumerate(fields):
        out = out + F.when(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), 1 << i).otherwise(0)
    return out


def fit_fellegi_sunter(counts: dict[int, int], n_fields: int, rounds: int = 80) -> tuple[float, np.ndarray, np.ndarray, dict[int, float]]:
    """Two-class mixture over pattern counts: (share of matches, m, u, posterior per pattern). Counts give the same optimum as pairs."""
    patterns = np.array(sorted(counts), int)
    n = np.array([counts[p] for p in patterns], float)
    bits = ((patterns[:, None] >> np.arange(n_fields)) & 1).astype(float)
    p, m, u = 0.1, np.full(n_fields, 0.9), np.full(n_fields, 0.1)
    g = np.zeros(len(n))
    for _ in range(rounds if len(n) else 0):
        lm = np.log(p) + bits @ np.log(m) + (1 - bits) @ np.log(1 - m)
        lu = np.log(1 - p) + bits @ np.log(u) + (1 - bits) @ np.log(1 - u)
        g = 1 / (1 + np.exp(np.clip(lu - lm, -700, 700)))
        w, v = n * g, n * (1 - g)
        p = float(np.clip(w.sum() / n.sum(), 1e-6, 1 - 1e-6))
        m = np.clip((w @ bits) / max(w.sum(), 1e-12), 1e-4, 1 - 1e-4)
        u = np.clip((v @ bits) / max(v.sum(), 1e-12), 1e-4, 1 - 1e-4)
    return p, m, u, dict(zip(patterns.tolist(), g.tolist(), strict=True))


def link_posteriors(pairs: DataFrame, pattern: str, n_fields: int) -> DataFrame:
    """``pairs`` with the posterior of their pattern; only counts of at most 2**n_fields patterns reach the driver."""
    counts = {r[pattern]: r["n"] for r in pairs.groupBy(pattern).agg(F.count(F.lit(1)).alias("n")).collect()}
    post = fit_fellegi_sunter(counts, n_fields)[3]
    table = pairs.sparkSession.createDataFrame([(k, v) for k, v in post.items()], f"{pattern} int, posterior double")
    return pairs.join(F.broadcast(table), pattern, "left")


def sampled_links(pairs: DataFrame, key: list[str], posterior: str, draws: int, seed: int) -> DataFrame:
    """``draws`` imputations of which pairs are links, each pair drawn by its posterior with keyed random numbers."""
    rows = pairs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return rows.where(uniform(seed, "draw", *key) < F.col(posterior)).drop(posterior)


def one_to_one(pairs: DataFrame, id_a: str, id_b: str, score: str) -> DataFrame:
    """Greedy one-to-one matching by descending score, ties by the smaller ids.

    Rounds of mutual best pairs, each by aggregation: a pair that is best for both its ids is what the greedy order
    would take before any other pair of these ids, so the rounds give the same matching. They end when no pair is left.
    """
    left = pairs.select(id_a, id_b, score).distinct()
    taken = None
    while True:
        rank = F.struct((-F.col(score)).alias("s"), F.col(id_a).alias("a"), F.col(id_b).alias("b"))
        best_a = left.groupBy(id_a).agg(F.min(rank).alias("best_a"))
        best_b = left.groupBy(id_b).agg(F.min(rank).alias("best_b"))
        won = cut(left.join(best_a, id_a).join(best_b, id_b).where((rank == F.col("best_a")) & (rank == F.col("best_b"))).select(id_a, id_b, score))
        if won.isEmpty():
            return won if taken is None else taken
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select(id_a), id_a, "left_anti").join(won.select(id_b), id_b, "left_anti"))


def disappeared(before: DataFrame, after: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """Per group of the earlier vintage: entities at risk and those gone in the later one."""
    gone = before.join(after.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn("__in", F.lit(1)), entity, "left")
    return gone.groupBy(*by).agg(F.count(F.lit(1)).alias("at_risk"), F.count_if(F.col("__in").isNull()).alias("gone"))


def miscoding_rate(disagree: str | Column, moved: str | Column) -> Column:
    """Share of miscoded places per register from the share of linked pairs that disagree: 1 - d = (1 - moved)(1 - 2 e)."""
    d, m = (F.col(x) if isinstance(x, str) else x for x in (disagree, moved))
    return (1 - (1 - d) / F.nullif(1 - m, F.lit(0))) / 2


def unmix_counts(counts: DataFrame, unit: str, n: str, error: float, units: int) -> DataFrame:
    """True counts where a share ``error`` of each unit's records is spread evenly over the other units (closed form)."""
    whole = counts.agg(F.sum(n).alias("__all"))
    leak = error / (units - 1)
    return counts.crossJoin(F.broadcast(whole)).withColumn("unmixed", (F.col(n) - leak * F.col("__all")) / (1 - error - leak)).drop("__all")


def clerical_bootstrap(pairs: DataFrame, pattern: str, fields: int, least: int, draws: int, seed: int) -> DataFrame:
    """Share of pairs linked under ``draws`` resampled sets of fields (with replacement), a pair being linked when its
    resampled agreements reach ``least``: ``draw, n_linked, n_pairs``. Computed from pattern counts."""
    counts = pairs.groupBy(pattern).agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([T.StructField("draw", T.IntegerType()), T.StructField("n_linked", T.LongType()), T.StructField("n_pairs", T.LongType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = (b[pattern].to_numpy()[:, None] >> np.arange(fields)) & 1
            for d in range(draws):
                chosen = np.random.default_rng([seed, d]).integers(0, fields, fields)
                hit = bits[:, chosen].sum(1) >= least
                yield pd.DataFrame({"draw": [d], "n_linked": [int(b["n"].to_numpy()[hit].sum())], "n_pairs": [int(b["n"].sum())]})

    return counts.mapInPandas(draw, schema).groupBy("draw").agg(F.sum("n_linked").alias("n_linked"), F.sum("n_pairs").alias("n_pairs"))
