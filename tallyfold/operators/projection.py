"""Cohort projection, stock advance, discounted flows and simulated members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.scalars import discount
from tallyfold.session import cut, sent_by_value

sent_by_value(__name__)
OPEN_AGE = 110


def advance_year(cube: DataFrame, by: list[str], survival: DataFrame, fertility: float, mothers: tuple[int, int] = (18, 45)) -> DataFrame:
    """One year on: ``*by, age, sex, n``. Survivors age by one, the open age keeps its own, births to women of childbearing
    age enter at zero, half of each sex (0 male, 1 female). ``survival`` has age, sex, p."""
    alive = cube.join(F.broadcast(survival), ["age", "sex"]).select(*by, F.least(F.col("age") + 1, F.lit(OPEN_AGE)).alias("age"), "sex", (F.col("n") * F.col("p")).alias("n"))
    born = cube.where((F.col("sex") == 1) & F.col("age").between(*mothers)).groupBy(*by).agg((F.sum("n") * fertility / 2).alias("n"))
    babies = born.select(*by, F.lit(0).alias("age"), F.explode(F.array(F.lit(0), F.lit(1))).alias("sex"), "n")
    return alive.unionByName(babies).groupBy(*by, "age", "sex").agg(F.sum("n").alias("n"))


def project(cube: DataFrame, by: list[str], survival: DataFrame, fertility: float, years: int) -> DataFrame:
    """``years`` steps of ``advance_year`` over cells (regions times ages times sexes); lineage is cut every fourth step."""
    for y in range(years):
        cube = advance_year(cube, by, survival, fertility)
        if y % 4 == 3:
            cube = cut(cube)
    return cube


def advance_month(cells: DataFrame, by: list[str], band: str, n: str, next_band: DataFrame, share: float = 1 / 12) -> DataFrame:
    """A month on for banded stocks: ``share / width`` of a band moves to the next one (``next_band``: band, next, width)."""
    moved = cells.join(F.broadcast(next_band), band)
    steps = F.array(
        F.struct(F.col(band).alias("b"), (F.col(n) * (1 - F.when(F.col("next").isNotNull(), share / F.col("width")).otherwise(0.0))).alias("n")),
        F.struct(F.col("next").alias("b"), (F.col(n) * share / F.col("width")).alias("n")),
    )
    out = moved.select(*by, F.explode(steps).alias("z")).where(F.col("z.b").isNotNull())
    return out.groupBy(*by, F.col("z.b").alias(band)).agg(F.sum("z.n").alias(n))


def present_value(flows: DataFrame, by: list[str], month: str, flow: str, yearly_rate: float, name: str = "present_value") -> DataFrame:
    return flows.groupBy(*by).agg(F.sum(F.col(flow) * discount(month, yearly_rate)).alias(name))


def simulate_members(regions: DataFrame, region: str, mean: str, spread: str, members: int, seed: int, chunk: int = 128) -> DataFrame:
    """``member, region, loss``: lognormal parameter noise shared by a member, Poisson process noise per region.

    Members are dealt out in chunks; each member's random numbers depend on seed, member and region alone.
    """
    spark = regions.sparkSession
    kind = regions.schema[region].dataType.simpleString()
    rows = regions.select(F.col(region).alias("r"), F.col(mean).cast("double").alias("m"), F.col(spread).cast("double").alias("s"))
    grid = rows.crossJoin(F.broadcast(spark.range(0, -(-members // chunk), 1).withColumnRenamed("id", "c")))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, m, s, c in zip(b["r"], b["m"], b["s"], b["c"], strict=True):
                ids = np.arange(c * chunk, min((c + 1) * chunk, members))
                level = np.array([np.random.default_rng([seed, int(i)]).standard_normal() for i in ids])
                rate = m * np.exp(s * level - s * s / 2)
                loss = [np.random.default_rng([seed, int(i), int(r) & (2**63 - 1)]).poisson(max(x, 0.0)) for i, x in zip(ids, rate, strict=True)]
                yield pd.DataFrame({"member": ids, "region": r, "loss": np.array(loss, float)})

    return grid.repartition("c").mapInPandas(draw, f"member bigint, region {kind}, loss double").withColumnRenamed("region", region)


def redraw_flags(members: int, years: list[int], probability: float, seed: int, spark) -> DataFrame:
    """``member, year, shock``: which futures see a shock in which year, keyed by member and year."""
    from tallyfold.functions.scalars import uniform

    grid = spark.range(0, members).withColumnRenamed("id", "member").withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return grid.withColumn("shock", uniform(seed, "member", "year") < probability)
