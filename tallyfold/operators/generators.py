"""Small synthetic worlds with keyed randomness: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyfold.functions.scalars import entity_id, expit, gompertz, monthly, normal, uniform
from tallyfold.operators.aggregates import apportion

#: Kinds of entities in the top byte of an id.
KINDS = {"person": 1, "household": 2, "dwelling": 3, "enterprise": 4, "establishment": 10, "hospital": 5, "job": 6, "encounter": 7, "event": 8}


def numbered(df: DataFrame, kind: str, order: list[str], name: str) -> DataFrame:
    """``df`` with contiguous ids of a kind in an order; ranks are taken range by range, not in one task."""
    from tallyfold.operators.windows import place

    return place(df, [], [F.col(c) for c in order], "__n").withColumn(name, entity_id(KINDS[kind], F.col("__n") - 1)).drop("__n", "__n_of")


def zipf_choice(df: DataFrame, values: int, exponent: float, seed: int, key: list[str], name: str) -> DataFrame:
    """``df`` with a value from 0 by Zipf's law, by inverse distribution over (at most some thousand) cumulative weights."""
    weights = [1 / (i + 1) ** exponent for i in range(values)]
    total, up, edges = sum(weights), 0.0, []
    for w in weights[:-1]:
        up += w / total
        edges.append(up)
    table = df.sparkSession.createDataFrame([(edges,)], "__edges array<double>")
    at = F.size(F.filter("__edges", lambda e: e <= F.col("__u")))
    return df.withColumn("__u", uniform(seed, *key)).crossJoin(F.broadcast(table)).withColumn(name, at).drop("__u", "__edges")


def household_sizes(cells: DataFrame, cell: str, persons: str, seed: int, shares: tuple[float, ...] = (0.3, 0.32, 0.16, 0.14, 0.08)) -> DataFrame:
    """Households whose sizes add up to each cell's persons exactly: ``cell, number, size``; the last household is trimmed."""
    rows = cells.where(F.col(persons) > 0).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col(persons).cast("long"))))
    u = uniform(seed, cell, "number")
    size, up = F.lit(len(shares)), 0.0
    for i, s in enumerate(shares[:-1]):
        up += s
        size = F.when((u < up) & (size == len(shares)), i + 1).otherwise(size) if i else F.when(u < up, 1).otherwise(size)
    rows = rows.withColumn("size", size)
    before = F.coalesce(F.sum("size").over(W.partitionBy(cell).orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__b", before).where(F.col("__b") < F.col(persons)).select(cell, "number", F.least("size", F.col(persons) - F.col("__b")).cast("long").alias("size"))


def replicated(df: DataFrame, count: Column, slot: str = "slot") -> DataFrame:
    """Each row ``count`` times, with its slot from 0; rows with no count vanish."""
    return df.withColumn("__n", count.cast("int")).where(F.col("__n") > 0).withColumn(slot, F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def shifted_category(column: str, n: int, by: Column) -> Column:
    return F.pmod(F.col(column) + by, F.lit(n))


def weighted_sample(df: DataFrame, by: list[str], weight: str, k: int, seed: int, key: list[str]) -> DataFrame:
    """``k`` rows per group without replacement by weight: the smallest exponential priorities."""
    part = W.partitionBy(*by).orderBy(-F.log(uniform(seed, *key)) / F.col(weight), *key)
    return df.where(F.col(weight) > 0).withColumn("__p", F.row_number().over(part)).where(F.col("__p") <= k).drop("__p")


def population_grid(cells: DataFrame, weight: str, total: int) -> DataFrame:
    """Whole persons per cell in proportion to weight, adding up to the total."""
    return apportion(cells.withColumns({"__one": F.lit(1), "__total": F.lit(total)}), ["__one"], ["cell"], weight, "__total", "persons").drop("__one", "__total")


def late_months(probability: Column, seed: int, key: list[str]) -> Column:
    """Months by which an event is reported late: none, or one to three."""
    return F.when(uniform(seed, *key) < probability, 1 + F.floor(uniform(seed + 1, *key) * 3)).otherwise(0)


def monthly_deaths(persons: DataFrame, tick: int, seed: int, a: float, b: float, multiplier: float = 1.0) -> DataFrame:
    """Those who die in a month: Gompertz hazard times frailty (in hundredths) under a multiplier."""
    years = F.floor((F.lit(tick) - F.col("birth_tick")) / 12)
    p = monthly(F.least(F.lit(1.0), gompertz(years, a, b) * F.coalesce(F.col("frailty_centi"), F.lit(100)) / 100), multiplier)
    return persons.where(F.col("is_alive")).where(uniform(seed, F.lit(tick), "truth_person_id") < p)


def monthly_births(persons: DataFrame, tick: int, seed: int, yearly: float) -> DataFrame:
    """Mothers of a month, with the newborn's household, cell, sex and frailty (drawn to the mother's)."""
    years = F.floor((F.lit(tick) - F.col("birth_tick")) / 12)
    mothers = persons.where(F.col("is_alive") & (F.col("sex") == 1) & years.between(18, 44)).where(uniform(seed, F.lit(tick), "truth_person_id") < monthly(F.lit(yearly)))
    z = normal(seed + 7, F.lit(tick), "truth_person_id")
    frailty = F.exp(0.3 * F.log(F.coalesce(F.col("frailty_centi"), F.lit(100)) / 100) + 0.25 * z)
    return mothers.select(
        F.col("truth_person_id").alias("mother_id"), "truth_household_id", "cell", F.lit(tick).alias("birth_tick"),
        (uniform(seed + 3, F.lit(tick), "truth_person_id") < 0.5).cast("int").alias("sex"), F.rint(100 * frailty).cast("int").alias("frailty_centi"),
    )


def monthly_moves(households: DataFrame, seats: DataFrame, shares: DataFrame, tick: int, seed: int, yearly: float) -> DataFrame:
    """Households that move in a month and their destination seat, drawn by the ``shares`` of their origin (``origin, place, share``)."""
    going = households.where(uniform(seed, F.lit(tick), "truth_household_id") < monthly(F.lit(yearly))).withColumn("__u", uniform(seed + 1, F.lit(tick), "truth_household_id"))
    up = W.partitionBy("origin").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = shares.withColumn("__hi", F.sum("share").over(up)).withColumn("__lo", F.col("__hi") - F.col("share"))
    drawn = going.join(F.broadcast(table), (F.col("county") == F.col("origin")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    return drawn.select("truth_household_id", "origin", F.col("place").alias("destination"))


def assign_free(requests: DataFrame, free: DataFrame, by: list[str], order: list[str], slot: str) -> DataFrame:
    """Requests of a place matched to its free slots in order (first come, lowest slot); those beyond capacity have NULL."""
    r = requests.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    f = free.select(*by, slot).withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(slot)))
    return r.join(f, [*by, "__i"], "left").drop("__i")


def empty_households(households: DataFrame, living: DataFrame, key: str) -> DataFrame:
    """Households without a living member, which close."""
    return households.join(living.select(key).distinct(), key, "left_anti")


def scheduled_discharges(encounters: DataFrame, tick: int) -> DataFrame:
    return encounters.where(F.col("is_open") & (F.col("scheduled_end_tick") <= tick))


def residents(persons: DataFrame, households: DataFrame) -> DataFrame:
    """Living residents per occupied dwelling."""
    return persons.where("is_alive").join(households.where("is_active").select("truth_household_id", "truth_dwelling_id"), "truth_household_id").groupBy("truth_dwelling_id").agg(F.count(F.lit(1)).alias("residents"))


def shock_multiplier(month: str | Column, schedule: list[tuple[int, float]]) -> Column:
    """Product of the multipliers scheduled for a month's year, (month - 1) // 12."""
    m = F.col(month) if isinstance(month, str) else month
    year = F.floor((m - 1) / 12)
    return reduce(lambda a, b: a * b, [F.when(year == y, x).otherwise(1.0) for y, x in schedule], F.lit(1.0))


def regional_multiplier(multiplier: Column, loading: Column) -> Column:
    return 1 + loading * (multiplier - 1)


def observed_register(persons: DataFrame, seed: int, coverage: float, name_errors: float, duplicates: float, county: str, counties: int) -> DataFrame:
    """An imperfect register of persons: missed persons, duplicate rows, wrong counties, with a bit mask of the defects."""
    key = ["truth_person_id"]
    seen = persons.where(uniform(seed, *key) < coverage)
    rows = replicated(seen, F.lit(1) + (uniform(seed + 1, *key) < duplicates).cast("int"))
    wrong = uniform(seed + 2, *key, "slot") < expit(F.log(F.lit(name_errors / (1 - name_errors))))
    shift = 1 + F.floor(uniform(seed + 3, *key, "slot") * (counties - 1))
    return rows.withColumns({
        "mechanism_code": F.when(F.col("slot") > 0, 1).otherwise(0).bitwiseOR(F.when(wrong, 2).otherwise(0)),
        "observed_county": F.when(wrong, F.pmod(F.col(county) + shift, F.lit(counties))).otherwise(F.col(county)),
    })


def annual_shocks(spark: SparkSession, years: int, seed: int, probability: float, low: float, high: float) -> DataFrame:
    """``year, multiplier``: a multiplier in [low, high) in shock years, else 1."""
    rows = spark.range(0, years).withColumnRenamed("id", "year")
    return rows.withColumn("multiplier", F.when(uniform(seed, "year") < probability, low + (high - low) * uniform(seed + 1, "year")).otherwise(1.0))


def establishment_churn(establishments: DataFrame, persons: DataFrame, tick: int, seed: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Establishments that close in a month and those that open in their place: ``closed`` (their rows) and ``opened`` with the
    enterprise and industry of the closed one at the cell of a living adult.

    Each is drawn on its own by key; the nth closing is paired with the nth of the living adults in an order by key, so as
    many open as close while there are adults. ``establishments`` has truth_establishment_id, truth_enterprise_id, industry.
    """
    from tallyfold.operators.windows import place

    closed = establishments.where(uniform(seed, F.lit(tick), "truth_establishment_id") < share)
    adults = persons.where(F.col("is_alive") & ((F.lit(tick) - F.col("birth_tick")) >= 216) & F.col("cell").isNotNull()).withColumn("__u", uniform(seed + 1, F.lit(tick), "truth_person_id"))
    numbered_closed = place(closed.withColumn("__v", uniform(seed + 2, F.lit(tick), "truth_establishment_id")), [], ["__v", "truth_establishment_id"], "__n")
    numbered_adults = place(adults, [], ["__u", "truth_person_id"], "__n").select("__n", F.col("cell").alias("new_cell"), F.col("truth_person_id").alias("founder_id"))
    opened = numbered_closed.join(numbered_adults, "__n").select(F.col("truth_establishment_id").alias("replaces"), "truth_enterprise_id", "industry", "new_cell", "founder_id")
    return closed, opened


def household_formation(persons: DataFrame, tick: int, seed: int, yearly: Column, role_child: int = 2) -> DataFrame:
    """Those who leave home in a month, at most one of a household: living, 18 to 30, in the role of a child, in a household of two or more.

    ``yearly`` is the hazard of a row (an expression of covariates). Of several who would leave, the one with the smallest
    draw does: ``truth_person_id, truth_household_id, cell``.
    """
    living = persons.where(F.col("is_alive") & F.col("truth_household_id").isNotNull())
    size = living.groupBy("truth_household_id").agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") >= 2)
    years = F.floor((F.lit(tick) - F.col("birth_tick")) / 12)
    u = uniform(seed, F.lit(tick), "truth_person_id")
    going = living.where(years.between(18, 30) & (F.col("role") == role_child)).where(u < monthly(yearly)).join(size.select("truth_household_id"), "truth_household_id", "left_semi")
    first = going.groupBy("truth_household_id").agg(F.min(F.struct(u.alias("u"), "truth_person_id", "cell")).alias("z"))
    return first.select(F.col("z.truth_person_id").alias("truth_person_id"), "truth_household_id", F.col("z.cell").alias("cell"))


def job_turnover(jobs: DataFrame, persons: DataFrame, tick: int, seed: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Jobs that end in a month and who takes them: ``ended`` (their rows) and ``hired`` (truth_establishment_id, truth_person_id, replaces).

    Jobs are conserved as long as there are living adults without a job: vacancies of establishments left without any job
    are filled first; candidates come in the order of exponential priorities with the root of their education as weight.
    ``jobs`` has truth_job_id, truth_establishment_id, truth_person_id.
    """
    from tallyfold.operators.windows import place

    ended = jobs.where(uniform(seed, F.lit(tick), "truth_job_id") < share)
    staffed = jobs.join(ended.select("truth_job_id"), "truth_job_id", "left_anti").select("truth_establishment_id", F.lit(1).alias("__staffed")).distinct()
    vacancies = ended.join(staffed, "truth_establishment_id", "left").withColumn("__o", F.coalesce("__staffed", F.lit(0)))
    idle = persons.where(F.col("is_alive") & ((F.lit(tick) - F.col("birth_tick")) >= 216)).join(jobs.select("truth_person_id").distinct(), "truth_person_id", "left_anti")
    idle = idle.withColumn("__p", -F.log(uniform(seed + 1, F.lit(tick), "truth_person_id")) / F.sqrt(F.greatest(F.coalesce(F.col("education"), F.lit(0)), F.lit(0)) + 1.0))
    a = place(vacancies, [], ["__o", "truth_job_id"], "__n").select("__n", "truth_establishment_id", F.col("truth_job_id").alias("replaces"))
    b = place(idle, [], ["__p", "truth_person_id"], "__n").select("__n", "truth_person_id")
    return ended, a.join(b, "__n").select("truth_establishment_id", "truth_person_id", "replaces")


def stay_months(days: str | Column) -> Column:
    """Months of a stay given in days: begun months of thirty days, at least one."""
    d = F.col(days) if isinstance(days, str) else days
    return F.greatest(F.lit(1), F.ceil(d / 30)).cast("int")


def newborn_frailty(mother_centi: Column, z: Column, regression: float = 0.3, spread: float = 0.25) -> Column:
    """Frailty in hundredths, lognormal around the mother's drawn to one."""
    return F.rint(100 * F.exp(regression * F.log(F.coalesce(mother_centi, F.lit(100)) / 100) + spread * z)).cast("int")
