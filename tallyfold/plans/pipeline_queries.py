"""Whole chains of operators: a release from a register by the design-based line, month kernels, replay checks, small covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.scalars import age, half_even
from tallyfold.operators import aggregates as agg
from tallyfold.operators import bitemporal as bt
from tallyfold.operators import generators, joins, matching, scoring, survey, windows
from tallyfold.plans.estimate_queries import _FIRSTS, _INCOMES, _first, _incomes
from tallyfold.plans.ledger_queries import _spans
from tallyfold.plans.problems import EVENT, HOUSEHOLD, JOB, PERSON
from tallyfold.plans.register_queries import _D, _P, _Y, deaths, persons, register, yearly
from tallyfold.plans.table_queries import _G, grid
from tallyfold.sources.tables import load, without_codes

# a release from the population register


def design_based_release(spark: SparkSession, d: str) -> DataFrame:
    """Persons by county, state and nation with intervals, from register to release.

    Repeats are dropped (one row per person, the first record), persons counted by reported county, the counts unmixed of
    wrong counties, brought to state benchmarks rounded to tens in proportion to their variance, summed to the levels
    above, and given 90 % intervals.
    """
    rows = register(spark, d, "population", "person_id").where("person_id is not null and county is not null")
    once = agg.keep_first(rows, ["person_id"], ["record_id"])
    counts = once.groupBy("county").agg(F.count(F.lit(1)).alias("n"))
    unmixed = matching.unmix_counts(counts, "county", "n", 0.05, 64).withColumn("unmixed", F.greatest("unmixed", F.lit(0.0)))
    geo = load(spark, d, "geography").select("county", "state")
    bench = persons(spark, d).where("is_alive and state is not null").groupBy("state").agg(half_even(F.count(F.lit(1)), 10).alias("t"))
    county = survey.reconcile(unmixed.join(F.broadcast(geo), "county"), ["state"], "unmixed", "n", bench, "t")
    released = agg.rollup_levels(county, "state", "county", {"estimate": F.sum("reconciled"), "variance": F.sum("n")})
    half = 1.645 * F.sqrt(F.col("variance").cast("double"))
    return released.select("level", "unit", F.round("estimate", 6).alias("estimate"), F.round(F.col("estimate") - half, 6).alias("low"), F.round(F.col("estimate") + half, 6).alias("high"))


def release_checked(spark, d):
    """Rules that the release breaks against the rows it must have, and parents that aren't the sum of their children: rule and number, 0 for all."""
    release = design_based_release(spark, d).withColumn("estimand", F.lit("persons"))
    geo = load(spark, d, "geography").select("county", "state")
    parents = geo.where("state is not null").select(F.lit("county").alias("level"), F.col("county").cast("long").alias("unit"), F.lit("state").alias("parent_level"), F.col("state").cast("long").alias("parent_unit"))
    off = scoring.additivity_violations(release, parents.join(release.select("level", "unit"), ["level", "unit"], "left_semi"), 1e-4)
    inside = release.agg(F.count_if((F.col("low") > F.col("estimate")) | (F.col("high") < F.col("estimate"))).alias("n"))
    return off.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("not additive")).unionByName(inside.withColumn("rule", F.lit("estimate outside")))


# month kernels


def month_closings(spark, d):
    """What one month of establishment churn does to the jobs' establishments: closed, opened, enterprises kept."""
    jobs = _first(spark, d, [6], ["truth_establishment_id", "truth_enterprise_id", "industry"], ["truth_establishment_id", "truth_enterprise_id"]).where("truth_establishment_id is not null")
    places = jobs.groupBy("truth_establishment_id").agg(F.max("truth_enterprise_id").alias("truth_enterprise_id"), F.max("industry").alias("industry"))
    closed, opened = generators.establishment_churn(places, without_codes(load(spark, d, "person"), codes=["cell"]), 30, 41, 0.3)
    both = closed.join(opened.select(F.col("replaces").alias("truth_establishment_id"), F.col("truth_enterprise_id").alias("kept"), F.col("industry").alias("kept_industry")), "truth_establishment_id", "left")
    return both.select("truth_establishment_id", (F.col("kept").eqNullSafe(F.col("truth_enterprise_id")) & F.col("kept_industry").eqNullSafe(F.col("industry"))).alias("same"))


def leaving_home(spark, d):
    """Those who form a household of their own in a month at a high hazard."""
    p = without_codes(load(spark, d, "person"), ids=[HOUSEHOLD], codes=["cell", "role"])
    return generators.household_formation(p, 12, 43, F.lit(0.9))


def month_hires(spark, d):
    """Jobs that end in a month and who takes them."""
    jobs = _first(spark, d, [6], [JOB, "truth_establishment_id", PERSON], [JOB, "truth_establishment_id", PERSON]).where(f"{JOB} is not null and truth_establishment_id is not null")
    jobs = jobs.groupBy(JOB).agg(F.max("truth_establishment_id").alias("truth_establishment_id"), F.max(PERSON).alias(PERSON))
    ended, hired = generators.job_turnover(jobs, without_codes(load(spark, d, "person"), codes=["education"]), 30, 45, 0.02)
    return ended.select(F.col(JOB).alias("replaces"), "truth_establishment_id").join(hired.select("replaces", PERSON), "replaces", "left")


def stay_lengths(spark, d):
    """Stays by begun months of thirty days, the days made of the ticks between admission and scheduled end."""
    rows = without_codes(load(spark, d, "ledger").where("event_type = 10"), ids=["scheduled_end_tick"]).where("scheduled_end_tick >= tick")
    return rows.groupBy(generators.stay_months((F.col("scheduled_end_tick") - F.col("tick")) * 17).alias("months")).agg(F.count_distinct(EVENT).alias("stays"))


# replay


def open_entities(spark, d):
    """Replay of the ledger at tick 30: how many jobs, stays and households it left open, and persons alive."""
    jobs = _spans(spark, d, 6, 7, JOB, PERSON).where("s <= 30 and e > 30").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("jobs"))
    stays = _spans(spark, d, 10, 11, "truth_encounter_id", "truth_hospital_id").where("s <= 30 and e > 30").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("stays"))
    events = _first(spark, d, [3, 5], ["tick", "event_type", HOUSEHOLD], [HOUSEHOLD]).where("tick <= 30")
    opening = load(spark, d, "household").select(HOUSEHOLD, F.col("is_active").alias("open"))
    homes = bt.last_state(events.withColumn("open", F.col("event_type") == 3), HOUSEHOLD, ["tick", EVENT], ["open"], None, opening.where(f"{HOUSEHOLD} is not null"))
    homes = homes.where("open").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("households"))
    born = _first(spark, d, [1], ["tick", PERSON], [PERSON]).where("tick <= 30").select(PERSON)
    alive = load(spark, d, "person").where("is_alive").select(PERSON).unionByName(born).where(f"{PERSON} is not null").distinct()
    gone = deaths(spark, d).where("died <= 30")
    alive = alive.join(gone, PERSON, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("persons"))
    return jobs.unionByName(stays).unionByName(homes).unionByName(alive)


def replay_disagreements(spark, d):
    """Households whose replayed dwelling, all of the ledger counting, is not the one of their last valid event, by an independent fold."""
    moves = _first(spark, d, [3, 4], ["tick", HOUSEHOLD, "truth_dwelling_id"], [HOUSEHOLD, "truth_dwelling_id"])
    a = bt.last_state(moves, HOUSEHOLD, ["tick", EVENT], ["truth_dwelling_id"])
    last = moves.where(f"{HOUSEHOLD} is not null").groupBy(HOUSEHOLD).agg(F.max("tick").alias("tick"))
    b = moves.join(last, [HOUSEHOLD, "tick"]).groupBy(HOUSEHOLD).agg(F.max_by("truth_dwelling_id", EVENT).alias("truth_dwelling_id"))
    return joins.differing(a, b, HOUSEHOLD, ["truth_dwelling_id"]).where("truth_dwelling_id_differs").select(HOUSEHOLD)


# covariates


def urbanity(spark, d):
    """Counties by rank of persons per land cell, from 0 to 1."""
    n = persons(spark, d).where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("n")).join(load(spark, d, "geography").select("county", "land_cells"), "county").where("land_cells > 0")
    return windows.rank_uniform(n.withColumn("density", F.col("n") / F.col("land_cells")), [], "density", "county", "urbanity").select("county", F.round("urbanity", 9).alias("urbanity"))


def oldest_members(spark, d):
    """Registered households by the age of their oldest member."""
    r = register(spark, d, "population", "person_id").where("household_id is not null and birth_tick is not null").withColumn("age", age(F.lit(0), "birth_tick"))
    return r.groupBy("household_id").agg(F.max("age").alias("oldest")).groupBy("oldest").agg(F.count(F.lit(1)).alias("households"))


def register_shortfall(spark, d):
    """How much of each state's living persons the register lacks."""
    geo = load(spark, d, "geography").select("county", "state")
    seen = register(spark, d, "population", "person_id").where("person_id is not null and county is not null").join(geo, "county").where("state is not null").groupBy("state").agg(F.count_distinct("person_id").alias("seen"))
    there = persons(spark, d).where("is_alive and state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("there"))
    return there.join(seen, "state", "left").select("state", F.round(1 - F.coalesce("seen", F.lit(0)) / F.col("there"), 9).alias("shortfall"))


def widened_rows(spark, d):
    """Release rows without and with an age band in one table, the missing keys empty."""
    core = persons(spark, d).where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("n"))
    rate = persons(spark, d).where("county is not null and sex is not null").groupBy("county", "sex").agg(F.count(F.lit(1)).alias("n"))
    return core.unionByName(rate, allowMissingColumns=True)


def county_covariates(spark, d):
    """Counties by rank, from 0 to 1, of persons per land cell, of income per adult and of the share of elders."""
    p = persons(spark, d).where("county is not null and is_alive")
    n = p.groupBy("county").agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("income_cents"), F.lit(0)) / F.greatest(F.count_if(F.col("age") >= 16), F.lit(1))).alias("income"), F.avg((F.col("age") >= 65).cast("int")).alias("elders"))
    n = n.join(load(spark, d, "geography").select("county", "land_cells"), "county").where("land_cells > 0").withColumn("density", F.col("n") / F.col("land_cells"))
    for c in ("density", "income", "elders"):
        n = windows.rank_uniform(n, [], c, "county", f"{c}_rank")
    return n.select("county", *[F.round(f"{c}_rank", 9).alias(f"{c}_rank") for c in ("density", "income", "elders")])


def elder_survival(spark, d):
    """Elders by state: how many there were, person-months lived to the end, and the share that lived to it."""
    rows = persons(spark, d).where("is_alive and state is not null and age >= 65").join(deaths(spark, d), PERSON, "left")
    lived = F.greatest(F.least(F.coalesce(F.col("died") - 1, F.lit(60)), F.lit(60)), F.lit(0))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("elders"), F.sum(lived).alias("months"), F.round(F.avg(F.when(F.col("died") <= 60, 0.0).otherwise(1.0)), 9).alias("survival"))


def outpost_cells(spark, d):
    """Cells of the grid in the top quartile of height."""
    g = grid(spark, d)
    return g.crossJoin(F.broadcast(g.agg(F.percentile("h", F.lit(0.75)).alias("line")))).where("h >= line").select("cell")


def average_regime(spark, d):
    """Death rates by sex and band, averaged over the years with each year alike."""
    y = yearly(spark, d).where("months > 0").withColumn("rate", F.col("deaths") / F.col("months"))
    return y.groupBy("sex", "band").agg(F.round(F.avg("rate"), 10).alias("rate"), F.count(F.lit(1)).alias("years"))


def relative_rows(spark, d):
    """Release rows with half-widths of a tenth of the estimate."""
    r = design_based_release(spark, d).select("level", "unit", "estimate")
    return r.withColumns({"low": F.round(F.col("estimate") * 0.9, 5), "high": F.round(F.col("estimate") * 1.1, 5)})


def calibrated_incomes(spark, d):
    """County means of the register brought to the scale of the population by the line that fits the counties best."""
    a, b = _incomes(spark, d)
    both = a.select("county", F.col("mean").alias("x"), "n").join(b.select("county", F.col("mean").alias("y")), "county")
    line = agg.weighted_line(both, [], F.col("x"), F.col("y"), F.col("n"))
    return both.crossJoin(F.broadcast(line)).select("county", F.round(F.col("intercept") + F.col("slope") * F.col("x"), 2).alias("calibrated"))


QUERIES = {f.__name__: f for f in (
    design_based_release, release_checked, month_closings, leaving_home, month_hires, stay_lengths, open_entities, replay_disagreements, urbanity, oldest_members, register_shortfall, widened_rows,
    county_covariates, elder_survival, outpost_cells, average_regime, relative_rows, calibrated_incomes,
)}

_RELEASE = f"""WITH {_P}, o AS (SELECT nullif(county, -1) AS county FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY record_id) AS k FROM population WHERE nullif(person_id, 0) IS NOT NULL AND nullif(county, -1) IS NOT NULL) WHERE k = 1),
c AS (SELECT county, count(*)::double AS n FROM o GROUP BY 1), u AS (SELECT county, n, greatest((n - 0.05 / 63 * sum(n) OVER ()) / (1 - 0.05 - 0.05 / 63), 0)::double AS u FROM c),
t AS (SELECT state, round_even(count(*) / 10.0::double, 0) * 10 AS t FROM q WHERE is_alive AND state IS NOT NULL GROUP BY 1),
r AS (SELECT u.county, g.state, n, u + coalesce(t - sum(u) OVER (PARTITION BY g.state), 0) * n / sum(n) OVER (PARTITION BY g.state) AS v FROM u JOIN geography g USING (county) LEFT JOIN t ON t.state = g.state),
x AS (SELECT CASE WHEN grouping(state) = 1 THEN 'nation' WHEN grouping(county) = 1 THEN 'state' ELSE 'county' END AS level, CASE WHEN grouping(state) = 1 THEN 0 WHEN grouping(county) = 1 THEN state ELSE county END::bigint AS unit, sum(v) AS e, sum(n) AS n FROM r GROUP BY GROUPING SETS ((), (state), (state, county)))"""

ORACLES = {
    "design_based_release": f"""{_RELEASE}
SELECT level, unit, round(e, 6) AS estimate, round(e - 1.645 * sqrt(n), 6) AS low, round(e + 1.645 * sqrt(n), 6) AS high FROM x""",
    "relative_rows": f"""{_RELEASE}
SELECT level, unit, round(e, 6) AS estimate, round(round(e, 6) * 0.9, 5) AS low, round(round(e, 6) * 1.1, 5) AS high FROM x""",
    "release_checked": "SELECT * FROM (VALUES ('not additive', 0::bigint), ('estimate outside', 0::bigint)) v(rule, n)",
    "stay_lengths": "SELECT greatest(1, ceil((scheduled_end_tick - tick) * 17 / 30.0))::int AS months, count(DISTINCT truth_event_id) AS stays FROM ledger WHERE event_type = 10 AND nullif(scheduled_end_tick, 0) >= tick GROUP BY 1",
    "open_entities": f"""WITH {_FIRSTS}, {_D.replace('first AS', 'first0 AS').replace('FROM first WHERE', 'FROM first0 WHERE').replace('void AS', 'void0 AS').replace('FROM void)', 'FROM void0)')},
j AS (SELECT nullif(truth_job_id, 0) AS k, min(tick) FILTER (WHERE event_type = 6) AS s, coalesce(max(tick) FILTER (WHERE event_type = 7), 1000000) AS e FROM l WHERE event_type IN (6, 7) AND nullif(truth_job_id, 0) IS NOT NULL GROUP BY 1),
t AS (SELECT nullif(truth_encounter_id, 0) AS k, min(tick) FILTER (WHERE event_type = 10) AS s, coalesce(max(tick) FILTER (WHERE event_type = 11), 1000000) AS e FROM l WHERE event_type IN (10, 11) AND nullif(truth_encounter_id, 0) IS NOT NULL GROUP BY 1),
h AS (SELECT k, arg_max(o, (tick, id)) AS o FROM (SELECT nullif(truth_household_id, 0) AS k, tick, truth_event_id AS id, event_type = 3 AS o FROM l WHERE event_type IN (3, 5) AND tick <= 30 AND nullif(truth_household_id, 0) IS NOT NULL
  UNION ALL SELECT truth_household_id, -1000, 0, is_active FROM household WHERE truth_household_id IS NOT NULL) GROUP BY 1),
a AS (SELECT truth_person_id FROM person WHERE is_alive AND truth_person_id IS NOT NULL UNION SELECT truth_person_id FROM l WHERE event_type = 1 AND tick <= 30 AND nullif(truth_person_id, 0) IS NOT NULL)
SELECT 'jobs' AS kind, count(*) AS n FROM j WHERE s <= 30 AND e > 30 UNION ALL SELECT 'stays', count(*) FROM t WHERE s <= 30 AND e > 30 UNION ALL SELECT 'households', count(*) FROM h WHERE o
UNION ALL SELECT 'persons', count(*) FROM a WHERE truth_person_id NOT IN (SELECT truth_person_id FROM deaths WHERE died <= 30)""",
    "replay_disagreements": "SELECT truth_household_id FROM household WHERE false",
    "urbanity": f"""WITH {_P}, n AS (SELECT county, count(*)::double / max(land_cells) AS x FROM q JOIN geography USING (county) WHERE land_cells > 0 GROUP BY 1) SELECT county, round((row_number() OVER (ORDER BY x, county) - 1) / (count(*) OVER () - 1)::double, 9) AS urbanity FROM n""",
    "oldest_members": "SELECT oldest, count(*) AS households FROM (SELECT household_id, max(floor((0 - birth_tick) / 12))::bigint AS oldest FROM population WHERE nullif(household_id, 0) IS NOT NULL AND birth_tick IS NOT NULL GROUP BY 1) GROUP BY 1",
    "register_shortfall": f"""WITH {_P}, s AS (SELECT g.state, count(DISTINCT person_id) AS s FROM population p JOIN geography g ON g.county = nullif(p.county, -1) WHERE nullif(person_id, 0) IS NOT NULL AND g.state IS NOT NULL GROUP BY 1), t AS (SELECT state, count(*) AS t FROM q WHERE is_alive AND state IS NOT NULL GROUP BY 1)
SELECT state, round((1 - coalesce(s, 0) / t)::double, 9) AS shortfall FROM t LEFT JOIN s USING (state)""",
    "widened_rows": f"WITH {_P} SELECT county, NULL::tinyint AS sex, count(*) AS n FROM q WHERE county IS NOT NULL GROUP BY 1 UNION ALL SELECT county, sex, count(*) FROM q WHERE county IS NOT NULL AND sex IS NOT NULL GROUP BY 1, 2",
    "county_covariates": f"""WITH {_P}, n AS (SELECT county, count(*) / max(land_cells)::double AS d, coalesce(sum(income_cents), 0) / greatest(count(*) FILTER (WHERE age >= 16), 1)::double AS i, avg((age >= 65)::int) AS e FROM q JOIN geography g USING (county) WHERE is_alive AND land_cells > 0 GROUP BY 1)
SELECT county, {", ".join(f"round(CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 0.5 ELSE (row_number() OVER (ORDER BY {c}, county) - 1) / (count(*) OVER () - 1)::double END, 9) AS {n}_rank" for c, n in (("d", "density"), ("i", "income"), ("e", "elders")))} FROM n""",
    "elder_survival": f"""WITH {_P}, {_D} SELECT state, count(*) AS elders, sum(greatest(least(coalesce(died - 1, 60), 60), 0))::bigint AS months, round(avg(CASE WHEN died <= 60 THEN 0.0 ELSE 1.0 END)::double, 9) AS survival
FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND state IS NOT NULL AND age >= 65 GROUP BY 1""",
    "outpost_cells": f"WITH {_G} SELECT cell FROM g WHERE h >= (SELECT quantile_cont(h, 0.75) FROM g)",
    "average_regime": f"WITH {_P}, {_D}, {_Y} SELECT sex, band, round(avg(deaths / months), 10) AS rate, count(*) AS years FROM y WHERE months > 0 GROUP BY 1, 2",
    "calibrated_incomes": f"""WITH {_INCOMES}, j AS (SELECT county, x, y, n::double AS n FROM x JOIN y USING (county)), s AS (SELECT sum(n) AS w, sum(n * x) AS wx, sum(n * y) AS wy, sum(n * x * x) AS wxx, sum(n * x * y) AS wxy FROM j),
l AS (SELECT (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b, w, wx, wy FROM s) SELECT county, round((wy - b * wx) / w + b * x, 2) AS calibrated FROM j, l""",
}
