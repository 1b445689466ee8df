"""More queries over the ledger and registers: stocks over time, residence, classes, flags, posteriors, pseudonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.scalars import edge_index, flags, namespace, uniform
from tallyfold.operators import bitemporal as bt
from tallyfold.operators import deliveries, generators, joins, matching, survey
from tallyfold.operators.rates import loading_posterior
from tallyfold.plans.problems import EVENT, HOUSEHOLD, JOB, MOVED, PERSON, VOIDS, first_events
from tallyfold.plans.register_queries import _D, _P, _pairs, deaths, persons, register
from tallyfold.sources.files import pseudonym
from tallyfold.sources.tables import load, without_codes

LAST = 60


def _spans(spark, d, opened, closed, key, group):
    """One span per ``key`` from its valid opening to its valid closing event (open: beyond the last month)."""
    ledger = load(spark, d, "ledger")
    first = first_events(ledger, [opened, closed], ["tick", "event_type", key, group], [key, group])
    live = deliveries.not_withdrawn(first, deliveries.withdrawals(ledger, EVENT, VOIDS), EVENT).where(F.col(key).isNotNull())
    at = lambda kind, f: f(F.when(F.col("event_type") == kind, F.col("tick")))
    return live.groupBy(key).agg(F.max(group).alias(group), at(opened, F.min).alias("s"), F.coalesce(at(closed, F.max), F.lit(10**6)).alias("e")).where("s is not null")


def bed_occupancy(spark, d):
    """Open stays per hospital and month, after each month's events."""
    spans = _spans(spark, d, 10, 11, "truth_encounter_id", "truth_hospital_id").where("truth_hospital_id is not null")
    return bt.month_counts(spans, ["truth_hospital_id"], F.col("s"), F.col("e"), 1, LAST, "tick", "open_stays")


def job_stock(spark, d):
    """Jobs started and not yet ended per establishment and month."""
    spans = _spans(spark, d, 6, 7, JOB, "truth_establishment_id").where("truth_establishment_id is not null")
    return bt.month_counts(spans, ["truth_establishment_id"], F.col("s"), F.col("e"), 1, LAST, "tick", "jobs")


def residence_months(spark, d):
    """Household-months per county: every household is charged to where it lives after each month's moves."""
    ledger = load(spark, d, "ledger")
    rows = without_codes(ledger.where(F.col("event_type") == MOVED), codes=["to_cell"])
    first = deliveries.first_deliveries(rows, EVENT, "recorded_tick", ["tick", HOUSEHOLD, "to_cell"])
    live = deliveries.not_withdrawn(first, deliveries.withdrawals(ledger, EVENT, VOIDS), EVENT).where(f"to_cell is not null and {HOUSEHOLD} > 0")
    base = without_codes(load(spark, d, "household"), codes=["cell"]).where(f"cell is not null and {HOUSEHOLD} is not null").select(HOUSEHOLD, F.col("cell").alias("to_cell"))
    known = live.join(base.select(HOUSEHOLD), HOUSEHOLD, "left_semi")
    spans = bt.residence_spans(known, HOUSEHOLD, "tick", EVENT, "to_cell", base).withColumn("county", F.floor(F.col("to_cell") / 256))
    months = bt.month_counts(spans, ["county"], F.coalesce("since", F.lit(1)), F.coalesce("until", F.lit(LAST + 1)), 1, LAST, "tick", "n")
    return months.groupBy("county").agg(F.sum("n").alias("months"))


def household_sizes(spark, d):
    """Households by size class (edges 2, 4, 6)."""
    n = load(spark, d, "person").where(f"{HOUSEHOLD} is not null").groupBy(HOUSEHOLD).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(edge_index("n", [2, 4, 6]).alias("size_class")).agg(F.count(F.lit(1)).alias("households"))


def id_kinds(spark, d):
    return load(spark, d, "ledger").groupBy("event_type", namespace("truth_entity_id").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def missing_flags(spark, d):
    """Register rows by which of their fields are missing, as a bit mask."""
    r = register(spark, d, "population", "person_id")
    mask = flags(given=F.col("given_code").isNull(), family=F.col("family_code").isNull(), sex=F.col("sex").isNull(), county=F.col("county").isNull(), household=F.col("household_id").isNull())
    return r.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def pseudonyms(spark, d):
    return load(spark, d, "person").where(f"{PERSON} is not null").select(PERSON, pseudonym(PERSON, "salt").alias("pseudonym"))


def overlaid_register(spark, d):
    """The earlier snapshot with the rows of every taxpayer in the later one replaced, as counts per county."""
    a, b = (register(spark, d, n, "taxpayer_id").where("taxpayer_id is not null") for n in ("income_preliminary", "income"))
    return joins.overlay(a, ["taxpayer_id"], b).groupBy("county").agg(F.count(F.lit(1)).alias("n"))


def kept_keys(spark, d):
    """Taxpayers in both snapshots."""
    a, b = (register(spark, d, n, "taxpayer_id").where("taxpayer_id is not null").select("taxpayer_id") for n in ("income_preliminary", "income"))
    return a.intersect(b)


def posterior_mortality(spark, d):
    """Posterior means of the Gompertz level and slope over a grid."""
    rows = persons(spark, d).where("is_alive and sex is not null and age between 40 and 100").join(deaths(spark, d), PERSON, "left")
    cells = rows.groupBy("sex", "age").agg(F.count("died").alias("d"), F.count(F.lit(1)).alias("e"))
    grid = spark.createDataFrame([(-9.0 + 0.25 * i, 0.04 + 0.01 * j) for i in range(17) for j in range(9)], "a double, b double")
    line = F.col("a") + F.col("b") * F.col("age")
    fits = cells.crossJoin(F.broadcast(grid)).groupBy("sex", "a", "b").agg(F.sum(F.col("d") * line - F.col("e") * F.exp(line)).alias("fit"))
    post = survey.posterior_grid(fits, ["sex"])
    return post.groupBy("sex").agg(F.round(F.sum(F.col("weight") * F.col("a")), 5).alias("a"), F.round(F.sum(F.col("weight") * F.col("b")), 6).alias("b"))


def shock_loadings(spark, d):
    """How strongly each state's deaths of the third year rose against its own mean, as loadings on a shock of 1.3."""
    rows = persons(spark, d).where("is_alive and state is not null").join(deaths(spark, d), PERSON, "left").where("died between 1 and 60")
    y = rows.groupBy("state", F.floor((F.col("died") - 1) / 12).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    s = y.groupBy("state").agg((F.sum(F.when(F.col("y") == 2, F.col("n"))) / F.avg("n")).alias("lift"), (1 / F.avg("n")).alias("variance"))
    return loading_posterior(s.where("lift is not null"), "state", "lift", "variance", 1.3, [0.1 * i for i in range(31)]).select("state", F.round("loading", 6).alias("loading"))


def imputed_links(spark, d):
    """Five imputations of which candidate pairs are links."""
    rated = matching.link_posteriors(_pairs(spark, d), "pattern", 3)
    return matching.sampled_links(rated, ["id_a", "id_b"], "posterior", 5, 17).groupBy("draw").agg(F.count(F.lit(1)).alias("links"))


def simulated_register(spark, d):
    """An imperfect register cut from the persons, rows by defect mask."""
    return generators.observed_register(persons(spark, d).where("county is not null"), 3, 0.95, 0.05, 0.02, "county", 64).groupBy("mechanism_code").agg(F.count(F.lit(1)).alias("n"))


def admitted_to_beds(spark, d):
    """The admissions of every month matched to the beds of their hospital, as many as its largest bed number, first come first served."""
    ledger = load(spark, d, "ledger")
    asked = first_events(ledger, [10], ["tick", "truth_hospital_id"], ["truth_hospital_id"]).where("truth_hospital_id is not null")
    sizes = ledger.where("truth_hospital_id > 0").groupBy("truth_hospital_id").agg(F.coalesce(F.max("bed_number"), F.lit(0)).alias("beds"))
    months = asked.select("truth_hospital_id", "tick").distinct().join(sizes, "truth_hospital_id").where("beds > 0")
    free = months.withColumn("bed", F.explode(F.sequence(F.lit(1), F.col("beds"))))
    return generators.assign_free(asked, free, ["truth_hospital_id", "tick"], [EVENT], "bed").select(EVENT, "bed")


def survey_halves(spark, d):
    """Households in two keyed halves."""
    h = load(spark, d, "household").where(f"{HOUSEHOLD} is not null")
    return h.groupBy((uniform(21, HOUSEHOLD) < 0.5).alias("half")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    bed_occupancy, job_stock, residence_months, household_sizes, id_kinds, missing_flags, pseudonyms, overlaid_register, kept_keys, posterior_mortality, shock_loadings, imputed_links,
    simulated_register, admitted_to_beds, survey_halves,
)}


def _span_sql(opened: int, closed: int, key: str, group: str, name: str) -> str:
    return f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick, (nullif({key}, 0) IS NULL)::int + (nullif({group}, 0) IS NULL)::int) AS place FROM ledger WHERE event_type IN ({opened}, {closed})) WHERE place = 1),
s AS (SELECT {key} AS k, max(nullif({group}, 0)) AS g, min(tick) FILTER (WHERE event_type = {opened}) AS s, coalesce(max(tick) FILTER (WHERE event_type = {closed}), 1000000) AS e FROM f
  WHERE {key} <> 0 AND truth_event_id NOT IN (SELECT supersedes_event_id FROM ledger WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id) GROUP BY 1)
SELECT g AS {group}, m AS tick, count(*) AS {name} FROM s, range(1, 61) t(m) WHERE g IS NOT NULL AND s <= m AND m < e GROUP BY 1, 2"""


_BOTH = """a AS (SELECT *, nullif(taxpayer_id, 0) AS t FROM income_preliminary WHERE nullif(taxpayer_id, 0) IS NOT NULL), b AS (SELECT *, nullif(taxpayer_id, 0) AS t FROM income WHERE nullif(taxpayer_id, 0) IS NOT NULL)"""

ORACLES = {
    "bed_occupancy": _span_sql(10, 11, "truth_encounter_id", "truth_hospital_id", "open_stays"),
    "job_stock": _span_sql(6, 7, "truth_job_id", "truth_establishment_id", "jobs"),
    "residence_months": """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick, (nullif(truth_household_id, 0) IS NULL)::int + (nullif(to_cell, -1) IS NULL)::int) AS place FROM ledger WHERE event_type = 4) WHERE place = 1),
c AS (SELECT truth_household_id AS h, tick, arg_max(to_cell, truth_event_id) AS cell FROM f WHERE to_cell >= 0 AND truth_household_id > 0 AND truth_event_id NOT IN (SELECT supersedes_event_id FROM ledger WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id)
  AND truth_household_id IN (SELECT truth_household_id FROM household WHERE cell >= 0) GROUP BY 1, 2 UNION ALL SELECT truth_household_id, -1000, cell FROM household WHERE cell >= 0 AND truth_household_id IS NOT NULL),
s AS (SELECT h, cell, greatest(tick, 1) AS s, least(coalesce(lead(tick) OVER (PARTITION BY h ORDER BY tick), 61), 61) AS e FROM c)
SELECT floor(cell / 256)::bigint AS county, sum(e - s)::bigint AS months FROM s WHERE e > s GROUP BY 1""",
    "household_sizes": "SELECT (n >= 2)::int + (n >= 4)::int + (n >= 6)::int AS size_class, count(*) AS households FROM (SELECT count(*) AS n FROM person WHERE truth_household_id IS NOT NULL GROUP BY truth_household_id) GROUP BY 1",
    "id_kinds": "SELECT event_type, truth_entity_id >> 56 AS kind, count(*) AS n FROM ledger GROUP BY 1, 2",
    "missing_flags": """SELECT (nullif(given_code, 0) IS NULL)::int + 2 * (nullif(family_code, 0) IS NULL)::int + 4 * (nullif(sex, -1) IS NULL)::int + 8 * (nullif(county, -1) IS NULL)::int + 16 * (nullif(household_id, 0) IS NULL)::int AS mask, count(*) AS n FROM population GROUP BY 1""",
    "pseudonyms": "SELECT truth_person_id, sha256('salt:' || truth_person_id) AS pseudonym FROM person WHERE truth_person_id IS NOT NULL",
    "kept_keys": f"WITH {_BOTH} SELECT t AS taxpayer_id FROM a INTERSECT SELECT t FROM b",
    "overlaid_register": f"WITH {_BOTH} SELECT nullif(county, -1) AS county, count(*) AS n FROM (SELECT county, t FROM a WHERE t NOT IN (SELECT t FROM b) UNION ALL SELECT county, t FROM b) GROUP BY 1",
    "posterior_mortality": f"""WITH {_P}, {_D}, t AS (SELECT sex, age, count(died)::double AS d, count(*)::double AS e FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND age BETWEEN 40 AND 100 GROUP BY 1, 2),
f AS (SELECT sex, (-9 + 0.25 * i)::double AS a, (0.04 + 0.01 * j)::double AS b, sum(d * (-9 + 0.25 * i + (0.04 + 0.01 * j) * age)::double - e * exp((-9 + 0.25 * i + (0.04 + 0.01 * j) * age)::double)) AS fit FROM t, range(0, 17) x(i), range(0, 9) y(j) GROUP BY 1, 2, 3),
w AS (SELECT *, exp(fit - max(fit) OVER (PARTITION BY sex)) AS w FROM f) SELECT sex, round(sum(w * a) / sum(w), 5) AS a, round(sum(w * b) / sum(w), 6) AS b FROM w GROUP BY 1""",
    "admitted_to_beds": """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick, (nullif(truth_hospital_id, 0) IS NULL)::int + (tick IS NULL)::int) AS place FROM ledger WHERE event_type = 10) WHERE place = 1),
b AS (SELECT truth_hospital_id, coalesce(max(bed_number), 0) AS beds FROM ledger WHERE truth_hospital_id > 0 GROUP BY 1),
r AS (SELECT truth_event_id, truth_hospital_id, row_number() OVER (PARTITION BY truth_hospital_id, tick ORDER BY truth_event_id) AS k FROM f WHERE truth_hospital_id <> 0)
SELECT truth_event_id, CASE WHEN k <= beds THEN k END::int AS bed FROM r LEFT JOIN b USING (truth_hospital_id)""",
}
