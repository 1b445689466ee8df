"""Queries over persons, households, registers and the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.scalars import RATE_BANDS, RELEASE_BANDS, age, band, uniform
from tallyfold.operators import aggregates as agg
from tallyfold.operators import bitemporal as bt
from tallyfold.operators import joins, matching, survey, windows
from tallyfold.operators.rates import credibility, deviations, rates, stratified_trend, year_effects
from tallyfold.plans.problems import DWELLING, EVENT, FORMED, HOUSEHOLD, MOVED, PERSON, VOIDS, first_events
from tallyfold.sources.tables import known, load, without_codes

NOW, MONTHS = 30, 60
DIED = 2


def persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons alive before tick 1 with county, state and age."""
    p = without_codes(load(spark, d, "person"), ids=["income_cents"], codes=["cell", "sex", "education"])
    p = p.withColumn("county", F.floor(F.col("cell") / 256).cast("int")).withColumn("age", age(F.lit(0), "birth_tick"))
    return p.join(F.broadcast(load(spark, d, "geography").select("county", "state")), "county", "left")


_P = """p AS (SELECT truth_person_id, truth_household_id, nullif(sex, -1) AS sex, nullif(education, -1) AS education, nullif(income_cents, 0) AS income_cents, birth_tick, is_alive,
  floor(nullif(cell, -1) / 256)::int AS county, floor((0 - birth_tick) / 12)::bigint AS age FROM person),
q AS (SELECT p.*, g.state FROM p LEFT JOIN geography g USING (county))"""


def _band_sql(c: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{label}'" for label, lo, hi in bands) + " END"


def hierarchy_rollup(spark, d):
    rows = persons(spark, d)
    adult = F.col("age") >= 16
    return agg.rollup_levels(rows, "state", "county", {
        "persons": F.count(F.lit(1)), "households": F.count_distinct("truth_household_id"), "children": F.count_if(F.col("age") < 16), "elders": F.count_if(F.col("age") >= 65),
        "median_income": F.median(F.when(adult, F.col("income_cents"))), "mean_income": F.round(F.avg(F.when(adult, F.col("income_cents"))), 4),
        "tertiary_share": F.round(F.avg(F.when((F.col("age") >= 25) & F.col("education").isNotNull(), (F.col("education") >= 3).cast("int"))), 8),
    })


def low_income_share(spark, d):
    """Households under 0.6 of the national median, at every level against the same line."""
    h = persons(spark, d).groupBy("state", "county", "truth_household_id").agg(F.sum("income_cents").alias("income")).where(F.col("income").isNotNull())
    line = h.agg((0.6 * F.median("income")).alias("line"))
    low = h.crossJoin(F.broadcast(line)).withColumn("low", (F.col("income") < F.col("line")).cast("int"))
    return agg.rollup_levels(low, "state", "county", {"households": F.count(F.lit(1)), "low_income_share": F.round(F.avg("low"), 8)})


def age_band_cube(spark, d):
    cube = persons(spark, d).withColumn("band", band("age", RATE_BANDS)).where("sex is not null and county is not null").groupBy("county", "band", "sex").agg(F.count(F.lit(1)).alias("n"))
    bands = spark.createDataFrame([(b[0],) for b in RATE_BANDS], "band string")
    sexes = load(spark, d, "person").select(known("sex", -1).alias("sex")).where("sex is not null").distinct()
    return agg.densify(cube, [load(spark, d, "geography").select("county"), bands, sexes], {"n": 0})


def release_band_counts(spark, d):
    return persons(spark, d).withColumn("band", band("age", RELEASE_BANDS)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def deaths(spark, d):
    """Effective deaths, one per person: ``truth_person_id, died``."""
    ledger = load(spark, d, "ledger")
    first = first_events(ledger, [DIED], ["tick", PERSON], [PERSON])
    from tallyfold.operators import deliveries

    live = deliveries.not_withdrawn(first, deliveries.withdrawals(ledger, EVENT, VOIDS), EVENT)
    return live.where(F.col(PERSON).isNotNull()).groupBy(PERSON).agg(F.min("tick").alias("died"))


_D = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick,
    (nullif(truth_person_id, 0) IS NULL)::int + (nullif(truth_household_id, 0) IS NULL)::int + (nullif(truth_dwelling_id, 0) IS NULL)::int
    + (nullif(truth_hospital_id, 0) IS NULL)::int + (nullif(from_cell, -1) IS NULL)::int + (nullif(to_cell, -1) IS NULL)::int + (nullif(diagnosis_group, -1) IS NULL)::int) AS place FROM ledger) WHERE place = 1),
void AS (SELECT DISTINCT supersedes_event_id AS id FROM ledger WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id),
deaths AS (SELECT truth_person_id, min(tick) AS died FROM first WHERE event_type = 2 AND truth_person_id <> 0 AND truth_event_id NOT IN (SELECT id FROM void) GROUP BY 1)"""


def exposure(spark, d):
    """Person-months alive and deaths by county, sex and age band at the start."""
    rows = persons(spark, d).where("is_alive and sex is not null and county is not null").join(deaths(spark, d), PERSON, "left").withColumn("band", band("age"))
    months = F.least(F.coalesce(F.col("died") - 1, F.lit(MONTHS)), F.lit(MONTHS))
    return rows.groupBy("state", "county", "sex", "band").agg(F.sum(F.greatest(months, F.lit(0))).alias("months"), F.count("died").alias("deaths"))


_E = f"""e AS (SELECT q.state, q.county, q.sex, {_band_sql('q.age', RATE_BANDS)} AS band, sum(greatest(least(coalesce(died - 1, 60), 60), 0))::bigint AS months, count(died) AS deaths
  FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND county IS NOT NULL GROUP BY ALL)"""


def exposure_months(spark, d):
    """Persons alive per month, county and sex: the state after each month's events."""
    rows = persons(spark, d).where("is_alive and sex is not null and county is not null").join(deaths(spark, d), PERSON, "left")
    return bt.month_counts(rows, ["county", "sex"], F.lit(1), F.coalesce("died", F.lit(10**6)), 1, MONTHS, "tick", "alive")


def death_rates(spark, d):
    out = rates(exposure(spark, d), [["state", "sex", "band"], ["county"]], "deaths", "months")
    return out.withColumn("rate", F.round(F.col("rate") * 12, 9))


def credible_rates(spark, d):
    return credibility(exposure(spark, d), "county", "deaths", "months").select("county", F.round("rate", 9).alias("rate"), F.round("weight", 6).alias("weight"), F.round("credible_rate", 9).alias("credible_rate"))


def county_deviations(spark, d):
    return deviations(exposure(spark, d), "county", "state", "deaths", "months", 25.0).select("county", "state", F.round("deviation", 8).alias("deviation"), F.round("rate", 9).alias("rate"))


def yearly(spark, d):
    """Deaths and person-months by sex, band and year."""
    rows = persons(spark, d).where("is_alive and sex is not null").join(deaths(spark, d), PERSON, "left").withColumn("band", band("age"))
    stock = bt.month_counts(rows, ["sex", "band"], F.lit(1), F.coalesce("died", F.lit(10**6)), 1, MONTHS, "tick", "n")
    months = stock.groupBy("sex", "band", F.floor((F.col("tick") - 1) / 12).alias("year")).agg(F.sum("n").alias("months"))
    died = rows.where(F.col("died").between(1, MONTHS)).groupBy("sex", "band", F.floor((F.col("died") - 1) / 12).alias("year")).agg(F.count(F.lit(1)).alias("deaths"))
    return months.join(died, ["sex", "band", "year"], "left").na.fill(0, ["deaths"])


_Y = f"""a AS (SELECT sex, {_band_sql('age', RATE_BANDS)} AS band, died FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL),
y AS (SELECT sex, band, ((m - 1) // 12) AS year, count(*) FILTER (WHERE died IS NULL OR m < died) AS months, count(*) FILTER (WHERE died = m) AS deaths
  FROM a, range(1, 61) t(m) GROUP BY ALL HAVING count(*) FILTER (WHERE died IS NULL OR m < died) > 0)"""


def experience_history(spark, d):
    return yearly(spark, d)


def mortality_year_effects(spark, d):
    return year_effects(yearly(spark, d), ["sex", "band"], "year", "deaths", "months").select("year", F.round("effect", 8).alias("effect"))


def mortality_trend(spark, d):
    return stratified_trend(yearly(spark, d), ["sex", "band"], "year", "deaths", "months").select(F.round("trend", 8).alias("trend"))


def life_table(spark, d):
    """Survival to the end of each age, by sex, from deaths over 60 months."""
    rows = persons(spark, d).where("is_alive and sex is not null and age between 0 and 110").join(deaths(spark, d), PERSON, "left")
    q = rows.groupBy("sex", "age").agg((F.count("died") / F.count(F.lit(1))).alias("q"))
    return q.select("sex", "age", F.round(windows.running_product(1 - F.col("q"), ["sex"], "age"), 8).alias("survival"))


def gompertz_fit(spark, d):
    rows = persons(spark, d).where("is_alive and sex is not null and age between 40 and 100").join(deaths(spark, d), PERSON, "left")
    cells = rows.groupBy("sex", "age").agg(F.count("died").alias("deaths"), F.count(F.lit(1)).alias("n"))
    grid_a, grid_b = [-9.0 + 0.25 * i for i in range(17)], [0.04 + 0.01 * i for i in range(9)]
    return survey.gompertz_grid(cells, ["sex"], "age", "deaths", "n", grid_a, grid_b).select("sex", "a", F.round("b", 4).alias("b"), F.round("fit", 5).alias("fit"))


def supersede_filter(spark, d):
    ledger = load(spark, d, "ledger")
    return bt.effective(ledger.select(EVENT, VOIDS, "event_type", "tick"), EVENT, VOIDS).groupBy("event_type").agg(F.count_distinct(EVENT).alias("events"), F.max("tick").alias("last_tick"))


def visible_events(spark, d):
    seen = bt.visible_at(load(spark, d, "ledger"), "recorded_tick", NOW)
    return seen.groupBy("event_type", "tick").agg(F.count_distinct(EVENT).alias("events"))


def late_share(spark, d):
    late = (F.col("recorded_tick") > F.col("tick")).cast("int")
    return load(spark, d, "ledger").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(late), 8).alias("late_share"), F.max(F.col("recorded_tick") - F.col("tick")).alias("latest"))


def _moves(spark, d):
    ledger = load(spark, d, "ledger")
    ids = [HOUSEHOLD, DWELLING]
    rows = without_codes(ledger.where(F.col("event_type").isin(FORMED, MOVED)), ids=ids, codes=["to_cell"])
    return ledger, rows.select(EVENT, VOIDS, "tick", "recorded_tick", HOUSEHOLD, DWELLING, "to_cell")


def _household_state(spark, d, vintage):
    from tallyfold.operators import deliveries

    ledger, _ = _moves(spark, d)
    seen = ledger if vintage is None else bt.visible_at(ledger, "recorded_tick", vintage)
    first = first_events(seen, [FORMED, MOVED], ["tick", HOUSEHOLD, DWELLING], [HOUSEHOLD, DWELLING])
    live = deliveries.not_withdrawn(first, deliveries.withdrawals(seen, EVENT, VOIDS), EVENT)
    base = load(spark, d, "household").select(HOUSEHOLD, DWELLING)
    return bt.last_state(live, HOUSEHOLD, ["tick", EVENT], [DWELLING], F.col("tick") <= NOW, base)


def state_at(spark, d):
    """Dwelling of every household at a tick, all corrections of the ledger counting."""
    return _household_state(spark, d, None)


def recorded_state_diff(spark, d):
    """Households whose recorded dwelling at a vintage differs from the exact one."""
    both = joins.differing(_household_state(spark, d, NOW), _household_state(spark, d, None), HOUSEHOLD, [DWELLING])
    return both.where(f"{DWELLING}_differs").select(HOUSEHOLD)


def _state_sql(vintage: str) -> str:
    cond = f"AND recorded_tick <= {vintage}" if vintage else ""
    return f"""(WITH l AS (SELECT * FROM ledger WHERE true {cond}),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick, (nullif(truth_household_id, 0) IS NULL)::int + (nullif(truth_dwelling_id, 0) IS NULL)::int) AS place FROM l) WHERE place = 1),
  e AS (SELECT truth_household_id, coalesce(nullif(truth_dwelling_id, 0), -1) AS dw, tick, truth_event_id FROM f WHERE event_type IN (3, 4) AND tick <= 30 AND truth_household_id <> 0
    AND truth_event_id NOT IN (SELECT supersedes_event_id FROM l WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id)
    UNION ALL SELECT truth_household_id, coalesce(truth_dwelling_id, -1), -1000, 0 FROM household WHERE truth_household_id IS NOT NULL)
  SELECT truth_household_id, nullif(arg_max(dw, (tick, truth_event_id)), -1) AS truth_dwelling_id FROM e GROUP BY 1)"""


def asof_lookup(spark, d):
    """Dwelling at the tick of each admission, of the household its patient opened in (before any move: the opening one)."""
    ledger, moves = _moves(spark, d)
    facts = ledger.where("event_type = 10 and truth_person_id > 0").groupBy(EVENT).agg(F.min("tick").alias("at"), F.max(PERSON).alias(PERSON))
    facts = facts.join(load(spark, d, "person").select(PERSON, HOUSEHOLD), PERSON).join(load(spark, d, "household").select(HOUSEHOLD, F.col(DWELLING).alias("opening")), HOUSEHOLD)
    out = joins.asof_join(facts, moves.where(F.col(DWELLING).isNotNull()).withColumnRenamed(DWELLING, "dwelling"), HOUSEHOLD, "at", "tick", "dwelling", EVENT, F.col("opening"), bucket=24)
    return out.select(EVENT, "dwelling")


def net_migration(spark, d):
    """Households gained less lost per county between two ticks."""
    _, moves = _moves(spark, d)
    base = without_codes(load(spark, d, "household"), codes=["cell"]).select(HOUSEHOLD, F.col("cell").alias("to_cell"))
    def at(t):
        s = bt.last_state(moves.where(F.col("to_cell").isNotNull()), HOUSEHOLD, ["tick", EVENT], ["to_cell"], F.col("tick") <= t, base.where(F.col("to_cell").isNotNull()))
        return s.select(HOUSEHOLD, F.floor(F.col("to_cell") / 256).alias("county"))
    return bt.net_migration(at(12), at(48), HOUSEHOLD, "county")


def recent_movers(spark, d):
    _, moves = _moves(spark, d)
    flagged = bt.recent_flag(load(spark, d, "household").where(F.col(HOUSEHOLD).isNotNull()), moves, HOUSEHOLD, "tick", MONTHS, 12, "moved")
    return flagged.groupBy("moved").agg(F.count(F.lit(1)).alias("households"))


def first_qualifying(spark, d):
    """First admission of each person in a qualifying diagnosis group."""
    rows = load(spark, d, "ledger").where(F.col("event_type").eqNullSafe(10) & F.col("diagnosis_group").isin(3, 7) & (F.col(PERSON) > 0))
    return bt.first_per_entity(rows, PERSON, ["tick", EVENT], ["diagnosis_group"])


def monthly_admissions(spark, d):
    return load(spark, d, "ledger").where("event_type = 10 and truth_hospital_id > 0").groupBy("truth_hospital_id", "tick").agg(F.count_distinct(EVENT).alias("n"))


def trailing_mean(spark, d):
    return monthly_admissions(spark, d).select("truth_hospital_id", "tick", F.round(windows.trailing_mean("n", ["truth_hospital_id"], "tick", 6), 8).alias("mean"))


def centred_mean(spark, d):
    return monthly_admissions(spark, d).select("truth_hospital_id", "tick", F.round(windows.centred_mean("n", ["truth_hospital_id"], "tick", 5), 8).alias("mean"))


def ledger_violations(spark, d):
    """Rules of the ledger and how many rows break them."""
    l = load(spark, d, "ledger")
    ids = l.select(EVENT).distinct()
    return bt.violations({
        "recorded before it happened": l.where("recorded_tick < tick"), "no event id": l.where(f"coalesce({EVENT}, 0) = 0"),
        "event kind out of range": l.where("event_type is null or event_type not between 1 and 11"),
        "corrects what never came": l.where(f"{VOIDS} > 0").select(F.col(VOIDS).alias(EVENT)).distinct().join(ids, EVENT, "left_anti"),
        "id of another kind": l.where(f"shiftrightunsigned({EVENT}, 56) <> 8"), "discharge without admission": l.where("event_type = 11 and truth_encounter_id > 0").select("truth_encounter_id").distinct().join(l.where("event_type = 10").select("truth_encounter_id").distinct(), "truth_encounter_id", "left_anti"),
    })


def register(spark, d, name, entity):
    return without_codes(load(spark, d, name), ids=[entity, "household_id", "given_code", "family_code"], codes=["sex", "county"])


NAME_KEY = ["given_code", "family_code", "birth_tick", "sex"]


def dedup_keep_first(spark, d):
    """The register without repeats: by person, then within households, unknown counties last."""
    rows = register(spark, d, "population", "person_id").where("person_id is not null")
    once = agg.keep_first(rows, ["person_id", "birth_tick", "sex"], ["record_id"])
    return agg.keep_first(once, ["household_id", "given_code", "birth_tick", "sex"], ["record_id"]).where("county is not null").select("record_id")


def exact_unique_links(spark, d):
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    return joins.exact_unique_join(a.select("person_id", "record_id", *NAME_KEY), b.select("taxpayer_id", F.col("record_id").alias("record_b"), *NAME_KEY), NAME_KEY, "record_id", "record_b").select("person_id", "taxpayer_id")


def _pairs(spark, d):
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    keep = [*NAME_KEY, "county"]
    pairs = joins.block_pairs(a, b, "record_id", "record_id", ["sex", "birth_tick"], ["given_code", "family_code"])
    a, b = (x.select(F.col("record_id").alias(i), *keep).dropDuplicates([i]) for x, i in ((a, "id_a"), (b, "id_b")))
    both = pairs.join(a, "id_a").select("id_a", "id_b", F.struct(*keep).alias("a")).join(b.select("id_b", F.struct(*keep).alias("b")), "id_b")
    return both.select("id_a", "id_b", matching.agreement_pattern("a", "b", ["given_code", "family_code", "county"]).alias("pattern"))


def block_pairs(spark, d):
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    return joins.block_pairs(a, b, "record_id", "record_id", ["sex", "birth_tick"], ["given_code", "family_code"])


def pattern_counts(spark, d):
    return _pairs(spark, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def link_posteriors(spark, d):
    return matching.link_posteriors(_pairs(spark, d), "pattern", 3).select("id_a", "id_b", F.round("posterior", 9).alias("posterior"))


def one_to_one_links(spark, d):
    rated = matching.link_posteriors(_pairs(spark, d), "pattern", 3).where("posterior > 0.5")
    return matching.one_to_one(rated.withColumn("posterior", F.round("posterior", 9)), "id_a", "id_b", "posterior")


def clerical_bootstrap(spark, d):
    return matching.clerical_bootstrap(_pairs(spark, d), "pattern", 3, 2, 20, 5)


def union_keys(spark, d):
    return register(spark, d, "population", "person_id").select(*NAME_KEY).unionByName(register(spark, d, "income", "taxpayer_id").select(*NAME_KEY)).distinct()


def minus_keys(spark, d):
    return register(spark, d, "income", "taxpayer_id").select(*NAME_KEY).subtract(register(spark, d, "population", "person_id").select(*NAME_KEY))


def disappearance(spark, d):
    a, b = register(spark, d, "income_preliminary", "taxpayer_id"), register(spark, d, "income", "taxpayer_id")
    return matching.disappeared(a.where("taxpayer_id is not null"), b, "taxpayer_id", ["county", "sex"])


def county_miscoding(spark, d):
    """Share of wrong counties per register, from uniquely linked pairs."""
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    pairs = joins.exact_unique_join(a.select(F.col("county").alias("ca"), "record_id", *NAME_KEY), b.select(F.col("county").alias("cb"), F.col("record_id").alias("record_b"), *NAME_KEY), NAME_KEY, "record_id", "record_b")
    s = pairs.where("ca is not null and cb is not null").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("ca") != F.col("cb")).cast("int")).alias("disagree"))
    return s.select("pairs", F.round("disagree", 8).alias("disagree"), F.round(matching.miscoding_rate("disagree", F.lit(0.02)), 8).alias("error"))


def unmixed_counts(spark, d):
    counts = register(spark, d, "population", "person_id").where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("n"))
    return matching.unmix_counts(counts, "county", "n", 0.05, 64).select("county", "n", F.round("unmixed", 6).alias("unmixed"))


def corroborated_counties(spark, d):
    """Linked persons whose counties agree, by county."""
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    pairs = joins.exact_unique_join(a.select(F.col("county").alias("ca"), "record_id", *NAME_KEY), b.select(F.col("county").alias("cb"), F.col("record_id").alias("record_b"), *NAME_KEY), NAME_KEY, "record_id", "record_b")
    return pairs.where("ca is not null").groupBy(F.col("ca").alias("county")).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("ca") == F.col("cb")).alias("corroborated"))


def nonresponse_weights(spark, d):
    sampled = register(spark, d, "population", "person_id").groupBy("county").agg(F.count_distinct("household_id").alias("sampled"))
    rows = register(spark, d, "income", "taxpayer_id").where("county is not null").join(sampled, "county")
    return survey.nonresponse_factor(rows, ["county"], "household_id", F.col("sampled")).select("county", F.round("factor", 8).alias("factor"))


def raked_weights(spark, d):
    """Register rows weighted to the true margins of sex by band and of county; the weighted counts by sex and county."""
    rows = register(spark, d, "population", "person_id").withColumn("band", band(age(F.lit(0), "birth_tick"))).withColumn("w", F.lit(1.0))
    truth = persons(spark, d).withColumn("band", band("age"))
    a, b = (truth.groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("t")) for k in (["sex", "band"], ["county"]))
    raked = survey.rake(rows, "w", [(["sex", "band"], a.where("sex is not null"), "t"), (["county"], b.where("county is not null"), "t")])
    return raked.groupBy("sex", "county").agg(F.round(F.sum("raked"), 4).alias("weight"))


def hot_deck(spark, d):
    rows = persons(spark, d).where("age >= 16").select("truth_person_id", "county", "sex", "education", "income_cents")
    return survey.hot_deck(rows, "income_cents", [["county", "sex", "education"], ["sex", "education"], ["sex"], []]).where("income_cents is null").select("truth_person_id", "imputed")


def _ages(spark, d):
    """Registered persons by sex and every age from 0 to 110."""
    n = register(spark, d, "population", "person_id").withColumn("age", age(F.lit(0), "birth_tick")).where("sex is not null and age between 0 and 110").groupBy("sex", "age").agg(F.count(F.lit(1)).alias("n"))
    return agg.densify(n, [n.select("sex").distinct(), spark.range(0, 111).withColumnRenamed("id", "age")], {"n": 0})


def age_heaping(spark, d):
    return survey.heaping(_ages(spark, d), ["sex"], "age", "n").select("sex", F.round("excess", 9).alias("excess"))


def deheaped_ages(spark, d):
    return survey.deheap(_ages(spark, d), ["sex"], "age", "n").select("sex", "age", F.round("smoothed", 6).alias("smoothed"))


def benchmark_reconciled(spark, d):
    """County counts of the register brought to the true state totals."""
    geo = F.broadcast(load(spark, d, "geography").select("county", "state"))
    est = register(spark, d, "population", "person_id").where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n").cast("double")).join(geo, "county")
    truth = persons(spark, d).where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("t"))
    return survey.reconcile(est, ["state"], "n", "v", truth, "t").select("county", F.round("reconciled", 6).alias("reconciled"))


def bootstrap_spread(spark, d):
    """Mean and spread of the registered persons over resampled counties within states."""
    geo = load(spark, d, "geography").select("county", "state")
    factors = survey.rescaled_bootstrap(geo, ["state"], "county", 50, 3)
    n = register(spark, d, "population", "person_id").where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("n"))
    draws = factors.join(n, "county").groupBy("draw", "state").agg(F.sum(F.col("n") * F.col("factor")).alias("t"))
    return draws.groupBy("state").agg(F.round(F.avg("t"), 4).alias("mean"), F.round(F.stddev_pop("t"), 4).alias("spread"))


def pps_cells(spark, d):
    cells = persons(spark, d).where("county is not null").groupBy("state", "county", "cell").agg(F.count(F.lit(1)).alias("n"))
    return survey.pps_sample(cells, ["state"], "cell", "n", 10, 4)


def response_draws(spark, d):
    """Households that answer a survey, by a keyed logistic draw, per county."""
    h = load(spark, d, "household").where("truth_household_id is not null and cell >= 0").withColumn("county", F.floor(F.col("cell") / 256))
    return h.groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.count_if(uniform(9, "truth_household_id") < 0.7).alias("answered"))


def nearest_seat(spark, d):
    """Nearest county seat of every household's cell on the 128 by 128 grid."""
    h = load(spark, d, "household").where("cell >= 0").select("truth_household_id", F.floor(F.col("cell") / 128).alias("row"), (F.col("cell") % 128).alias("col"))
    seats = load(spark, d, "geography").select(F.col("county").alias("site"), (F.col("county") * 256 + 128).alias("cell")).select("site", F.floor(F.col("cell") / 128).alias("row"), (F.col("cell") % 128).alias("col"))
    return joins.nearest_site(h, seats).groupBy("nearest").agg(F.count(F.lit(1)).alias("households"), F.sum("distance").alias("distance"))


QUERIES = {f.__name__: f for f in (
    hierarchy_rollup, low_income_share, age_band_cube, release_band_counts, exposure_months, death_rates, credible_rates, county_deviations, experience_history, mortality_year_effects, mortality_trend,
    life_table, gompertz_fit, supersede_filter, visible_events, late_share, state_at, recorded_state_diff, asof_lookup, net_migration, recent_movers, first_qualifying, trailing_mean, centred_mean,
    ledger_violations, dedup_keep_first, exact_unique_links, block_pairs, pattern_counts, link_posteriors, one_to_one_links, clerical_bootstrap, union_keys, minus_keys, disappearance, county_miscoding,
    unmixed_counts, corroborated_counties, nonresponse_weights, raked_weights, hot_deck, age_heaping, deheaped_ages, benchmark_reconciled, bootstrap_spread, pps_cells, response_draws, nearest_seat,
)}

_LEVELS = """CASE WHEN grouping(state) = 1 THEN 'nation' WHEN grouping(county) = 1 THEN 'state' ELSE 'county' END AS level,
  CASE WHEN grouping(state) = 1 THEN 0 WHEN grouping(county) = 1 THEN state ELSE county END::bigint AS unit"""
_SETS = "GROUP BY GROUPING SETS ((), (state), (state, county))"
_REG = """a AS (SELECT record_id, nullif(person_id, 0) AS person_id, nullif(household_id, 0) AS household_id, nullif(given_code, 0) AS given_code, nullif(family_code, 0) AS family_code, birth_tick, nullif(sex, -1) AS sex, nullif(county, -1) AS county FROM population),
b AS (SELECT record_id, nullif(taxpayer_id, 0) AS taxpayer_id, nullif(household_id, 0) AS household_id, nullif(given_code, 0) AS given_code, nullif(family_code, 0) AS family_code, birth_tick, nullif(sex, -1) AS sex, nullif(county, -1) AS county FROM income)"""
_UNIQUE = f"""{_REG},
ua AS (SELECT *, count(*) OVER (PARTITION BY given_code, family_code, birth_tick, sex) AS n FROM a),
ub AS (SELECT *, count(*) OVER (PARTITION BY given_code, family_code, birth_tick, sex) AS n FROM b),
links AS (SELECT ua.person_id, ub.taxpayer_id, ua.county AS ca, ub.county AS cb FROM ua JOIN ub USING (given_code, family_code, birth_tick, sex) WHERE ua.n = 1 AND ub.n = 1)"""
_BLOCKS = f"""{_REG},
pairs AS (SELECT DISTINCT a.record_id AS id_a, b.record_id AS id_b FROM a JOIN b ON a.sex = b.sex AND a.birth_tick = b.birth_tick AND a.given_code = b.given_code
  UNION SELECT a.record_id, b.record_id FROM a JOIN b ON a.sex = b.sex AND a.birth_tick = b.birth_tick AND a.family_code = b.family_code)"""
_MOVES = """m AS (SELECT truth_event_id, tick, nullif(truth_household_id, 0) AS h, nullif(truth_dwelling_id, 0) AS dw, nullif(to_cell, -1) AS to_cell FROM ledger WHERE event_type IN (3, 4))"""
_HEAP = f"""{_REG}, c AS (SELECT sex, floor((0 - birth_tick) / 12)::bigint AS age, count(*) AS n FROM a WHERE sex IS NOT NULL AND floor((0 - birth_tick) / 12) BETWEEN 0 AND 110 GROUP BY 1, 2),
n AS (SELECT s.sex, t.age, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT sex FROM c) s CROSS JOIN range(0, 111) t(age) LEFT JOIN c ON c.sex = s.sex AND c.age = t.age),
m AS (SELECT *, avg(n) OVER (PARTITION BY sex ORDER BY age ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean FROM n),
h AS (SELECT sex, CASE WHEN sum(n) FILTER (WHERE age BETWEEN 20 AND 95) < 200 THEN 0 ELSE
  greatest(0, least(0.6, sum(n - mean) FILTER (WHERE age % 5 = 0 AND age BETWEEN 22 AND 93) / sum(n) FILTER (WHERE age BETWEEN 22 AND 93))) END::double AS excess FROM m GROUP BY 1)"""

ORACLES = {
    "hierarchy_rollup": f"""WITH {_P} SELECT {_LEVELS}, count(*) AS persons, count(DISTINCT truth_household_id) AS households, count(*) FILTER (WHERE age < 16) AS children, count(*) FILTER (WHERE age >= 65) AS elders,
  median(income_cents) FILTER (WHERE age >= 16) AS median_income, round(avg(income_cents) FILTER (WHERE age >= 16), 4) AS mean_income,
  round(avg((education >= 3)::int) FILTER (WHERE age >= 25 AND education IS NOT NULL), 8) AS tertiary_share FROM q {_SETS}""",
    "low_income_share": f"""WITH {_P}, h AS (SELECT state, county, truth_household_id, sum(income_cents) AS income FROM q GROUP BY 1, 2, 3 HAVING sum(income_cents) IS NOT NULL), l AS (SELECT 0.6 * median(income) AS line FROM h)
SELECT {_LEVELS}, count(*) AS households, round(avg((income < line)::int), 8) AS low_income_share FROM h, l {_SETS}""",
    "age_band_cube": f"""WITH {_P}, c AS (SELECT county, {_band_sql('age', RATE_BANDS)} AS band, sex, count(*) AS n FROM q WHERE sex IS NOT NULL AND county IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.county, b.band, s.sex, coalesce(c.n, 0) AS n FROM geography g, (VALUES {", ".join(f"('{b[0]}')" for b in RATE_BANDS)}) b(band), (SELECT DISTINCT sex FROM p WHERE sex IS NOT NULL) s LEFT JOIN c ON c.county = g.county AND c.band = b.band AND c.sex = s.sex""",
    "release_band_counts": f"WITH {_P} SELECT {_band_sql('age', RELEASE_BANDS)} AS band, count(*) AS n FROM q GROUP BY 1",
    "exposure_months": f"""WITH {_P}, {_D}, a AS (SELECT county, sex, died FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND county IS NOT NULL)
SELECT county, sex, m AS tick, count(*) AS alive FROM a, range(1, 61) t(m) WHERE died IS NULL OR m < died GROUP BY 1, 2, 3""",
    "death_rates": f"""WITH {_P}, {_D}, {_E} SELECT state, sex, band, county, grouping(state, sex, band, county) AS grouping, sum(deaths)::bigint AS deaths, sum(months)::bigint AS months,
  round(CASE WHEN sum(months) > 0 THEN sum(deaths)::double / sum(months)::double * 12 END, 9) AS rate FROM e GROUP BY GROUPING SETS ((state, sex, band), (county))""",
    "credible_rates": f"""WITH {_P}, {_D}, {_E}, g AS (SELECT county, sum(deaths)::double AS d, sum(months)::double AS e FROM e GROUP BY 1 HAVING sum(months) > 0),
t AS (SELECT sum(d) / sum(e) AS mu, (sum(d * d / e) - sum(d) * sum(d) / sum(e) - (count(*) - 1) * sum(d) / sum(e)) / nullif(sum(e) - sum(e * e) / sum(e), 0) AS v FROM g),
z AS (SELECT g.*, mu, CASE WHEN v > 0 THEN e / (e + mu / v) ELSE 0 END AS z FROM g, t)
SELECT county, round(d / e, 9) AS rate, round(z, 6) AS weight, round(z * d / e + (1 - z) * mu, 9) AS credible_rate FROM z""",
    "county_deviations": f"""WITH {_P}, {_D}, {_E}, c AS (SELECT state, county, sum(deaths)::double AS d, sum(months)::double AS e FROM e GROUP BY 1, 2), s AS (SELECT state, sum(deaths)::double / nullif(sum(months), 0) AS base FROM e GROUP BY 1)
SELECT county, state, round((d + 25) / (e * base + 25), 8) AS deviation, round(base * (d + 25) / (e * base + 25), 9) AS rate FROM c JOIN s USING (state)""",
    "experience_history": f"WITH {_P}, {_D}, {_Y} SELECT sex, band, year, months, deaths FROM y",
    "mortality_year_effects": f"""WITH {_P}, {_D}, {_Y}, l AS (SELECT *, ln(deaths / months) AS l FROM y WHERE deaths > 0), x AS (SELECT *, l - sum(deaths * l) OVER (PARTITION BY sex, band) / sum(deaths) OVER (PARTITION BY sex, band) AS x FROM l)
SELECT year, round(sum(deaths * x) / sum(deaths), 8) AS effect FROM x GROUP BY 1""",
    "mortality_trend": f"""WITH {_P}, {_D}, {_Y}, m AS (SELECT sex, band, sum(deaths)::double AS w, sum(deaths * year)::double AS wx, sum(deaths * ln(deaths / months)) AS wy, sum(deaths * year * year)::double AS wxx, sum(deaths * year * ln(deaths / months)) AS wxy FROM y WHERE deaths > 0 GROUP BY 1, 2),
s AS (SELECT (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) AS slope, w FROM m), c AS (SELECT slope, sum(w) OVER (ORDER BY slope ROWS UNBOUNDED PRECEDING) AS up, sum(w) OVER () AS total FROM s WHERE slope IS NOT NULL)
SELECT round(min(slope), 8) AS trend FROM c WHERE up >= 0.5 * total""",
    "life_table": f"""WITH {_P}, {_D}, t AS (SELECT sex, age, count(died)::double / count(*) AS q FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND age BETWEEN 0 AND 110 GROUP BY 1, 2)
SELECT sex, age, round(CASE WHEN bool_or(q >= 1) OVER w THEN 0 ELSE exp(sum(CASE WHEN q < 1 THEN ln(1 - q) END) OVER w) END, 8) AS survival FROM t WINDOW w AS (PARTITION BY sex ORDER BY age ROWS UNBOUNDED PRECEDING)""",
    "gompertz_fit": f"""WITH {_P}, {_D}, t AS (SELECT sex, age, count(died)::double AS d, count(*)::double AS e FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND age BETWEEN 40 AND 100 GROUP BY 1, 2),
f AS (SELECT sex, -9 + 0.25 * i AS a, 0.04 + 0.01 * j AS b, sum(d * (-9 + 0.25 * i + (0.04 + 0.01 * j) * age) - e * exp(-9 + 0.25 * i + (0.04 + 0.01 * j) * age)) AS fit FROM t, range(0, 17) x(i), range(0, 9) y(j) GROUP BY 1, 2, 3)
SELECT sex, arg_max(a, fit)::double AS a, round(arg_max(b, fit), 4)::double AS b, round(max(fit), 5) AS fit FROM f GROUP BY 1""",
    "supersede_filter": """SELECT event_type, count(DISTINCT truth_event_id) AS events, max(tick) AS last_tick FROM ledger
WHERE truth_event_id NOT IN (SELECT supersedes_event_id FROM ledger WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id) GROUP BY 1""",
    "visible_events": "SELECT event_type, tick, count(DISTINCT truth_event_id) AS events FROM ledger WHERE recorded_tick <= 30 GROUP BY 1, 2",
    "late_share": "SELECT event_type, count(*) AS n, round(avg((recorded_tick > tick)::int), 8) AS late_share, max(recorded_tick - tick) AS latest FROM ledger GROUP BY 1",
    "state_at": f"SELECT * FROM {_state_sql('')}",
    "recorded_state_diff": f"SELECT coalesce(x.truth_household_id, y.truth_household_id) AS truth_household_id FROM {_state_sql('30')} x FULL JOIN {_state_sql('')} y ON x.truth_household_id = y.truth_household_id WHERE x.truth_dwelling_id IS DISTINCT FROM y.truth_dwelling_id",
    "asof_lookup": f"""WITH {_MOVES}, c AS (SELECT h, tick, arg_max(dw, truth_event_id) AS dw FROM m WHERE dw IS NOT NULL AND h IS NOT NULL GROUP BY 1, 2),
f AS (SELECT truth_event_id, min(tick) AS t, max(truth_person_id) AS truth_person_id FROM ledger WHERE event_type = 10 AND truth_person_id > 0 GROUP BY 1),
x AS (SELECT f.*, hh.truth_household_id AS h, hh.truth_dwelling_id AS opening FROM f JOIN person USING (truth_person_id) JOIN household hh USING (truth_household_id))
SELECT x.truth_event_id, coalesce(c.dw, opening) AS dwelling FROM x ASOF LEFT JOIN c ON x.h = c.h AND x.t >= c.tick""",
    "net_migration": f"""WITH {_MOVES}, s AS (SELECT h, to_cell, tick, truth_event_id FROM m WHERE to_cell IS NOT NULL AND h IS NOT NULL UNION ALL SELECT truth_household_id, nullif(cell, -1), -1000, 0 FROM household WHERE nullif(cell, -1) IS NOT NULL AND truth_household_id IS NOT NULL),
a AS (SELECT h, floor(arg_max(to_cell, (tick, truth_event_id)) / 256)::bigint AS c FROM s WHERE tick <= 12 GROUP BY 1), b AS (SELECT h, floor(arg_max(to_cell, (tick, truth_event_id)) / 256)::bigint AS c FROM s WHERE tick <= 48 GROUP BY 1),
x AS (SELECT a.c AS f, b.c AS t FROM a JOIN b USING (h) WHERE a.c <> b.c)
SELECT county, sum(net)::bigint AS net FROM (SELECT f AS county, -1 AS net FROM x UNION ALL SELECT t, 1 FROM x) GROUP BY 1""",
    "recent_movers": f"WITH {_MOVES} SELECT truth_household_id IN (SELECT h FROM m WHERE h IS NOT NULL AND tick > 48 AND tick <= 60) AS moved, count(*) AS households FROM household WHERE truth_household_id IS NOT NULL GROUP BY 1",
    "first_qualifying": """SELECT truth_person_id, tick, truth_event_id, diagnosis_group FROM (SELECT *, row_number() OVER (PARTITION BY truth_person_id ORDER BY tick, truth_event_id, diagnosis_group) AS place FROM ledger
WHERE event_type = 10 AND diagnosis_group IN (3, 7) AND truth_person_id > 0) WHERE place = 1""",
    **{name: f"""WITH n AS (SELECT truth_hospital_id, tick, count(DISTINCT truth_event_id) AS n FROM ledger WHERE event_type = 10 AND truth_hospital_id > 0 GROUP BY 1, 2)
SELECT truth_hospital_id, tick, round({what} OVER (PARTITION BY truth_hospital_id ORDER BY tick ROWS BETWEEN {frame}){per}, 8) AS mean FROM n""" for name, what, frame, per in (("trailing_mean", "avg(n)", "5 PRECEDING AND CURRENT ROW", ""), ("centred_mean", "sum(n)", "2 PRECEDING AND 2 FOLLOWING", " / 5"))},
    "ledger_violations": """SELECT 'recorded before it happened' AS rule, count(*) AS n FROM ledger WHERE recorded_tick < tick
UNION ALL SELECT 'no event id', count(*) FROM ledger WHERE coalesce(truth_event_id, 0) = 0
UNION ALL SELECT 'event kind out of range', count(*) FROM ledger WHERE event_type IS NULL OR event_type NOT BETWEEN 1 AND 11
UNION ALL SELECT 'corrects what never came', count(DISTINCT supersedes_event_id) FROM ledger WHERE supersedes_event_id > 0 AND supersedes_event_id NOT IN (SELECT truth_event_id FROM ledger)
UNION ALL SELECT 'id of another kind', count(*) FROM ledger WHERE truth_event_id >> 56 <> 8
UNION ALL SELECT 'discharge without admission', count(DISTINCT truth_encounter_id) FROM ledger WHERE event_type = 11 AND truth_encounter_id > 0 AND truth_encounter_id NOT IN (SELECT truth_encounter_id FROM ledger WHERE event_type = 10 AND truth_encounter_id IS NOT NULL)""",
    "dedup_keep_first": f"""WITH {_REG}, o AS (SELECT *, row_number() OVER (PARTITION BY person_id, birth_tick, sex ORDER BY record_id, county, household_id, given_code) AS k FROM a WHERE person_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY household_id, given_code, birth_tick, sex ORDER BY record_id, person_id) AS k2 FROM o WHERE k = 1) SELECT record_id FROM t WHERE k2 = 1 AND county IS NOT NULL""",
    "exact_unique_links": f"WITH {_UNIQUE} SELECT person_id, taxpayer_id FROM links",
    "block_pairs": f"WITH {_BLOCKS} SELECT id_a, id_b FROM pairs",
    "pattern_counts": f"""WITH {_BLOCKS}, da AS (SELECT DISTINCT ON (record_id) * FROM a), db AS (SELECT DISTINCT ON (record_id) * FROM b)
SELECT ((coalesce(da.given_code = db.given_code, false))::int + 2 * (coalesce(da.family_code = db.family_code, false))::int + 4 * (coalesce(da.county = db.county, false))::int) AS pattern, count(*) AS n
FROM pairs JOIN da ON da.record_id = id_a JOIN db ON db.record_id = id_b GROUP BY 1""",
    "union_keys": f"WITH {_REG} SELECT given_code, family_code, birth_tick, sex FROM a UNION SELECT given_code, family_code, birth_tick, sex FROM b",
    "minus_keys": f"WITH {_REG} SELECT given_code, family_code, birth_tick, sex FROM b EXCEPT SELECT given_code, family_code, birth_tick, sex FROM a",
    "disappearance": """SELECT nullif(county, -1) AS county, nullif(sex, -1) AS sex, count(*) AS at_risk, count(*) FILTER (WHERE nullif(taxpayer_id, 0) NOT IN (SELECT taxpayer_id FROM income WHERE taxpayer_id <> 0)) AS gone
FROM income_preliminary WHERE taxpayer_id <> 0 GROUP BY 1, 2""",
    "county_miscoding": f"WITH {_UNIQUE}, s AS (SELECT count(*) AS pairs, avg((ca <> cb)::int) AS d FROM links WHERE ca IS NOT NULL AND cb IS NOT NULL) SELECT pairs, round(d, 8) AS disagree, round((1 - (1 - d) / 0.98) / 2, 8) AS error FROM s",
    "unmixed_counts": f"WITH {_REG}, n AS (SELECT county, count(*) AS n FROM a WHERE county IS NOT NULL GROUP BY 1) SELECT county, n, round((n - 0.05 / 63 * sum(n) OVER ()) / (1 - 0.05 - 0.05 / 63)::double, 6) AS unmixed FROM n",
    "corroborated_counties": f"WITH {_UNIQUE} SELECT ca AS county, count(*) AS links, count(*) FILTER (WHERE ca = cb) AS corroborated FROM links WHERE ca IS NOT NULL GROUP BY 1",
    "nonresponse_weights": f"""WITH {_REG}, s AS (SELECT county, count(DISTINCT household_id) AS s FROM a GROUP BY 1), n AS (SELECT county, count(DISTINCT household_id) AS n FROM b WHERE county IS NOT NULL GROUP BY 1)
SELECT county, round(greatest(1.0, s / nullif(n, 0)), 8)::double AS factor FROM n JOIN s USING (county)""",
    "hot_deck": f"""WITH {_P}, r AS (SELECT * FROM q WHERE age >= 16) SELECT r.truth_person_id, coalesce(
  (SELECT median(o.income_cents) FROM r o WHERE o.county = r.county AND o.sex = r.sex AND o.education = r.education), (SELECT median(o.income_cents) FROM r o WHERE o.sex = r.sex AND o.education = r.education),
  (SELECT median(o.income_cents) FROM r o WHERE o.sex = r.sex), (SELECT median(income_cents) FROM r)) AS imputed FROM r WHERE income_cents IS NULL""",
    "age_heaping": f"WITH {_HEAP} SELECT sex, round(excess, 9) AS excess FROM h",
    "deheaped_ages": f"""WITH {_HEAP}, f AS (SELECT n.sex, n.age AS five, o.age, n.n * excess AS take, o.n, sum(o.n) OVER (PARTITION BY n.sex, n.age) AS near
  FROM n JOIN h USING (sex) JOIN n o ON o.sex = n.sex AND abs(o.age - n.age) BETWEEN 1 AND 2 WHERE n.age % 5 = 0 AND n.age BETWEEN 25 AND 108),
g AS (SELECT sex, age, take * CASE WHEN near > 0 THEN n / near ELSE 0.25 END AS d FROM f UNION ALL SELECT DISTINCT sex, five, -take FROM f), s AS (SELECT sex, age, sum(d) AS d FROM g GROUP BY 1, 2)
SELECT n.sex, n.age, round(greatest(n.n + coalesce(s.d, 0), 0)::double, 6) AS smoothed FROM n LEFT JOIN s USING (sex, age)""",
    "benchmark_reconciled": f"""WITH {_P}, {_REG}, e AS (SELECT county, count(*)::double AS n FROM a WHERE county IS NOT NULL GROUP BY 1), t AS (SELECT state, count(*)::double AS t FROM q WHERE state IS NOT NULL GROUP BY 1)
SELECT e.county, round(n + coalesce(t - sum(n) OVER (PARTITION BY g.state), 0) * n / sum(n) OVER (PARTITION BY g.state), 6) AS reconciled FROM e JOIN geography g USING (county) LEFT JOIN t ON t.state = g.state""",
    "nearest_seat": """WITH h AS (SELECT floor(cell / 128)::bigint AS r, cell % 128 AS c FROM household WHERE cell >= 0), s AS (SELECT county, floor((county * 256 + 128) / 128)::bigint AS r, (county * 256 + 128) % 128 AS c FROM geography),
u AS (SELECT r, c, count(*) AS n FROM h GROUP BY 1, 2), x AS (SELECT u.*, min((greatest(abs(u.r - s.r), abs(u.c - s.c)), s.county)) AS b FROM u, s GROUP BY u.r, u.c, u.n)
SELECT b[2]::int AS nearest, sum(n)::bigint AS households, sum(n * b[1])::bigint AS distance FROM x GROUP BY 1""",
}
