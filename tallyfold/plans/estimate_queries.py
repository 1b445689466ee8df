"""Queries of exposure, linkage errors, ratios, rates and small expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.scalars import BROAD_BANDS, RATE_BANDS, age, band, clip, edge_index, entity_id, first_positive, has_flag, rogan_gladen
from tallyfold.operators import aggregates as agg
from tallyfold.operators import deliveries, estimates, exposure, generators, joins, projection, rates, scoring, survey, tail, windows
from tallyfold.plans.problems import EVENT, HOUSEHOLD, PERSON, VOIDS
from tallyfold.plans.register_queries import _D, _E, _P, _Y, MONTHS, _band_sql, deaths, persons, register, yearly
from tallyfold.plans.register_queries import exposure as county_exposure
from tallyfold.session import checkpoint_dir
from tallyfold.sources import files
from tallyfold.sources.tables import known, load, without_codes

# exposure and the ledger


def _first(spark, d, kinds, keep, ids, codes=()):
    ledger = load(spark, d, "ledger")
    rows = without_codes(ledger.where(F.col("event_type").isin(kinds)), ids=ids, codes=list(codes))
    first = deliveries.first_deliveries(rows, EVENT, "recorded_tick", keep)
    return deliveries.not_withdrawn(first, deliveries.withdrawals(ledger, EVENT, VOIDS), EVENT)


def residence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """When each person lives, in which household, and in which county each household is: births, deaths, formations and moves
    of the ledger count from their month."""
    opening = without_codes(load(spark, d, "person"), ids=[HOUSEHOLD], codes=["sex"]).where("is_alive")
    events = _first(spark, d, [1, 3], ["tick", "event_type", PERSON, HOUSEHOLD, "birth_tick", "sex"], [PERSON, HOUSEHOLD], ["sex"])
    born = events.where("event_type = 1").groupBy(PERSON).agg(F.min("tick").alias("s"), F.min("birth_tick").alias("birth"), F.min("sex").alias("sex"))
    people = opening.select(PERSON, "sex", F.col("birth_tick").alias("birth"), F.lit(0).cast("long").alias("s")).unionByName(born.select(PERSON, "sex", "birth", "s"))
    people = people.groupBy(PERSON).agg(F.min("sex").alias("sex"), F.min("birth").alias("birth"), F.min("s").alias("s"))
    people = people.join(deaths(spark, d), PERSON, "left").withColumn("e", F.coalesce("died", F.lit(MONTHS + 1))).drop("died")
    homes = events.select(PERSON, "tick", EVENT, HOUSEHOLD).unionByName(opening.select(PERSON, F.lit(0).cast("long").alias("tick"), F.lit(0).cast("long").alias(EVENT), HOUSEHOLD))
    moves = _first(spark, d, [3, 4], ["tick", HOUSEHOLD, "to_cell"], [HOUSEHOLD], ["to_cell"]).where("to_cell is not null")
    cells = moves.select(HOUSEHOLD, "tick", EVENT, F.floor(F.col("to_cell") / 256).alias("county")).unionByName(
        load(spark, d, "household").where("cell >= 0").select(HOUSEHOLD, F.lit(0).cast("long").alias("tick"), F.lit(0).cast("long").alias(EVENT), F.floor(F.col("cell") / 256).alias("county"))
    )
    stays = exposure.spells(homes, PERSON, "tick", EVENT, HOUSEHOLD, MONTHS)
    places = exposure.spells(cells, HOUSEHOLD, "tick", EVENT, "county", MONTHS)
    return people, stays, places


def residence_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Person-months by county, sex and attained band."""
    return exposure.residence_exposure(*residence(spark, d), PERSON, HOUSEHOLD, "county", MONTHS)


def horizon_truth(spark, d):
    """Persons living at the last month, by county, state and nation of residence then."""
    people, stays, places = residence(spark, d)
    at = lambda df: df.where((F.col("s") <= MONTHS) & (F.col("e") > MONTHS)).drop("s", "e")
    there = at(people.where("sex is not null and birth is not null")).join(at(stays), PERSON).join(at(places), HOUSEHOLD)
    there = there.join(F.broadcast(load(spark, d, "geography").select("county", "state")), "county")
    return agg.rollup_levels(there, "state", "county", {"persons": F.count(F.lit(1)), "elders": F.count_if(F.lit(MONTHS) - F.col("birth") >= 780)})


#: Ends come before deaths, deaths before what opens, closings last.
IN_MONTH = {7: 0, 11: 1, 2: 2, 9: 3, 1: 4, 3: 5, 4: 6, 8: 7, 6: 8, 10: 9, 5: 10}


def month_sequence(spark, d):
    rows = load(spark, d, "ledger").select(EVENT, "tick", "event_type").groupBy(EVENT).agg(F.min("tick").alias("tick"), F.min("event_type").alias("event_type"))
    return exposure.in_month_order(rows, "event_type", IN_MONTH, "tick", EVENT).select(EVENT, "seq")


def broken_stays(spark, d):
    """Stays whose admissions and discharges don't take turns."""
    events = _first(spark, d, [10, 11], ["tick", "event_type", "truth_encounter_id"], ["truth_encounter_id"])
    return exposure.broken_transitions(events, "truth_encounter_id", ["tick", EVENT], F.col("event_type") == 10, F.col("event_type") == 11)


def emptied_households(spark, d):
    """Households none of whose opening members is alive at the end."""
    living = persons(spark, d).where("is_alive").join(deaths(spark, d), PERSON, "left_anti")
    return generators.empty_households(load(spark, d, "household").where(f"{HOUSEHOLD} is not null").select(HOUSEHOLD), living, HOUSEHOLD)


def due_discharges(spark, d):
    """Stays admitted by month 30 and scheduled to end by then, per hospital."""
    rows = without_codes(load(spark, d, "ledger").where("event_type = 10 and tick <= 30"), ids=["scheduled_end_tick", "truth_hospital_id"])
    first = deliveries.first_deliveries(rows, EVENT, "recorded_tick", ["scheduled_end_tick", "truth_hospital_id"]).withColumn("is_open", F.lit(True))
    return generators.scheduled_discharges(first, 30).groupBy("truth_hospital_id").agg(F.count(F.lit(1)).alias("n"))


def residents_per_dwelling(spark, d):
    h = load(spark, d, "household").where("truth_dwelling_id > 0")
    return generators.residents(load(spark, d, "person"), h)


def shock_multipliers(spark, d):
    months = load(spark, d, "ledger").select("tick").distinct()
    return months.select("tick", F.round(generators.shock_multiplier("tick", [(1, 1.3), (3, 0.8), (1, 1.1)]), 9).alias("multiplier"))


# linkage errors and ratios


def _linked(spark, d):
    a, b = register(spark, d, "population", "person_id"), register(spark, d, "income", "taxpayer_id")
    key = ["given_code", "family_code", "sex"]
    return joins.exact_unique_join(a.select("record_id", F.col("birth_tick").alias("ba"), *key), b.select(F.col("record_id").alias("record_b"), F.col("birth_tick").alias("bb"), *key), key, "record_id", "record_b")


def birth_error(spark, d):
    """Share of pairs linked by names and sex alone whose births differ by a year or less but not by nothing, by band of age."""
    near = _linked(spark, d).where("given_code is not null and family_code is not null and sex is not null and abs(ba - bb) <= 12")
    out = estimates.birth_error(near.withColumn("band", band(age(F.lit(0), "ba"))), "band", F.col("ba") != F.col("bb"))
    return out.select("band", "pairs", "moved", F.round("rate", 9).alias("rate"))


def churn_fit(spark, d):
    """Disappearances between the two income snapshots beyond mortality, with a mobility and an error shape by band."""
    a, b = register(spark, d, "income_preliminary", "taxpayer_id"), register(spark, d, "income", "taxpayer_id")
    rows = a.where("taxpayer_id is not null and county is not null and birth_tick is not null").withColumn("band", band(age(F.lit(0), "birth_tick")))
    gone = rows.join(b.select("taxpayer_id", F.lit(1).alias("here")).distinct(), "taxpayer_id", "left")
    cells = gone.groupBy("county", "band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("here").isNull(), 1.0).otherwise(0.0)).alias("rate"))
    shape = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("band"))
    cells = cells.withColumns({"residual": F.greatest(F.col("rate") - shape(MORTALITY), F.lit(0.0)), "mobility": shape(MOBILITY), "error": shape(ERROR)})
    out = estimates.churn(cells, "county", "n", "residual", "mobility", "error")
    return out.select("county", *[F.round(c, 7).alias(c) for c in ("raw", "weight", "kappa", "mix_mobility", "mix_error")])


#: Shapes by band that the churn query assumes: mortality between the snapshots, mobility, error of births.
MORTALITY = dict(zip([b[0] for b in RATE_BANDS], (0.0, 0.001, 0.003, 0.01, 0.03, 0.09), strict=True))
MOBILITY = dict(zip([b[0] for b in RATE_BANDS], (0.6, 1.6, 0.9, 0.5, 0.4, 0.3), strict=True))
ERROR = dict(zip([b[0] for b in RATE_BANDS], (0.4, 0.7, 1.0, 1.3, 1.7, 2.2), strict=True))


def _incomes(spark, d):
    own = register(spark, d, "income", "taxpayer_id").where("county is not null").withColumn("v", F.when(~F.isnan("employment_income_cents"), F.col("employment_income_cents")))
    a = own.where("v is not null").groupBy("county").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    b = persons(spark, d).where("county is not null and income_cents is not null").groupBy("county").agg(F.avg("income_cents").alias("mean"), F.count(F.lit(1)).alias("n"))
    return a, b


def income_ratios(spark, d):
    """Mean income of a county in the register over that of the population."""
    a, b = _incomes(spark, d)
    return estimates.source_ratios(a, b, ["county"], "mean", "n").select("county", F.round("ratio", 9).alias("ratio"))


def ratio_exponent(spark, d):
    """The power by which population means follow register means, both over their national means."""
    a, b = _incomes(spark, d)
    both = a.select("county", F.col("mean").alias("x")).join(b.select("county", F.col("mean").alias("y")), "county")
    whole = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return estimates.log_exponent(both.crossJoin(F.broadcast(whole)), F.col("x") / F.col("mx"), F.col("y") / F.col("my"), -5.0, 5.0).select(F.round("exponent", 8).alias("exponent"))


def inclusion_shares(spark, d):
    """Registered over living persons by state, drawn to the national share."""
    geo = load(spark, d, "geography").select("county", "state")
    seen = register(spark, d, "population", "person_id").where("county is not null").groupBy("county").agg(F.count(F.lit(1)).alias("seen"))
    there = persons(spark, d).where("county is not null and is_alive").groupBy("county").agg(F.count(F.lit(1)).alias("expected"))
    return estimates.inclusion(there.join(seen, "county", "left").na.fill(0, ["seen"]).join(geo, "county"), ["state"], "seen", "expected").select("state", F.round("inclusion", 9).alias("inclusion"))


def fertility_rates(spark, d):
    cube = persons(spark, d).where("sex is not null").groupBy("state", "age", "sex").agg(F.count(F.lit(1)).alias("n"))
    return estimates.fertility(cube, ["state"], "age", "sex", "n").select("state", "infants", "women", F.round("fertility", 9).alias("fertility"))


def tertiary_projection(spark, d):
    """Share with tertiary education in ten years, by county, under a Gompertz survival."""
    cube = persons(spark, d).where("is_alive and age between 0 and 100 and county is not null").groupBy("county", "age", "education").agg(F.count(F.lit(1)).alias("n"))
    survival = spark.range(0, 101).select(F.col("id").alias("age"), F.exp(-10 * F.exp(-9.5 + 0.09 * F.col("id"))).alias("p"))
    return estimates.tertiary_share(cube, ["county"], "age", "education", "n", survival, 10).select("county", F.round("share", 9).alias("share"))


# rates


def _ages(spark):
    return spark.createDataFrame(estimates.ages_of_bands(RATE_BANDS), "age bigint, band string")


def rates_by_age(spark, d):
    """Death rates by sex and band given to every age of the band."""
    cells = county_exposure(spark, d).groupBy("sex", "band").agg(F.sum("deaths").alias("deaths"), F.sum("months").alias("months")).where("months > 0")
    return estimates.bands_to_ages(cells.withColumn("rate", F.round(F.col("deaths") / F.col("months"), 10)), "band", "rate", _ages(spark), ["sex"])


def bands_from_ages(spark, d):
    cube = persons(spark, d).where("is_alive and sex is not null and age between 0 and 110").join(deaths(spark, d), PERSON, "left").groupBy("sex", "age").agg(F.count(F.lit(1)).alias("n"), F.count("died").alias("died"))
    return estimates.ages_to_bands(cube, _ages(spark), ["sex"], "n", "died").withColumn("rate", F.round("rate", 10))


def raked_paths(spark, d):
    """Yearly deaths of each band brought to given shares of the sexes, all years with one factor."""
    y = yearly(spark, d).select("band", "sex", "year", F.col("deaths").cast("double").alias("v"))
    shares = y.select("band", "sex").distinct().withColumn("share", F.lit(0.5))
    return estimates.rake_to_shares(y, ["band"], "sex", "v", shares, "share").select("band", "sex", "year", F.round("raked", 7).alias("raked"))


def _rate_rows(spark, d):
    e = county_exposure(spark, d).withColumn("broad", F.when(F.col("band") == "0-17", "0-17").when(F.col("band").isin("18-44", "45-64"), "18-64").otherwise("65+"))
    fine = e.groupBy("county", "sex", "broad", "band").agg(F.sum("deaths").alias("deaths"), F.sum("months").alias("exposure")).where("exposure > 0")
    broad = e.groupBy("county", "sex", "broad").agg(F.sum("deaths").alias("deaths"), F.sum("months").alias("exposure")).where("exposure > 0")
    # counties divisible by seven are given a wrong broad exposure
    broad = broad.withColumn("exposure", F.when(F.col("county") % 7 == 0, F.col("exposure") + 10).otherwise(F.col("exposure")))
    both = fine.withColumn("level", F.lit("fine")).unionByName(broad.withColumns({"band": F.col("broad"), "level": F.lit("broad")}))
    return both.withColumn("rate", F.col("deaths") / F.col("exposure"))


def rate_additivity(spark, d):
    """Cells whose broad rate or exposure is not what the fine bands add up to."""
    out = estimates.rate_violations(_rate_rows(spark, d), ["county", "sex", "broad"], "level", "fine", "broad", "exposure", "rate")
    return out.select("county", "sex", "broad", "gap_exposure", F.round("gap_events", 6).alias("gap_events"))


def rate_scores(spark, d):
    """County rates submitted as the state's, with intervals of a half, scored on cells of at least 500 months."""
    e = county_exposure(spark, d).where("state is not null")
    truth = e.groupBy("state", "county", "sex").agg(F.sum("months").alias("exposure"), (F.sum("deaths") / F.nullif(F.sum("months"), F.lit(0))).alias("rate"))
    state = e.groupBy("state", "sex").agg((F.sum("deaths") / F.nullif(F.sum("months"), F.lit(0))).alias("estimate"))
    sent = truth.select("state", "county", "sex").where("county % 5 <> 0").join(state, ["state", "sex"]).withColumns({"low": F.col("estimate") * 0.5, "high": F.col("estimate") * 1.5})
    out = estimates.rate_scores(sent, truth, ["state", "county", "sex"], 500)
    return out.select("cells", "missing", F.round("relative_error", 8).alias("relative_error"), F.round("interval_score", 8).alias("interval_score"))


def level_gaps(spark, d):
    """Disagreement of two estimates of the death level per state: those of the first and of the later years."""
    rows = persons(spark, d).where("is_alive and state is not null").join(deaths(spark, d), PERSON, "left")
    s = rows.groupBy("state", F.pmod(F.col("truth_person_id"), F.lit(10)).alias("part")).agg(F.count_if(F.col("died") <= 30).alias("a"), F.count_if(F.col("died") > 30).alias("b")).withColumn("w", F.lit(1.0))
    return estimates.level_gap(s, "state", "a", "b", "w").select("state", F.round("gap", 8).alias("gap"))


def rate_intervals(spark, d):
    """Rates by sex and band with limits from the Poisson variance of their logarithm."""
    c = county_exposure(spark, d).groupBy("sex", "band").agg(F.sum("deaths").alias("deaths"), F.sum("months").alias("months")).where("deaths > 0")
    low, high = rates.propagated_interval(F.col("deaths") / F.col("months"), 1 / F.col("deaths"))
    return c.select("sex", "band", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def shrunk_rates(spark, d):
    """Death shares of counties drawn to the national one by their persons."""
    rows = persons(spark, d).where("is_alive and county is not null").join(deaths(spark, d), PERSON, "left")
    c = rows.groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("died").isNotNull(), 1.0).otherwise(0.0)).alias("q"))
    whole = rows.agg(F.avg(F.when(F.col("died").isNotNull(), 1.0).otherwise(0.0)).alias("all"))
    return c.crossJoin(F.broadcast(whole)).select("county", F.round(survey.shrink(F.col("q"), F.col("n"), F.col("all"), 50.0), 9).alias("shrunk"))


# least squares and separation


def price_fit(spark, d):
    """Coefficients of a weighted linear fit of a line's price on quantity, discount and tax."""
    rows = load(spark, d, "lineitem").select("l_extendedprice", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), (F.col("l_linenumber") * 1.0).alias("w"))
    fit = estimates.least_squares(rows, ["quantity", "discount", "tax"], "l_extendedprice", "w")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in fit.items()], "term string, value double")


def leaked_share(spark, d):
    """How much discount and tax explain of a line's price beyond its quantity."""
    rows = load(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return spark.createDataFrame([(round(estimates.incremental_r2(rows, ["l_quantity"], ["l_discount", "l_tax"], "l_extendedprice"), 8),)], "r2 double")


def control_separation(spark, d):
    """Which suppliers' nations (controls) fail which priority (gate) in every year (world): late lines."""
    l = load(spark, d, "lineitem").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    l = l.join(F.broadcast(load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
    f = l.groupBy("s_nationkey", "o_orderpriority", F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("m")).withColumn("failed", F.col("m") > 0.05)
    return estimates.separation(f, "s_nationkey", "o_orderpriority", "year", "failed")


# small expressions


def half_open_classes(spark, d):
    """Lines by the half-open class of their quantity."""
    return load(spark, d, "lineitem").groupBy(edge_index("l_quantity", [5, 10, 20, 40]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def right_closed_classes(spark, d):
    return load(spark, d, "lineitem").groupBy(edge_index("l_quantity", [5, 10, 20, 40], right=True).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def clipped_balances(spark, d):
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(clip(F.col("c_acctbal"), 0, 5000)), 2).cast("double").alias("balance"))


def first_known_cells(spark, d):
    """The first cell that is known of an event: where to, else where from."""
    return load(spark, d, "ledger").groupBy(first_positive("to_cell", "from_cell").alias("cell")).agg(F.count_distinct(EVENT).alias("events"))


def replicated_lines(spark, d):
    """Order lines repeated by their number modulo four, by slot."""
    return generators.replicated(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), F.col("l_linenumber") % 4).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def shifted_segments(spark, d):
    """Customers by nation shifted by their key, modulo 25."""
    return load(spark, d, "customer").groupBy(generators.shifted_category("c_nationkey", 25, F.col("c_custkey") % 7).alias("nation")).agg(F.count(F.lit(1)).alias("n"))


def county_shares(spark, d):
    n = persons(spark, d).where("county is not null").groupBy("state", "county").agg(F.count(F.lit(1)).alias("n"))
    return n.select("county", F.round(windows.share_of_total("n", ["state"]), 10).alias("share"))


def one_to_one_nations(spark, d):
    a, b = load(spark, d, "nation").select("n_nationkey", "n_name"), load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.one_to_one(a, b, ["n_nationkey"])


def corrected_prevalence(spark, d):
    c = load(spark, d, "lineitem").groupBy("l_linestatus").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("p"))
    return c.select("l_linestatus", F.round(rogan_gladen("p", 0.9, 0.95), 9).alias("prevalence"))


def advanced_stock(spark, d):
    """Persons by band one month on, a twelfth of a year's share of each band moving to the next."""
    cells = persons(spark, d).where("age between 0 and 110 and sex is not null").groupBy("sex", band("age").alias("band")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    names = [b[0] for b in RATE_BANDS]
    following = spark.createDataFrame([(b[0], names[i + 1] if i + 1 < len(names) else None, float(b[2] - b[1] + 1)) for i, b in enumerate(RATE_BANDS)], "band string, next string, width double")
    return projection.advance_month(cells, ["sex"], "band", "n", following).select("sex", "band", F.round("n", 7).alias("n"))


def width_errors(spark, d):
    n = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").cast("double").alias("m"), F.max("c_acctbal").cast("double").alias("hi"), F.min("c_acctbal").cast("double").alias("lo"))
    return n.select("c_nationkey", F.round(tail.width_relative_error(F.col("m"), F.lit(4500.0), F.col("hi") - F.col("lo"), 1.0), 9).alias("error"))


def allocation_regret(spark, d):
    """Customers per nation against an equal allocation."""
    n = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("need"))
    mean = n.agg(F.avg("need").alias("given"))
    out = scoring.allocation_regret(n.crossJoin(F.broadcast(mean)), "c_nationkey", "need", "given")
    return out.select(F.round("unmet", 6).alias("unmet"), F.round("wasted", 6).alias("wasted"))


def numbered_customers(spark, d):
    """Contiguous ids of a kind in the order of balance and key."""
    return generators.numbered(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "enterprise", ["c_acctbal", "c_custkey"], "id").select("c_custkey", "id")


def made_ids(spark, d):
    """Ids made of a kind and a number, and whether a bit is set in the key."""
    return load(spark, d, "supplier").select("s_suppkey", entity_id(4, "s_suppkey").alias("id"), has_flag("s_suppkey", 2).alias("flag"))


def broad_death_rates(spark, d):
    """Death rates in broad bands, rolled up from the fine ones."""
    e = county_exposure(spark, d).withColumn("broad", F.when(F.col("band") == "0-17", BROAD_BANDS[0][0]).when(F.col("band").isin("18-44", "45-64"), BROAD_BANDS[1][0]).when(F.col("band").isNotNull(), BROAD_BANDS[2][0]))
    out = rates.rates(e, [["sex", "broad"]], "deaths", "months")
    return out.select("sex", "broad", "deaths", "months", F.round("rate", 10).alias("rate"))


# sources and sinks


def csv_round_trip(spark, d):
    """A table written as CSV with six decimals and read back under its schema."""
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    return files.expect_columns(files.published(rows, f"{checkpoint_dir(spark)}/csv-round-trip", rows.schema), ["s_suppkey", "s_name", "s_acctbal"])


def json_round_trip(spark, d):
    """A table written as one JSON object per row and read back."""
    rows, path = load(spark, d, "nation").select("n_nationkey", "n_name"), f"{checkpoint_dir(spark)}/json-round-trip"
    files.write_document(rows, path)
    return spark.read.schema(rows.schema).json(path)


def signed_tokens(spark, d):
    """64-bit tokens written unsigned and read back signed."""
    c = load(spark, d, "population").select("record_id", known("given_code").alias("token"))
    return c.select("record_id", files.unsigned_to_signed(files.signed_to_unsigned("token")).alias("token"), (files.signed_to_unsigned("token") >= 0).alias("positive")).distinct()


def split_releases(spark, d):
    """Rows of a release with and without an age band, counted."""
    rows = county_exposure(spark, d).select("county", F.when(F.col("county") % 2 == 0, F.col("band")).alias("age_band"), "months")
    core, rate = files.split_blocks(rows, "age_band")
    return core.agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.lit("core")).unionByName(rate.agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.lit("rate")))


QUERIES = {f.__name__: f for f in (
    residence_exposure, horizon_truth, month_sequence, broken_stays, emptied_households, due_discharges, residents_per_dwelling, shock_multipliers, birth_error, churn_fit, income_ratios, ratio_exponent, inclusion_shares,
    fertility_rates, tertiary_projection, rates_by_age, bands_from_ages, raked_paths, rate_additivity, rate_scores, level_gaps, rate_intervals, shrunk_rates, price_fit, leaked_share, control_separation,
    half_open_classes, right_closed_classes, clipped_balances, first_known_cells, replicated_lines, shifted_segments, county_shares, one_to_one_nations, corrected_prevalence, advanced_stock, width_errors,
    allocation_regret, numbered_customers, made_ids, broad_death_rates, csv_round_trip, json_round_trip, signed_tokens, split_releases,
)}

_FIRSTS = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick, (nullif(truth_person_id, 0) IS NULL)::int + (nullif(truth_household_id, 0) IS NULL)::int + (nullif(to_cell, -1) IS NULL)::int
    + (nullif(sex, -1) IS NULL)::int + (birth_tick IS NULL)::int + (nullif(scheduled_end_tick, 0) IS NULL)::int + (nullif(truth_hospital_id, 0) IS NULL)::int + (nullif(truth_encounter_id, 0) IS NULL)::int) AS place FROM ledger) WHERE place = 1),
v AS (SELECT DISTINCT supersedes_event_id AS id FROM ledger WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id),
l AS (SELECT * FROM f WHERE truth_event_id NOT IN (SELECT id FROM v))"""
_LINKS = """a AS (SELECT nullif(given_code, 0) AS g, nullif(family_code, 0) AS fam, nullif(sex, -1) AS s, birth_tick AS ba, count(*) OVER (PARTITION BY nullif(given_code, 0), nullif(family_code, 0), nullif(sex, -1)) AS n FROM population),
b AS (SELECT nullif(given_code, 0) AS g, nullif(family_code, 0) AS fam, nullif(sex, -1) AS s, birth_tick AS bb, count(*) OVER (PARTITION BY nullif(given_code, 0), nullif(family_code, 0), nullif(sex, -1)) AS n FROM income),
links AS (SELECT ba, bb, floor((0 - ba) / 12)::bigint AS age FROM a JOIN b ON a.g = b.g AND a.fam = b.fam AND a.s = b.s WHERE a.n = 1 AND b.n = 1 AND abs(ba - bb) <= 12)"""


def _shape_sql(values: dict[str, float]) -> str:
    return "CASE band " + " ".join(f"WHEN '{b}' THEN {v}::double" for b, v in values.items()) + " END"


_INCOMES = f"""{_P}, x AS (SELECT nullif(county, -1) AS county, avg(employment_income_cents) AS x, count(*) AS n FROM income WHERE nullif(county, -1) IS NOT NULL AND NOT isnan(employment_income_cents) GROUP BY 1),
y AS (SELECT county, avg(income_cents) AS y, count(*) AS m FROM q WHERE county IS NOT NULL AND income_cents IS NOT NULL GROUP BY 1)"""
_RESIDENCE = f"""WITH {_P}, {_FIRSTS}, {_D.replace('first AS', 'first0 AS').replace('FROM first WHERE', 'FROM first0 WHERE').replace('void AS', 'void0 AS').replace('FROM void)', 'FROM void0)')},
pe AS (SELECT truth_person_id, min(sex) AS sex, min(birth_tick) AS birth, min(s) AS s FROM (
  SELECT truth_person_id, sex, birth_tick, 0 AS s FROM p WHERE is_alive UNION ALL SELECT nullif(truth_person_id, 0), nullif(sex, -1), birth_tick, tick FROM l WHERE event_type = 1) GROUP BY 1),
ho AS (SELECT truth_person_id, truth_household_id AS h, 0 AS tick, 0 AS id FROM p WHERE is_alive UNION ALL SELECT nullif(truth_person_id, 0), nullif(truth_household_id, 0), tick, truth_event_id FROM l WHERE event_type IN (1, 3)),
ce AS (SELECT truth_household_id AS h, floor(cell / 256)::bigint AS county, 0 AS tick, 0 AS id FROM household WHERE cell >= 0
  UNION ALL SELECT nullif(truth_household_id, 0), floor(to_cell / 256)::bigint, tick, truth_event_id FROM l WHERE event_type IN (3, 4) AND nullif(to_cell, -1) IS NOT NULL),
pm AS (SELECT pe.*, m FROM pe LEFT JOIN deaths USING (truth_person_id), range(1, 61) t(m) WHERE truth_person_id IS NOT NULL AND sex IS NOT NULL AND birth IS NOT NULL AND m >= s AND (died IS NULL OR m < died)),
ph AS (SELECT pm.truth_person_id, sex, birth, m, arg_max(coalesce(h, -1), (tick, id)) AS h FROM pm JOIN ho ON ho.truth_person_id = pm.truth_person_id AND ho.tick <= m GROUP BY 1, 2, 3, 4),
pc AS (SELECT sex, floor((m - birth) / 12)::bigint AS age, arg_max(county, (tick, id)) AS county FROM ph JOIN ce ON ce.h = ph.h AND ce.tick <= m WHERE ph.h >= 0 GROUP BY truth_person_id, sex, birth, m)"""
_BROAD = "CASE WHEN band = '0-17' THEN '0-17' WHEN band IN ('18-44', '45-64') THEN '18-64' WHEN band IS NOT NULL THEN '65+' END"
_FIT = """z AS (SELECT l_extendedprice::double AS y, l_quantity::double AS a, l_discount::double AS b, l_tax::double AS c, WEIGHT AS w FROM lineitem)"""

ORACLES = {
    "residence_exposure": f"""{_RESIDENCE}
SELECT county, sex, {_band_sql('age', RATE_BANDS)} AS band, count(*) AS months FROM pc WHERE age >= 0 GROUP BY ALL""",
    "horizon_truth": f"""{_RESIDENCE}, z AS (SELECT county, birth, g.state FROM (SELECT ph.truth_person_id, ph.birth, arg_max(ce.county, (tick, id)) AS county FROM ph JOIN ce ON ce.h = ph.h AND ce.tick <= m WHERE m = 60 AND ph.h >= 0 GROUP BY 1, 2) x JOIN geography g USING (county))
SELECT CASE WHEN grouping(state) = 1 THEN 'nation' WHEN grouping(county) = 1 THEN 'state' ELSE 'county' END AS level, CASE WHEN grouping(state) = 1 THEN 0 WHEN grouping(county) = 1 THEN state ELSE county END::bigint AS unit,
  count(*) AS persons, count(*) FILTER (WHERE 60 - birth >= 780) AS elders FROM z GROUP BY GROUPING SETS ((), (state), (state, county))""",
    "month_sequence": f"""WITH e AS (SELECT truth_event_id, min(tick) AS tick, min(event_type) AS k FROM ledger WHERE truth_event_id IS NOT NULL GROUP BY 1)
SELECT truth_event_id, row_number() OVER (PARTITION BY tick ORDER BY CASE k {' '.join(f'WHEN {k} THEN {p}' for k, p in IN_MONTH.items())} END, k, truth_event_id) AS seq FROM e""",
    "broken_stays": f"""WITH {_FIRSTS}, s AS (SELECT truth_encounter_id, event_type, lag(event_type) OVER (PARTITION BY truth_encounter_id ORDER BY tick, truth_event_id) AS b FROM l WHERE event_type IN (10, 11) AND nullif(truth_encounter_id, 0) IS NOT NULL)
SELECT truth_encounter_id, count(*) FILTER (WHERE event_type = 10 AND b = 10) AS opened_twice, count(*) FILTER (WHERE event_type = 11 AND coalesce(b, 11) = 11) AS closed_unopened FROM s GROUP BY 1
HAVING count(*) FILTER (WHERE event_type = 10 AND b = 10) + count(*) FILTER (WHERE event_type = 11 AND coalesce(b, 11) = 11) > 0""",
    "emptied_households": f"WITH {_D} SELECT truth_household_id FROM household WHERE truth_household_id IS NOT NULL AND truth_household_id NOT IN (SELECT truth_household_id FROM person WHERE is_alive AND truth_household_id IS NOT NULL AND truth_person_id NOT IN (SELECT truth_person_id FROM deaths))",
    "due_discharges": f"WITH {_FIRSTS} SELECT nullif(truth_hospital_id, 0) AS truth_hospital_id, count(*) AS n FROM f WHERE event_type = 10 AND tick <= 30 AND nullif(scheduled_end_tick, 0) <= 30 GROUP BY 1",
    "residents_per_dwelling": "SELECT truth_dwelling_id, count(*) AS residents FROM person JOIN household USING (truth_household_id) WHERE is_alive AND is_active AND truth_dwelling_id > 0 GROUP BY 1",
    "shock_multipliers": "SELECT DISTINCT tick, round((CASE (tick - 1) // 12 WHEN 1 THEN 1.3 * 1.1 WHEN 3 THEN 0.8 ELSE 1 END)::double, 9) AS multiplier FROM ledger",
    "birth_error": f"""WITH {_LINKS}, g AS (SELECT {_band_sql('age', RATE_BANDS)} AS band, count(*) AS pairs, sum((ba <> bb)::int)::bigint AS moved FROM links GROUP BY 1)
SELECT band, pairs, moved, round(CASE WHEN pairs >= 50 THEN moved / pairs ELSE sum(moved) OVER () / sum(pairs) OVER () END::double, 9) AS rate FROM g""",
    "churn_fit": f"""WITH r AS (SELECT nullif(county, -1) AS county, {_band_sql('floor((0 - birth_tick) / 12)', RATE_BANDS)} AS band, (nullif(taxpayer_id, 0) NOT IN (SELECT taxpayer_id FROM income WHERE taxpayer_id <> 0))::int AS gone FROM income_preliminary WHERE nullif(taxpayer_id, 0) IS NOT NULL AND nullif(county, -1) IS NOT NULL AND birth_tick IS NOT NULL),
c AS (SELECT county, band, count(*)::double AS n, avg(gone)::double AS rate FROM r GROUP BY 1, 2),
s AS (SELECT county, n, greatest(rate - {_shape_sql(MORTALITY)}, 0) AS r, {_shape_sql(MOBILITY)} AS a, {_shape_sql(ERROR)} AS b FROM c),
t AS (SELECT sum(n * a * a) AS aa, sum(n * a * b) AS ab, sum(n * b * b) AS bb, sum(n * a * r) AS ar, sum(n * b * r) AS br, sum(n) AS n, sum(n * a) AS na, sum(n * b) AS nb FROM s),
x AS (SELECT *, (ar * bb - br * ab) / (aa * bb - ab * ab) AS x, (br * aa - ar * ab) / (aa * bb - ab * ab) AS y, greatest(ar / aa, 0) AS ea, greatest(br / bb, 0) AS eb FROM t),
m AS (SELECT CASE WHEN x >= 0 AND y >= 0 THEN x WHEN ea * ar >= eb * br THEN ea ELSE 0 END AS ma, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN ea * ar >= eb * br THEN 0 ELSE eb END AS mb, n, na, nb FROM x),
h AS (SELECT s.*, ma, mb, (ma * a + mb * b) / ((ma * na + mb * nb) / m.n) AS q FROM s, m),
p AS (SELECT county, ma, mb, sum(n * r * q) AS d, sum(n * q * q) AS e FROM h GROUP BY ALL),
u AS (SELECT sum(d) / sum(e) AS mu, greatest((sum(d * d / e) - sum(d) * sum(d) / sum(e) - (count(*) - 1) * sum(d) / sum(e)) / nullif(sum(e) - sum(e * e) / sum(e), 0), 0) AS v FROM p),
z AS (SELECT p.*, mu, CASE WHEN v > 0 THEN e / (e + mu / v) ELSE 0 END AS z FROM p, u)
SELECT county, round(d / e, 7) AS raw, round(z, 7) AS weight, round(greatest(z * d / e + (1 - z) * mu, 0), 7) AS kappa, round(ma, 7) AS mix_mobility, round(mb, 7) AS mix_error FROM z""",
    "income_ratios": f"WITH {_INCOMES} SELECT county, round(CASE WHEN n >= 30 AND m >= 30 AND y > 0 THEN greatest(0.5, least(2.0, x / y)) ELSE 1 END, 9)::double AS ratio FROM x JOIN y USING (county)",
    "ratio_exponent": f"WITH {_INCOMES}, j AS (SELECT ln(x / avg(x) OVER ()) AS lx, ln(y / avg(y) OVER ()) AS ly FROM x JOIN y USING (county)) SELECT round(greatest(-5, least(5, sum(lx * ly) / sum(lx * lx))), 8)::double AS exponent FROM j",
    "inclusion_shares": f"""WITH {_P}, s AS (SELECT nullif(county, -1) AS county, count(*) AS s FROM population GROUP BY 1), e AS (SELECT county, state, count(*) AS e FROM q WHERE county IS NOT NULL AND is_alive GROUP BY 1, 2),
g AS (SELECT state, sum(coalesce(s, 0))::double AS s, sum(e)::double AS e FROM e LEFT JOIN s USING (county) GROUP BY 1)
SELECT state, round(least(1, e / (e + 25) * s / e + 25 / (e + 25) * (sum(s) OVER () / sum(e) OVER ())), 9)::double AS inclusion FROM g""",
    "fertility_rates": f"WITH {_P}, c AS (SELECT state, count(*) FILTER (WHERE age = 0) AS infants, count(*) FILTER (WHERE sex = 1 AND age BETWEEN 18 AND 45) AS women FROM q WHERE sex IS NOT NULL GROUP BY 1) SELECT *, round(infants / nullif(women, 0), 9) AS fertility FROM c",
    "tertiary_projection": f"""WITH {_P} SELECT county, round(sum(CASE WHEN education >= 3 THEN w ELSE 0 END) / sum(w), 9) AS share FROM (SELECT county, education, exp(-10 * exp(-9.5 + 0.09 * age)) AS w FROM q WHERE is_alive AND age BETWEEN 15 AND 100 AND county IS NOT NULL AND education IS NOT NULL) GROUP BY 1""",
    "rates_by_age": f"""WITH {_P}, {_D}, {_E}, r AS (SELECT sex, band, round(sum(deaths)::double / sum(months)::double, 10) AS rate FROM e GROUP BY 1, 2 HAVING sum(months) > 0) SELECT sex, age, rate FROM r JOIN (SELECT age, {_band_sql('age', RATE_BANDS)} AS band FROM range(0, 111) t(age)) USING (band)""",
    "bands_from_ages": f"""WITH {_P}, {_D}, a AS (SELECT sex, {_band_sql('age', RATE_BANDS)} AS band, died FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND sex IS NOT NULL AND age BETWEEN 0 AND 110) SELECT sex, band, count(*) AS n, count(died) AS died, round(count(died)::double / count(*), 10) AS rate FROM a GROUP BY 1, 2""",
    "raked_paths": f"""WITH {_P}, {_D}, {_Y}, m AS (SELECT band, sex, avg(deaths) AS m FROM y GROUP BY 1, 2), f AS (SELECT band, sex, coalesce(greatest(0.5, least(2.0, 0.5 / nullif(m / nullif(sum(m) OVER (PARTITION BY band), 0), 0))), 1) AS f FROM m)
SELECT band, sex, year, round((deaths * f)::double, 7) AS raked FROM y JOIN f USING (band, sex)""",
    "advanced_stock": f"""WITH {_P}, c AS (SELECT sex, {_band_sql('age', RATE_BANDS)} AS band, count(*)::double AS n FROM q WHERE age BETWEEN 0 AND 110 AND sex IS NOT NULL GROUP BY 1, 2),
w(band, next, width) AS (VALUES {", ".join(f"('{b[0]}', {repr(RATE_BANDS[i + 1][0]) if i + 1 < len(RATE_BANDS) else 'NULL'}, {b[2] - b[1] + 1}.0::double)" for i, b in enumerate(RATE_BANDS))}),
g AS (SELECT sex, band, n * (1 - CASE WHEN next IS NOT NULL THEN 1 / 12.0::double / width ELSE 0 END) AS n FROM c JOIN w USING (band) UNION ALL SELECT sex, next, n / 12.0::double / width FROM c JOIN w USING (band) WHERE next IS NOT NULL)
SELECT sex, band, round(sum(n), 7) AS n FROM g GROUP BY 1, 2""",
    "rate_additivity": f"""WITH {_P}, {_D}, {_E}, k AS (SELECT county, sex, {_BROAD} AS broad, band, deaths, months FROM e),
fi AS (SELECT county, sex, broad, sum(m) AS x, sum(dd) AS dd FROM (SELECT county, sex, broad, band, sum(months) AS m, sum(deaths) AS dd FROM k GROUP BY ALL HAVING sum(months) > 0) GROUP BY ALL),
br AS (SELECT county, sex, broad, sum(months) + max(CASE WHEN county % 7 = 0 THEN 10 ELSE 0 END) AS x, sum(deaths) AS dd FROM k GROUP BY 1, 2, 3 HAVING sum(months) > 0)
SELECT county, sex, broad, abs(fi.x - br.x)::bigint AS gap_exposure, round(abs(fi.dd - br.dd)::double, 6) AS gap_events FROM fi JOIN br USING (county, sex, broad) WHERE fi.x <> br.x OR fi.dd <> br.dd""",
    "rate_scores": f"""WITH {_P}, {_D}, {_E}, t AS (SELECT state, county, sex, sum(months)::double AS x, sum(deaths)::double / sum(months)::double AS r FROM e WHERE state IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(months) > 0),
s AS (SELECT state, sex, sum(deaths)::double / sum(months)::double AS m FROM e WHERE state IS NOT NULL GROUP BY 1, 2 HAVING sum(months) > 0), j AS (SELECT t.*, CASE WHEN county % 5 <> 0 THEN m END AS m FROM t JOIN s USING (state, sex) WHERE x >= 500 AND r > 0)
SELECT count(*) AS cells, count(*) FILTER (WHERE m IS NULL) AS missing, round(avg(coalesce(abs(m - r) / r, 1)), 8) AS relative_error, round(avg((m + 20 * (greatest(0.5 * m - r, 0) + greatest(r - 1.5 * m, 0))) / r) FILTER (WHERE m IS NOT NULL), 8) AS interval_score FROM j""",
    "level_gaps": f"""WITH {_P}, {_D}, c AS (SELECT state, count(*) FILTER (WHERE died <= 30)::double AS a, count(*) FILTER (WHERE died > 30)::double AS b FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND state IS NOT NULL GROUP BY 1)
SELECT state, round(sqrt(pow(ln(nullif(a, 0) / nullif(b, 0)), 2) + pow(ln(sum(a) OVER () / sum(b) OVER ()), 2)), 8) AS gap FROM c""",
    "rate_intervals": f"WITH {_P}, {_D}, {_E}, r AS (SELECT sex, band, sum(deaths)::double AS n, sum(deaths)::double / sum(months)::double AS r FROM e GROUP BY 1, 2 HAVING sum(deaths) > 0) SELECT sex, band, round(r * exp(-1.645 / sqrt(n)), 9) AS low, round(r * exp(1.645 / sqrt(n)), 9) AS high FROM r",
    "shrunk_rates": f"WITH {_P}, {_D}, c AS (SELECT county, count(*)::double AS n, count(died)::double AS k FROM q LEFT JOIN deaths USING (truth_person_id) WHERE is_alive AND county IS NOT NULL GROUP BY 1) SELECT county, round(n / (n + 50) * k / n + 50 / (n + 50) * (sum(k) OVER () / sum(n) OVER ()), 9) AS shrunk FROM c",
    "control_separation": """WITH f AS (SELECT s_nationkey, o_orderpriority, year(l_shipdate) AS y, avg(l_discount) > 0.05 AS failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)
SELECT s_nationkey, o_orderpriority, count(*) AS worlds, count(*) FILTER (WHERE failed) AS failed_worlds, count(*) FILTER (WHERE failed) = count(*) AS separates FROM f GROUP BY 1, 2""",
    "half_open_classes": "SELECT (l_quantity >= 5)::int + (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 40)::int AS class, count(*) AS n FROM lineitem GROUP BY 1",
    "right_closed_classes": "SELECT (l_quantity > 5)::int + (l_quantity > 10)::int + (l_quantity > 20)::int + (l_quantity > 40)::int AS class, count(*) AS n FROM lineitem GROUP BY 1",
    "clipped_balances": "SELECT c_nationkey, round(sum(greatest(0, least(5000, c_acctbal))), 2)::double AS balance FROM customer GROUP BY 1",
    "first_known_cells": "SELECT coalesce(CASE WHEN to_cell >= 0 THEN to_cell END, CASE WHEN from_cell >= 0 THEN from_cell END) AS cell, count(DISTINCT truth_event_id) AS events FROM ledger GROUP BY 1",
    "replicated_lines": "SELECT slot, count(*) AS n FROM (SELECT unnest(range(0, l_linenumber % 4))::int AS slot FROM lineitem) GROUP BY 1",
    "shifted_segments": "SELECT (c_nationkey + c_custkey % 7) % 25 AS nation, count(*) AS n FROM customer GROUP BY 1",
    "county_shares": f"WITH {_P}, n AS (SELECT state, county, count(*)::double AS n FROM q WHERE county IS NOT NULL GROUP BY 1, 2) SELECT county, round(n / sum(n) OVER (PARTITION BY state), 10) AS share FROM n",
    "one_to_one_nations": "SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "corrected_prevalence": "SELECT l_linestatus, round(greatest(0, least(1, (avg((l_returnflag = 'R')::int) - 0.05) / 0.85)), 9)::double AS prevalence FROM lineitem GROUP BY 1",
    "width_errors": "SELECT c_nationkey, round(abs(avg(c_acctbal)::double - 4500) / greatest(max(c_acctbal)::double - min(c_acctbal)::double, 1), 9) AS error FROM customer GROUP BY 1",
    "allocation_regret": "WITH n AS (SELECT count(*)::double AS n, avg(count(*)) OVER () AS m FROM customer GROUP BY c_nationkey) SELECT round(sum(greatest(n - m, 0)), 6) AS unmet, round(sum(greatest(m - n, 0)), 6) AS wasted FROM n",
    "numbered_customers": "SELECT c_custkey, (4::bigint << 56) + row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer",
    "made_ids": "SELECT s_suppkey, (4::bigint << 56) + s_suppkey AS id, (s_suppkey & 4) <> 0 AS flag FROM supplier",
    "broad_death_rates": f"WITH {_P}, {_D}, {_E} SELECT sex, {_BROAD} AS broad, sum(deaths)::bigint AS deaths, sum(months)::bigint AS months, round(CASE WHEN sum(months) > 0 THEN sum(deaths)::double / sum(months)::double END, 10) AS rate FROM e GROUP BY 1, 2",
    "csv_round_trip": "SELECT s_suppkey, s_name, round(s_acctbal::double, 6) AS s_acctbal FROM supplier",
    "json_round_trip": "SELECT n_nationkey, n_name FROM nation",
    "signed_tokens": "SELECT DISTINCT record_id, nullif(given_code, 0) AS token, CASE WHEN nullif(given_code, 0) IS NOT NULL THEN true END AS positive FROM population",
    "split_releases": f"WITH {_P}, {_D}, {_E} SELECT CASE WHEN county % 2 = 0 AND band IS NOT NULL THEN 'rate' ELSE 'core' END AS block, count(*) AS n FROM e GROUP BY 1",
}
