"""Queries of the data problems that concern the ledger and the registers, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import as_known, change_feed, deliveries, intervals, late_events, snapshots
from tallyfold.session import stored
from tallyfold.sources.tables import known, load, without_codes

#: Event types of the ledger.
BIRTH, FORMED, MOVED, CLOSED, JOB_STARTED, JOB_ENDED, ADMITTED = 1, 3, 4, 5, 6, 7, 10
#: Months after which a monthly count is closed to late reports.
LATE_MONTHS = 3

HOUSEHOLD, DWELLING, PERSON, HOSPITAL = "truth_household_id", "truth_dwelling_id", "truth_person_id", "truth_hospital_id"
EVENT, VOIDS, JOB = "truth_event_id", "supersedes_event_id", "truth_job_id"


def first_events(ledger: DataFrame, types: list[int], keep: list[str], ids: list[str] = ()) -> DataFrame:
    """First deliveries of the events of some types, with 0 in ``ids`` read as missing."""
    rows = without_codes(ledger.where(F.col("event_type").isin(types)), ids=list(ids))
    return deliveries.first_deliveries(rows, EVENT, "recorded_tick", keep)


def admission_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of the monthly admissions of each hospital, re-derived from the counts of their costs."""
    ledger = load(spark, folder, "ledger")
    first = first_events(ledger, [ADMITTED], ["tick", HOSPITAL, "cost_cents"], [HOSPITAL, "cost_cents"])
    state = stored(late_events.multiset_state(first, [HOSPITAL], "tick", "recorded_tick", LATE_MONTHS, "cost_cents"), "admissions")
    return late_events.period_versions(state, [HOSPITAL], "tick", LATE_MONTHS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.corrections(admission_versions(spark, folder), [HOSPITAL], "tick", "recorded_tick").select(HOSPITAL, "tick", "recorded_tick")


def p2_versions(spark: SparkSession, folder: str) -> DataFrame:
    return admission_versions(spark, folder)


def household_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Household events, each once, without the void ones."""
    ledger = load(spark, folder, "ledger")
    first = first_events(ledger, [FORMED, MOVED, CLOSED], ["tick", "event_type", HOUSEHOLD, DWELLING], [HOUSEHOLD, DWELLING])
    return deliveries.not_withdrawn(first, deliveries.withdrawals(ledger, EVENT, VOIDS), EVENT)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The state of households after every household event that came and is not void, in the order of (tick, id).

    Numbers that are missing hold nothing here: a gap in the ids says nothing about the events that did come.
    """
    ledger = without_codes(load(spark, folder, "ledger"), ids=[HOUSEHOLD, DWELLING, VOIDS])
    log = change_feed.numbered_log(
        ledger, F.col(EVENT), F.col(VOIDS), "tick", "recorded_tick", ["event_type", HOUSEHOLD, DWELLING], F.col("event_type").isin(FORMED, MOVED, CLOSED),
    )
    return change_feed.replay_numbered(log, HOUSEHOLD, [DWELLING], F.col("event_type").isNotNull(), F.col("event_type") == CLOSED, hold=False)


def p3_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    """How far the state could be exposed after each recorded month."""
    return change_feed.watermarks(household_changes(spark, folder), "tick", "recorded_tick")


def p4_known(spark: SparkSession, folder: str) -> DataFrame:
    """Every admission with the household and dwelling of its patient as known, and as the opening tables have them."""
    ledger = load(spark, folder, "ledger")
    ids = [PERSON, HOUSEHOLD, DWELLING]
    voided = deliveries.withdrawals(ledger, EVENT, VOIDS, "recorded_tick")
    first = stored(first_events(ledger, [BIRTH, FORMED, MOVED, ADMITTED], ["tick", "event_type", *ids], ids), "first")
    admissions = first.where(F.col("event_type") == ADMITTED).select(EVENT, "tick", "recorded_tick", PERSON)
    changes = first.where(F.col("event_type").isin(BIRTH, FORMED, MOVED)).join(voided, EVENT, "left")
    changes = changes.select(F.col(EVENT).alias("o"), F.col("tick").alias("holds"), F.col("recorded_tick").alias("known"), F.col("withdrawn_at").alias("void"), "event_type", *ids)
    where = ("holds", "o", "known", "void")
    person = load(spark, folder, "person").select(PERSON, known(HOUSEHOLD).alias("base_household"))
    household = load(spark, folder, "household").select(known(HOUSEHOLD).alias("h"), known(DWELLING).alias("base_dwelling"))
    of_person = changes.where(F.col("event_type").isin(BIRTH, FORMED)).select(PERSON, "holds", "o", "known", "void", F.col(HOUSEHOLD).alias("seen_household"))
    of_household = changes.where(F.col("event_type").isin(FORMED, MOVED)).select(HOUSEHOLD, "holds", "o", "known", "void", F.col(DWELLING).alias("seen_dwelling"))
    housed = as_known.as_known(admissions, of_person, PERSON, "tick", "recorded_tick", ["seen_household"], *where, seen="in_ledger").join(person, PERSON, "left")
    housed = housed.withColumn(HOUSEHOLD, F.when(F.col("in_ledger"), F.col("seen_household")).otherwise(F.col("base_household"))).drop("in_ledger")
    housed = stored(housed, "housed")
    dwelt = as_known.as_known(housed, of_household, HOUSEHOLD, "tick", "recorded_tick", ["seen_dwelling"], *where, seen="in_ledger")
    current = household.select(F.col("h").alias(HOUSEHOLD), F.col("base_dwelling").alias("listed_dwelling"))
    dwelt = dwelt.join(current, HOUSEHOLD, "left").join(household.withColumnRenamed("h", "base_household"), "base_household", "left")
    return dwelt.select(
        EVENT, HOUSEHOLD, F.when(F.col("in_ledger"), F.col("seen_dwelling")).otherwise(F.col("listed_dwelling")).alias(DWELLING), "base_household", "base_dwelling"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p4_known(spark, folder).where(F.col(HOUSEHOLD).isNotNull() & F.col(DWELLING).isNotNull())
    same = F.col(HOUSEHOLD).eqNullSafe(F.col("base_household")) & F.col(DWELLING).eqNullSafe(F.col("base_dwelling"))
    return found.where(~same).select(EVENT, HOUSEHOLD, DWELLING)


INCOME_IDS = ["household_id", "given_code", "family_code", "employer_id"]


def income_register(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return without_codes(load(spark, folder, name), ids=["taxpayer_id", *INCOME_IDS], codes=["sex", "county"], amounts=["employment_income_cents"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    content = [c for c in load(spark, folder, "income").columns if c not in ("record_id", "taxpayer_id")]
    before, after = income_register(spark, folder, "income_preliminary"), income_register(spark, folder, "income")
    return snapshots.snapshot_changes(before, after, "taxpayer_id", content)


def job_spans(spark: SparkSession, folder: str) -> DataFrame:
    """One span per job: from its start, or before all ticks, to its end, or beyond all ticks."""
    ledger = load(spark, folder, "ledger")
    first = first_events(ledger, [JOB_STARTED, JOB_ENDED], ["tick", "event_type", JOB, PERSON], [JOB, PERSON])
    voided = deliveries.withdrawals(ledger, EVENT, VOIDS).withColumn("void", F.lit(True))
    events = first.join(voided, EVENT, "left").where(F.col(JOB).isNotNull())
    valid = F.col("void").isNull()
    jobs = events.groupBy(JOB).agg(
        F.max(PERSON).alias(PERSON),
        F.min(F.when(valid & (F.col("event_type") == JOB_STARTED), F.col("tick"))).alias("start"),
        F.max(F.when(valid & (F.col("event_type") == JOB_ENDED), F.col("tick"))).alias("end"),
        F.max(valid).alias("any"),
    )
    never, always = F.lit(-(2**62)), F.lit(2**62)
    return stored(jobs.where("any").select(PERSON, F.coalesce("start", never).alias("start"), F.coalesce("end", always).alias("end")), "spans")


#: Months of starts that are put in order together; what earlier months cover is carried in.
SPAN_MONTHS = 24


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.gaps(job_spans(spark, folder), PERSON, "start", "end", F.floor(F.col("start") / SPAN_MONTHS), ("gap_start_tick", "gap_end_tick"))


def p6_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods in work; NULL stands for an open start or end."""
    found = intervals.periods(job_spans(spark, folder), PERSON, "start", "end", F.floor(F.col("start") / SPAN_MONTHS))
    shown = lambda c: F.when(F.abs(c) < 2**62, F.col(c))
    return found.select(PERSON, shown("start").alias("period_start_tick"), shown("end").alias("period_end_tick"))


QUERIES = {
    "p2_found": p2_found, "p2_versions": p2_versions, "p3_found": p3_found, "p3_watermarks": p3_watermarks,
    "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_periods": p6_periods,
}

#: First deliveries: the earliest, among equals the fullest.
_FIRST = """first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY truth_event_id ORDER BY recorded_tick,
      (nullif(truth_person_id, 0) IS NULL)::int + (nullif(truth_household_id, 0) IS NULL)::int + (nullif(truth_dwelling_id, 0) IS NULL)::int
      + (nullif(truth_hospital_id, 0) IS NULL)::int + (nullif(truth_job_id, 0) IS NULL)::int + (nullif(cost_cents, 0) IS NULL)::int + (tick IS NULL)::int) AS place
    FROM ledger) WHERE place = 1),
void AS (
  SELECT supersedes_event_id AS id, min(recorded_tick) AS since FROM ledger
  WHERE supersedes_event_id <> 0 AND supersedes_event_id <> truth_event_id GROUP BY 1)"""

_SPANS = """jobs AS (
  SELECT truth_job_id, max(nullif(truth_person_id, 0)) AS truth_person_id,
    min(tick) FILTER (WHERE event_type = 6 AND v.id IS NULL) AS s, max(tick) FILTER (WHERE event_type = 7 AND v.id IS NULL) AS e
  FROM first f LEFT JOIN void v ON f.truth_event_id = v.id
  WHERE event_type IN (6, 7) AND truth_job_id <> 0 GROUP BY 1 HAVING bool_or(v.id IS NULL)),
spans AS (
  SELECT truth_person_id, coalesce(s, -1000000) AS s, coalesce(e, 1000000) AS e FROM jobs
  WHERE truth_person_id IS NOT NULL AND coalesce(e, 1000000) > coalesce(s, -1000000)),
islands AS (
  SELECT *, max(e) OVER (PARTITION BY truth_person_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)"""

ORACLES = {
    "p2_found": f"""WITH {_FIRST}
SELECT DISTINCT truth_hospital_id, tick, recorded_tick FROM first
WHERE event_type = 10 AND truth_hospital_id <> 0 AND recorded_tick - tick BETWEEN 1 AND 3""",
    "p2_versions": f"""WITH {_FIRST},
a AS (SELECT truth_hospital_id, tick, greatest(recorded_tick - tick, 0) AS late, nullif(cost_cents, 0) AS cost FROM first WHERE event_type = 10 AND truth_hospital_id <> 0),
v AS (SELECT truth_hospital_id, tick, late AS version, count(*) AS n_new FROM a WHERE late <= 3 GROUP BY ALL)
SELECT v.truth_hospital_id, v.tick, v.version::int AS version, v.n_new, count(*) AS n, count(DISTINCT cost) AS n_distinct, min(cost) AS min_value, max(cost) AS max_value, median(cost) AS median_value
FROM v JOIN a ON a.truth_hospital_id = v.truth_hospital_id AND a.tick = v.tick AND a.late <= v.version GROUP BY ALL""",
    "p3_found": f"""WITH {_FIRST},
h AS (SELECT nullif(truth_household_id, 0) AS truth_household_id, nullif(truth_dwelling_id, 0) AS truth_dwelling_id, event_type,
    row_number() OVER (PARTITION BY truth_household_id ORDER BY tick DESC, truth_event_id DESC) AS back
  FROM first WHERE event_type IN (3, 4, 5) AND truth_event_id NOT IN (SELECT id FROM void))
SELECT truth_household_id, truth_dwelling_id FROM h WHERE back = 1 AND event_type <> 5 AND truth_household_id IS NOT NULL""",
    "p3_watermarks": f"""WITH {_FIRST},
c AS (SELECT tick, recorded_tick FROM first WHERE event_type IN (3, 4, 5) AND truth_event_id NOT IN (SELECT id FROM void)),
d AS (SELECT tick, max(max(recorded_tick)) OVER (ORDER BY tick) AS done FROM c GROUP BY tick)
SELECT r.recorded_tick, max(d.tick) AS watermark FROM (SELECT DISTINCT recorded_tick FROM c) r LEFT JOIN d ON d.done <= r.recorded_tick GROUP BY 1""",
    "p4_found": f"""WITH {_FIRST},
k AS (SELECT f.*, v.since FROM first f LEFT JOIN void v ON f.truth_event_id = v.id),
a AS (SELECT truth_event_id AS id, tick AS t, recorded_tick AS r, nullif(truth_person_id, 0) AS p FROM first WHERE event_type = 10),
ph AS (SELECT a.id, arg_max(nullif(k.truth_household_id, 0), (k.tick, k.truth_event_id)) AS h, count(*) AS n,
    arg_max(coalesce(nullif(k.truth_household_id, 0), -1), (k.tick, k.truth_event_id)) AS hh
  FROM a JOIN k ON k.event_type IN (1, 3) AND k.truth_person_id = a.p AND k.tick <= a.t AND k.recorded_tick <= a.r AND (k.since IS NULL OR k.since > a.r) GROUP BY 1),
b AS (SELECT a.*, p.truth_household_id AS base_h, CASE WHEN ph.id IS NOT NULL THEN nullif(ph.hh, -1) ELSE nullif(p.truth_household_id, 0) END AS h
  FROM a LEFT JOIN ph USING (id) LEFT JOIN person p ON p.truth_person_id = a.p),
hd AS (SELECT b.id, arg_max(coalesce(nullif(k.truth_dwelling_id, 0), -1), (k.tick, k.truth_event_id)) AS d
  FROM b JOIN k ON k.event_type IN (3, 4) AND k.truth_household_id = b.h AND k.tick <= b.t AND k.recorded_tick <= b.r AND (k.since IS NULL OR k.since > b.r) GROUP BY 1),
z AS (SELECT b.id, b.h, b.base_h, bd.truth_dwelling_id AS base_d, CASE WHEN hd.id IS NOT NULL THEN nullif(hd.d, -1) ELSE nullif(hh.truth_dwelling_id, 0) END AS d
  FROM b LEFT JOIN hd USING (id) LEFT JOIN household hh ON hh.truth_household_id = b.h LEFT JOIN household bd ON bd.truth_household_id = b.base_h)
SELECT id AS truth_event_id, h AS truth_household_id, d AS truth_dwelling_id FROM z
WHERE h IS NOT NULL AND d IS NOT NULL AND NOT (h IS NOT DISTINCT FROM base_h AND d IS NOT DISTINCT FROM base_d)""",
    "p5_found": """WITH both_of AS (
  SELECT 'a' AS side, * FROM income_preliminary UNION ALL SELECT 'b', * FROM income),
c AS (SELECT DISTINCT side, taxpayer_id, row(nullif(household_id, 0), nullif(given_code, 0), nullif(family_code, 0), birth_tick, nullif(sex, -1), nullif(county, -1),
    CASE WHEN isnan(employment_income_cents) THEN NULL ELSE employment_income_cents END, nullif(employer_id, 0)) AS content
  FROM both_of WHERE taxpayer_id <> 0),
k AS (SELECT taxpayer_id, content, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM c GROUP BY 1, 2),
t AS (SELECT taxpayer_id, bool_or(a) AS a, bool_or(b) AS b, bool_or(a <> b) AS d FROM k GROUP BY 1)
SELECT taxpayer_id, CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' ELSE 'changed' END AS change FROM t WHERE d""",
    "p6_found": f"""WITH {_FIRST}, {_SPANS}
SELECT truth_person_id, reach AS gap_start_tick, s AS gap_end_tick FROM islands WHERE s > reach""",
    "p6_periods": f"""WITH {_FIRST}, {_SPANS},
n AS (SELECT *, sum((reach IS NULL OR s > reach)::int) OVER (PARTITION BY truth_person_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM islands)
SELECT truth_person_id, nullif(min(s), -1000000) AS period_start_tick, nullif(max(e), 1000000) AS period_end_tick FROM n GROUP BY truth_person_id, island""",
}
