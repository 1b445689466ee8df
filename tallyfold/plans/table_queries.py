"""Queries over the star schema and grids: order statistics, tails, reserves, scores, rasters, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.scalars import half_even, normal, uniform
from tallyfold.operators import aggregates as agg
from tallyfold.operators import bitemporal as bt
from tallyfold.operators import generators as gen
from tallyfold.operators import projection, raster, scoring, survey, tail, windows
from tallyfold.sources.files import inventory, tree_digest
from tallyfold.sources.tables import load
from tallyfold.streaming import late_counts

MEMBERS = 64


def weighted_median(spark, d):
    return agg.weighted_median(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


def disc_quantile_p95(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(agg.order_statistic(0.95, "l_extendedprice").alias("p95"))


def quantile_higher(spark, d):
    return agg.quantile_higher(load(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9)


def distinct_per_group(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def gini(spark, d):
    return agg.gini(load(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", F.round("gini", 8).alias("gini"))


def weighted_line(spark, d):
    out = agg.weighted_line(load(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"), 1 + F.col("l_discount"))
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def moments(spark, d):
    """Weighted mean and deviation, effective size, correlation and fit per group."""
    l = load(spark, d, "lineitem")
    w = F.sum("l_quantity")
    mean = F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / w
    return l.groupBy("l_returnflag").agg(
        F.round(mean, 4).alias("mean"), F.round(agg.effective_size("l_quantity"), 4).alias("effective"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("correlation"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 8).alias("r2"), F.round(F.stddev_pop("l_discount"), 8).alias("deviation"),
    )


def rank_uniform(spark, d):
    return windows.rank_uniform(load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_custkey", F.round("rank01", 10).alias("rank01"))


def global_rank(spark, d):
    return windows.rank_uniform(load(spark, d, "customer").select("c_custkey", "c_acctbal"), [], "c_acctbal", "c_custkey").select("c_custkey", F.round("rank01", 10).alias("rank01"))


def quintile_band(spark, d):
    return windows.quintile_band(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "quintile")


def weight_ladder(spark, d):
    return windows.ladder(load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey", 0.5, 2.0).select("c_custkey", F.round("weight", 8).alias("weight"))


def pairwise_slope(spark, d):
    """Median slope of all pairs of yearly totals per priority."""
    y = load(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("t"))
    return windows.pairwise_slope(y, ["o_orderpriority"], "y", "t").select("o_orderpriority", F.round("slope", 2).alias("slope"))


def largest_remainder(spark, d):
    n = load(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("w")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.apportion(n.withColumn("total", F.lit(1000)), ["n_regionkey"], ["n_nationkey"], "w", "total").select("n_regionkey", "n_nationkey", "seats")


def worst_unit(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("z")).select("n_regionkey", (-F.col("z.k")).alias("c_custkey"), F.col("z.c_acctbal").alias("c_acctbal"))


def design_variance(spark, d):
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    rows = load(spark, d, "lineitem").join(s, "l_suppkey")
    out = survey.design_variance(rows, ["l_returnflag"], ["n_regionkey"], "l_suppkey", s, F.col("l_extendedprice") / 1000, "l_quantity")
    return out.select("l_returnflag", F.round("total", 1).alias("total"), F.round(F.sqrt("variance"), 1).alias("error"))


def jackknife_mean(spark, d):
    out = survey.jackknife_mean(load(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round(F.sqrt("variance"), 4).alias("error"))


def losses(spark: SparkSession, d: str) -> DataFrame:
    """An ensemble: member (orders in 64 groups) and region (of the supplier), loss the summed price in whole thousands."""
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("region"))
    rows = load(spark, d, "lineitem").join(s, "l_suppkey").groupBy((F.col("l_orderkey") % MEMBERS).alias("member"), "region").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    return rows.select("member", "region", F.floor(F.col("c") / 100000).cast("double").alias("loss"))


_L = """losses AS (SELECT l_orderkey % 64 AS member, n_regionkey AS region, floor(sum(round(l_extendedprice * 100)::bigint) / 100000)::double AS loss
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def tail_shortfall(spark, d):
    return tail.tail(losses(spark, d), "region", "loss").select("region", F.round("mean", 6).alias("mean"), "quantile", F.round("shortfall", 6).alias("shortfall"))


def exceedance(spark, d):
    l = losses(spark, d)
    return tail.exceedance(l, tail.tail(l, "region", "loss"), "region", "loss", "quantile").select("region", F.round("exceedance", 8).alias("exceedance"))


def pinball(spark, d):
    l = losses(spark, d)
    q = tail.tail(l, "region", "loss").select("region", "quantile")
    return l.join(q, "region").groupBy("region").agg(F.round(F.avg(tail.pinball(F.col("loss"), F.col("quantile"), 0.95)), 4).alias("score"))


def reserve_total(spark, d):
    y = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return y.agg(tail.reserve_total(F.max("n"), "0.1234", "50").alias("total"))


def greedy_fill(spark, d):
    l = losses(spark, d)
    total = float(l.agg(F.floor(F.sum("loss") / MEMBERS)).first()[0] or 0)
    return tail.greedy_fill(l, "region", "loss", total).select("region", F.round("allocation", 4).alias("allocation"))


def reserve_skill(spark, d):
    """Skill of an even allocation between the proportional and the best one."""
    l = losses(spark, d)
    total = float(l.agg(F.floor(F.sum("loss") / MEMBERS)).first()[0] or 0)
    means = l.groupBy("region").agg(F.avg("loss").alias("m"))
    base = tail.uncovered(l, tail.proportional(means, "m", total), "region", "member", "loss").withColumnRenamed("uncovered", "base")
    even = tail.uncovered(l, tail.proportional(means.withColumn("one", F.lit(1.0)), "one", total), "region", "member", "loss").withColumnRenamed("uncovered", "even")
    best = tail.uncovered(l, tail.greedy_fill(l, "region", "loss", total), "region", "member", "loss").withColumnRenamed("uncovered", "best")
    both = base.crossJoin(even).crossJoin(best)
    return both.select(F.round("base", 4).alias("base"), F.round("even", 4).alias("even"), F.round("best", 4).alias("best"), F.round(tail.skill(F.col("base"), F.col("even"), F.col("best")), 4).alias("skill"))


def rate_sweep(spark, d):
    need = losses(spark, d).groupBy("region").agg((F.max("loss") / F.sum("loss") * 10).alias("need"))
    return tail.rate_sweep(need, "region", "need", [0.25 * i for i in range(1, 41)])


def release(spark: SparkSession, d: str) -> DataFrame:
    """A published table over regions and nations, with two faults: one count off, one nation missing."""
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = agg.rollup_levels(c, "n_regionkey", "n_nationkey", {"estimate": F.count(F.lit(1)).cast("double")}).withColumn("estimand", F.lit("persons"))
    r = r.withColumn("estimate", F.when((F.col("level") == "state") & (F.col("unit") == 1), F.col("estimate") + 3).otherwise(F.col("estimate")))
    r = r.where(~((F.col("level") == "county") & (F.col("unit") == 7)))
    return r.select("estimand", "level", "unit", "estimate", (F.col("estimate") * 0.97).alias("low"), (F.col("estimate") * 1.02).alias("high"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = agg.rollup_levels(o, "n_regionkey", "n_nationkey", {"value": F.count_distinct("c_custkey").cast("double")})
    return t.select(F.lit("persons").alias("estimand"), "level", "unit", F.lit("count").alias("kind"), "value")


_R = """c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
r0 AS (SELECT CASE WHEN grouping(n_regionkey) = 1 THEN 'nation' WHEN grouping(n_nationkey) = 1 THEN 'state' ELSE 'county' END AS level,
  CASE WHEN grouping(n_regionkey) = 1 THEN 0 WHEN grouping(n_nationkey) = 1 THEN n_regionkey ELSE n_nationkey END::bigint AS unit, count(*)::double AS e FROM c GROUP BY GROUPING SETS ((), (n_regionkey), (n_regionkey, n_nationkey))),
r AS (SELECT level, unit, CASE WHEN level = 'state' AND unit = 1 THEN e + 3 ELSE e END AS estimate FROM r0 WHERE NOT (level = 'county' AND unit = 7)),
t AS (SELECT CASE WHEN grouping(n_regionkey) = 1 THEN 'nation' WHEN grouping(n_nationkey) = 1 THEN 'state' ELSE 'county' END AS level,
  CASE WHEN grouping(n_regionkey) = 1 THEN 0 WHEN grouping(n_nationkey) = 1 THEN n_regionkey ELSE n_nationkey END::bigint AS unit, count(DISTINCT c_custkey)::double AS value
  FROM orders JOIN c ON o_custkey = c_custkey GROUP BY GROUPING SETS ((), (n_regionkey), (n_regionkey, n_nationkey))),
s AS (SELECT level, abs(estimate - value) / greatest(abs(value), 1) AS error, (value BETWEEN estimate * 0.97 AND estimate * 1.02)::int AS covered,
  estimate * 1.02 - estimate * 0.97 + 20 * (greatest(estimate * 0.97 - value, 0) + greatest(value - estimate * 1.02, 0)) AS interval FROM r JOIN t USING (level, unit)),
scores AS (SELECT level, max(error) AS worst, quantile_disc(error, 0.95) AS p95, avg(error) AS mean_error, avg(covered) AS coverage, avg(interval) AS interval_score, count(*) AS n FROM s GROUP BY GROUPING SETS ((level), ()))"""


def schema_violations(spark, d):
    required = truth(spark, d).select("estimand", "level", "unit", "kind")
    return scoring.release_violations(release(spark, d), required)


def additivity_violations(spark, d):
    n = load(spark, d, "nation")
    parents = n.select(F.lit("county").alias("level"), F.col("n_nationkey").cast("long").alias("unit"), F.lit("state").alias("parent_level"), F.col("n_regionkey").cast("long").alias("parent_unit"))
    parents = parents.unionByName(n.select(F.lit("state").alias("level"), F.col("n_regionkey").cast("long").alias("unit"), F.lit("nation").alias("parent_level"), F.lit(0).cast("long").alias("parent_unit")).distinct())
    return scoring.additivity_violations(release(spark, d), parents)


def score_release(spark, d):
    s = scoring.score_release(release(spark, d), truth(spark, d))
    return s.select("level", *[F.round(c, 6).alias(c) for c in ("worst", "p95", "mean_error", "coverage", "interval_score")], "n")


def composite_gates(spark, d):
    c = scoring.composites(scoring.score_release(release(spark, d), truth(spark, d)))
    values = c.selectExpr("stack(3, 'accuracy', accuracy, 'coverage_gap', coverage_gap, 'interval_quality', interval_quality) as (component, value)")
    bars = spark.createDataFrame([("accuracy", 0.9, True), ("coverage_gap", 0.2, False), ("interval_quality", 1e9, True), ("unpublished", 1.0, False)], "component string, ceiling double, decides boolean")
    return scoring.gates(values, bars).select("component", F.round("value", 5).alias("value"), "ceiling", "decides", "passed")


def additive_reconciled(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("unit"), F.col("n_regionkey").cast("long").alias("region"), F.lit("county").alias("level"))
    rows = release(spark, d).select("level", "unit", "estimate").join(n, ["level", "unit"], "left")
    return survey.additive(rows, "county", "state", "region", ["estimate"]).select("level", "unit", "estimate")


def protected_cells(spark, d):
    cube = load(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return scoring.primary_cells(cube, "n", 12)


def recoverable_cells(spark, d):
    cube = load(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    hidden = cube.withColumn("hidden", F.col("n") < 5)
    return scoring.recoverable_cells(hidden, ["c_nationkey"], [["c_nationkey", "c_mktsegment"], ["c_nationkey", "sign"]], "hidden")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts on a grid of 50 columns; the height is the price in cents."""
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("cell"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.round(F.col("p_retailprice") * 100).cast("long").alias("h"))


_G = "g AS (SELECT p_partkey AS cell, floor(p_partkey / 50)::bigint AS row, p_partkey % 50 AS col, round(p_retailprice * 100)::bigint AS h FROM part)"


def focal_sum(spark, d):
    return raster.focal_sum(grid(spark, d), "h").select("cell", "focal_sum")


def flow_direction(spark, d):
    return raster.flow_direction(raster.on_border(grid(spark, d)), "h", "border").select("cell", "direction")


def flow_accumulation(spark, d):
    """Cells draining through each cell of the surface as it is: its pits are outlets too."""
    g = raster.on_border(grid(spark, d))
    lower = raster.neighbours(g, "h").groupBy("row", "col").agg(F.min("value").alias("low"))
    g = g.join(lower, ["row", "col"], "left").withColumn("ends", F.col("border") | F.coalesce(F.col("low") >= F.col("h"), F.lit(True)))
    g = raster.flow_direction(g, "h", "ends")
    steps = F.array(*[F.lit(50 * a + b) for a, b in raster.NEIGHBOURS])
    edges = g.select("cell", F.when(F.col("direction") >= 0, F.col("cell") + F.get(steps, F.col("direction"))).alias("down"), F.lit(1).alias("w"))
    return raster.accumulate(edges, "cell", "down", "w")


def gradient(spark, d):
    return raster.gradient(grid(spark, d), "h").select("cell", F.round("d_row", 4).alias("d_row"), F.round("d_col", 4).alias("d_col"))


def hillshade(spark, d):
    return raster.hillshade(grid(spark, d).withColumn("z", F.col("h") / 1e5), "z").select("cell", F.round("shade", 6).alias("shade"))


def filled_surface(spark, d):
    g = grid(spark, d).select("row", "col", "cell", F.col("h").cast("double").alias("h"), F.lit(0).alias("world"))
    return raster.whole_grid(g, "world", "h", raster.flooded, "filled").select("cell", "filled")


def gravity(spark, d):
    seats = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("mass")).select(F.col("c_nationkey").alias("place"), F.floor(F.col("c_nationkey") / 5).alias("row"), (F.col("c_nationkey") % 5).alias("col"), "mass")
    return raster.gravity(seats, seats, "mass", 2.0).select("origin", "place", F.round("share", 8).alias("share"))


def settlements(spark, d):
    return raster.seed_settlements(grid(spark, d), "h", 8, 4)


def cohort_step(spark, d):
    from tallyfold.plans.register_queries import persons

    cube = persons(spark, d).where("is_alive and sex is not null and county is not null and age between 0 and 110").groupBy("county", "age", "sex").agg(F.count(F.lit(1)).cast("double").alias("n"))
    survival = spark.range(0, 111).select(F.col("id").alias("age"), F.explode(F.array(F.lit(0), F.lit(1))).alias("sex")).withColumn("p", F.exp(-F.exp(-9.5 + 0.09 * F.col("age"))))
    out = projection.project(cube, ["county"], survival, 0.06, 3)
    return out.groupBy("county").agg(F.round(F.sum("n"), 5).alias("n"))


def present_value(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", "o_totalprice", ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("month"))
    return projection.present_value(o, ["o_orderpriority"], "month", "o_totalprice", 0.03).select("o_orderpriority", F.round("present_value", 1).alias("present_value"))


def rounded_benchmarks(spark, d):
    """Counts per nation rounded to tens, halves to even."""
    c = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return c.select("c_nationkey", half_even(F.col("n"), 10).alias("rounded"))


def member_simulation(spark, d):
    m = losses(spark, d).groupBy("region").agg(F.avg("loss").alias("m")).withColumn("s", F.lit(0.1))
    sim = projection.simulate_members(m, "region", "m", "s", 256, 12)
    return tail.tail(sim, "region", "loss")


def poisson_redraws(spark, d):
    n = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return survey.poisson_redraws(n, "c_nationkey", "n", 20, 6)


def draw_intervals(spark, d):
    return survey.interval_rows(poisson_redraws(spark, d), ["c_nationkey"], "n", 0.0).select("c_nationkey", F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def keyed_numbers(spark, d):
    """Mean and deviation of keyed normals and uniforms over orders."""
    o = load(spark, d, "orders").select(normal(3, "o_orderkey").alias("z"), uniform(4, "o_orderkey").alias("u"))
    return o.agg(F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("deviation"), F.round(F.avg("u"), 6).alias("middle"))


def generated_households(spark, d):
    cells = load(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), F.lit(1.0).alias("w"))
    return gen.household_sizes(gen.population_grid(cells, "w", 5000), "cell", "persons", 8)


def generated_names(spark, d):
    return gen.zipf_choice(load(spark, d, "customer").select("c_custkey"), 500, 1.0, 2, ["c_custkey"], "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def generated_deaths(spark, d):
    return gen.monthly_deaths(load(spark, d, "person"), 1, 5, -9.0, 0.085).select("truth_person_id")


def generated_births(spark, d):
    return gen.monthly_births(load(spark, d, "person"), 1, 5, 0.06)


def table_fingerprint(spark, d):
    return bt.fingerprint(load(spark, d, "lineitem"))


def file_inventory(spark, d):
    return tree_digest(inventory(spark, d))


def streamed_counts(spark, d):
    """Events per day and kind from the event stream, with a watermark; equal to the batch result."""
    schema = load(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = late_counts.windowed_counts(rows, "ts", "1 day", "3 days", ["event_type"])
    done = late_counts.run_once(out, f"counts_{abs(hash(d))}", "complete")
    return done.select(F.date_format("period", "yyyy-MM-dd").alias("day"), "event_type", "n")


def latest_values(spark, d):
    """The last value per user, from the stream."""
    schema = load(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("at", F.struct("ts", "event_id"))
    done = late_counts.run_once(late_counts.latest_state(rows, "user_id", "at", "value"), f"latest_{abs(hash(d))}", "complete")
    return done.select("user_id", "value")


QUERIES = {f.__name__: f for f in (
    weighted_median, disc_quantile_p95, quantile_higher, distinct_per_group, gini, weighted_line, moments, rank_uniform, global_rank, quintile_band, weight_ladder, pairwise_slope, largest_remainder, worst_unit,
    design_variance, jackknife_mean, tail_shortfall, exceedance, pinball, reserve_total, greedy_fill, reserve_skill, rate_sweep, schema_violations, additivity_violations, score_release, composite_gates,
    additive_reconciled, protected_cells, recoverable_cells, focal_sum, flow_direction, flow_accumulation, gradient, hillshade, filled_surface, gravity, settlements, cohort_step, present_value,
    rounded_benchmarks, member_simulation, poisson_redraws, draw_intervals, keyed_numbers, generated_households, generated_names, generated_deaths, generated_births, table_fingerprint, file_inventory,
    streamed_counts, latest_values,
)}

_NEAR = "(VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(raster.NEIGHBOURS)) + ") v(k, dr, dc)"
_FILL = f"""tot AS (SELECT floor(sum(loss) / 64) AS total FROM losses),
seg AS (SELECT region, loss, greatest(loss, 0) - greatest(coalesce(lag(loss) OVER w, 0), 0) AS width, (count(*) OVER (PARTITION BY region) - (row_number() OVER w - 1)) / (count(*) OVER (PARTITION BY region))::double AS slope FROM losses WINDOW w AS (PARTITION BY region ORDER BY loss)),
u AS (SELECT region, least(width, greatest(0, total - coalesce(sum(width) OVER (ORDER BY slope DESC, region, loss ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used, total FROM seg, tot WHERE width > 0),
f AS (SELECT region, sum(used) AS a, max(total) AS total FROM u GROUP BY 1),
best AS (SELECT region, a + CASE WHEN region = min(region) OVER () THEN total - sum(a) OVER () ELSE 0 END AS allocation FROM f)"""

ORACLES = {
    "weighted_median": "SELECT l_returnflag, min(l_extendedprice) AS weighted_median FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS up, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem) WHERE up >= 0.5 * total GROUP BY 1",
    "disc_quantile_p95": "SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1, 2",
    "quantile_higher": "SELECT o_orderpriority, min(o_totalprice) AS quantile_higher FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k > ceil(0.9 * (n - 1)) GROUP BY 1",
    "distinct_per_group": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "gini": "SELECT o_orderpriority, round(2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::double, 8) AS gini FROM (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k FROM orders) GROUP BY 1",
    "weighted_line": "SELECT l_returnflag, round((w * wxy - wx * wy) / (w * wxx - wx * wx), 4) AS slope, round((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 3) AS intercept FROM (SELECT l_returnflag, sum(1 + l_discount) AS w, sum((1 + l_discount) * l_quantity) AS wx, sum((1 + l_discount) * l_extendedprice) AS wy, sum((1 + l_discount) * l_quantity * l_quantity) AS wxx, sum((1 + l_discount) * l_quantity * l_extendedprice) AS wxy FROM lineitem GROUP BY 1)",
    "moments": "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS effective, round(corr(l_quantity, l_extendedprice), 8) AS correlation, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(stddev_pop(l_discount), 8) AS deviation FROM lineitem GROUP BY 1",
    "rank_uniform": "SELECT c_custkey, round(CASE WHEN count(*) OVER p < 2 OR min(c_acctbal) OVER p = max(c_acctbal) OVER p THEN 0.5 ELSE (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER p - 1)::double END, 10) AS rank01 FROM customer WINDOW p AS (PARTITION BY c_nationkey)",
    "global_rank": "SELECT c_custkey, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER () - 1)::double, 10) AS rank01 FROM customer",
    "quintile_band": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN least(4, floor(5 * ((row_number() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER (PARTITION BY c_acctbal > 0) - 1)::double)))::int ELSE 0 END AS quintile FROM customer",
    "weight_ladder": "SELECT c_custkey, round(exp(ln(0.5) + (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER (PARTITION BY c_nationkey) - 1)::double * (ln(2) - ln(0.5))), 8) AS weight FROM customer",
    "pairwise_slope": "WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) SELECT a.o_orderpriority, round(median((b.t - a.t) / (b.y - a.y)), 2) AS slope FROM y a JOIN y b ON a.o_orderpriority = b.o_orderpriority AND a.y < b.y GROUP BY 1",
    "largest_remainder": """WITH w AS (SELECT n_regionkey, n_nationkey, sum(round(c_acctbal * 100)::bigint) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2),
s AS (SELECT *, w::double / (sum(w) OVER (PARTITION BY n_regionkey))::double * 1000 AS s FROM w), f AS (SELECT *, floor(s)::bigint AS f FROM s)
SELECT n_regionkey, n_nationkey, f + (row_number() OVER (PARTITION BY n_regionkey ORDER BY s - f DESC, n_nationkey) <= 1000 - sum(f) OVER (PARTITION BY n_regionkey))::int AS seats FROM f""",
    "worst_unit": "SELECT n_regionkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "design_variance": """WITH s AS (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT n_regionkey, count(*) AS n FROM s GROUP BY 1), x AS (SELECT l_returnflag, n_regionkey, l_suppkey, sum(l_extendedprice / 1000 * l_quantity) AS x FROM lineitem JOIN s ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
t AS (SELECT l_returnflag, n_regionkey, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2)
SELECT l_returnflag, round(sum(s), 1) AS total, round(sqrt(greatest(sum(CASE WHEN n > 1 THEN n / (n - 1)::double * (q - s * s / n) ELSE 0 END), abs(sum(s)))), 1) AS error FROM t JOIN n USING (n_regionkey) GROUP BY 1""",
    "jackknife_mean": """WITH p AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice * l_quantity) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT l_returnflag, sum(x) AS sx, sum(w) AS sw, count(*) AS n FROM p GROUP BY 1)
SELECT l_returnflag, round(max(sx / sw), 4) AS mean, round(sqrt((max(n) - 1) / max(n)::double * sum(((sx - x) / (sw - w) - sx / sw) ** 2)), 4) AS error FROM p JOIN t USING (l_returnflag) GROUP BY 1""",
    "tail_shortfall": f"WITH {_L}, q AS (SELECT region, avg(loss) AS m, quantile_disc(loss, 0.95) AS q FROM losses GROUP BY 1) SELECT region, round(max(m), 6) AS mean, max(q) AS quantile, round(avg(loss) FILTER (WHERE loss >= q), 6) AS shortfall FROM losses JOIN q USING (region) GROUP BY 1",
    "exceedance": f"WITH {_L}, q AS (SELECT region, quantile_disc(loss, 0.95) AS q FROM losses GROUP BY 1) SELECT region, round(avg((loss > q)::int), 8) AS exceedance FROM losses JOIN q USING (region) GROUP BY 1",
    "pinball": f"WITH {_L}, q AS (SELECT region, quantile_disc(loss, 0.95) AS q FROM losses GROUP BY 1) SELECT region, round(avg((0.95 - (loss <= q)::int) * (loss - q)), 4) AS score FROM losses JOIN q USING (region) GROUP BY 1",
    "reserve_total": "SELECT (ceil(max(n) * 0.1234::decimal(12, 6) / 50) * 50)::decimal(38, 0) AS total FROM (SELECT count(*)::decimal(20, 6) AS n FROM orders GROUP BY year(o_orderdate))",
    "greedy_fill": f"WITH {_L}, {_FILL} SELECT region, round(allocation, 4) AS allocation FROM best",
    "reserve_skill": f"""WITH {_L}, {_FILL}, m AS (SELECT region, avg(loss) AS m FROM losses GROUP BY 1), a AS (SELECT region, total * m / sum(m) OVER () AS base, total / count(*) OVER () AS even, allocation AS best FROM m JOIN best USING (region), tot),
j AS (SELECT region, avg(greatest(loss - base, 0)) AS b, avg(greatest(loss - even, 0)) AS e, avg(greatest(loss - best, 0)) AS o FROM losses JOIN a USING (region) GROUP BY 1)
SELECT round(sum(b), 4) AS base, round(sum(e), 4) AS even, round(sum(o), 4) AS best, CASE WHEN sum(b) - sum(o) > 0 THEN round((sum(b) - sum(e)) / (sum(b) - sum(o)), 4) END AS skill FROM j""",
    "rate_sweep": f"WITH {_L}, n AS (SELECT region, max(loss) / sum(loss) * 10 AS need FROM losses GROUP BY 1), g AS (SELECT r, min(1 - r * need) AS worst FROM n, (SELECT 0.25::double * i AS r FROM range(1, 41) t(i)) GROUP BY 1) SELECT max(r) AS rate FROM g WHERE worst >= 0.01",
    "schema_violations": f"""WITH {_R} SELECT 'persons' AS estimand, level, unit, 'missing' AS rule FROM t WHERE (level, unit) NOT IN (SELECT (level, unit) FROM r) UNION ALL SELECT 'persons', level, unit, 'unexpected' FROM r WHERE (level, unit) NOT IN (SELECT (level, unit) FROM t)""",
    "additivity_violations": f"""WITH {_R}, p AS (SELECT r.estimate, 'state' AS level, n_regionkey AS unit FROM r JOIN nation ON level = 'county' AND unit = n_nationkey UNION ALL SELECT estimate, 'nation', 0 FROM r WHERE level = 'state'),
sums AS (SELECT level, unit, sum(estimate) AS summed FROM p GROUP BY 1, 2) SELECT 'persons' AS estimand, level, unit, estimate, summed FROM r JOIN sums USING (level, unit) WHERE abs(estimate - summed) > 1e-6 * greatest(abs(estimate), 1)""",
    "score_release": f"WITH {_R} SELECT level, round(worst, 6) AS worst, round(p95, 6) AS p95, round(mean_error, 6) AS mean_error, round(coverage, 6) AS coverage, round(interval_score, 6) AS interval_score, n FROM scores",
    "composite_gates": f"""WITH {_R}, k AS (SELECT max(p95) AS a, max(abs(coverage - 0.9)) AS b, sum(interval_score * n) / sum(n) AS c FROM scores WHERE level IS NOT NULL),
v AS (SELECT 'accuracy' AS component, a AS value, 0.9::double AS ceiling, true AS decides FROM k UNION ALL SELECT 'coverage_gap', b, 0.2, false FROM k UNION ALL SELECT 'interval_quality', c, 1e9, true FROM k UNION ALL SELECT 'unpublished', NULL, 1.0, false FROM k),
g AS (SELECT *, coalesce(value <= ceiling, false) AS passed FROM v)
SELECT component, round(value, 5) AS value, ceiling, decides, passed FROM g UNION ALL SELECT NULL, NULL, NULL, NULL, bool_and(passed OR NOT decides) FROM g""",
    "additive_reconciled": f"WITH {_R} SELECT level, unit, estimate FROM r WHERE level <> 'state' UNION ALL SELECT 'state', n_regionkey::bigint, sum(estimate) FROM r JOIN nation ON level = 'county' AND unit = n_nationkey GROUP BY 2",
    "protected_cells": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) < 12",
    "focal_sum": f"WITH {_G} SELECT a.cell, sum(b.h)::bigint AS focal_sum FROM g a, (SELECT i AS dr, j AS dc FROM range(-1, 2) x(i), range(-1, 2) y(j)) v JOIN g b ON b.row = a.row + v.dr AND b.col = a.col + v.dc GROUP BY 1",
    "flow_direction": f"""WITH {_G}, n AS (SELECT a.cell, v.k, a.h - b.h AS drop FROM g a, {_NEAR} JOIN g b ON b.row = a.row + v.dr AND b.col = a.col + v.dc),
m AS (SELECT cell, arg_min(k, (-drop, k)) AS k FROM n GROUP BY 1 HAVING count(*) = 8) SELECT g.cell, coalesce(m.k, -1) AS direction FROM g LEFT JOIN m USING (cell)""",
    "flow_accumulation": f"""WITH RECURSIVE {_G}, n AS (SELECT a.cell, b.cell AS to_cell, v.k, a.h - b.h AS drop FROM g a, {_NEAR} JOIN g b ON b.row = a.row + v.dr AND b.col = a.col + v.dc),
m AS (SELECT cell, arg_min(to_cell, (-drop, k)) AS down FROM n GROUP BY 1 HAVING count(*) = 8 AND max(drop) > 0),
w AS (SELECT cell, cell AS here FROM g UNION ALL SELECT w.cell, m.down FROM w JOIN m ON m.cell = w.here) SELECT here AS cell, count(*)::double AS total FROM w GROUP BY 1""",
    "gradient": f"""WITH {_G}, s AS (SELECT cell, h, lag(h) OVER r AS ra, lead(h) OVER r AS rb, lag(h) OVER c AS ca, lead(h) OVER c AS cb FROM g WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col))
SELECT cell, round(CASE WHEN ra IS NULL AND rb IS NULL THEN 0 WHEN ra IS NULL THEN rb - h WHEN rb IS NULL THEN h - ra ELSE (rb - ra) / 2 END, 4)::double AS d_row, round(CASE WHEN ca IS NULL AND cb IS NULL THEN 0 WHEN ca IS NULL THEN cb - h WHEN cb IS NULL THEN h - ca ELSE (cb - ca) / 2 END, 4)::double AS d_col FROM s""",
    "hillshade": f"""WITH {_G}, z AS (SELECT cell, row, col, h / 1e5::double AS h FROM g), s AS (SELECT cell, h, lag(h) OVER r AS ra, lead(h) OVER r AS rb, lag(h) OVER c AS ca, lead(h) OVER c AS cb FROM z WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)),
d AS (SELECT cell, CASE WHEN ra IS NULL AND rb IS NULL THEN 0 WHEN ra IS NULL THEN rb - h WHEN rb IS NULL THEN h - ra ELSE (rb - ra) / 2 END AS dr, CASE WHEN ca IS NULL AND cb IS NULL THEN 0 WHEN ca IS NULL THEN cb - h WHEN cb IS NULL THEN h - ca ELSE (cb - ca) / 2 END AS dc FROM s),
t AS (SELECT cell, atan(sqrt(dr * dr + dc * dc)) AS slope, atan2(-dr, dc) AS aspect FROM d)
SELECT cell, round(greatest(least(sin(radians(45)) * cos(slope) + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect), 1), 0), 6) AS shade FROM t""",
    "cohort_step": f"""WITH p0 AS (SELECT floor(nullif(cell, -1) / 256)::int AS county, floor((0 - birth_tick) / 12)::bigint AS age, nullif(sex, -1) AS sex FROM person WHERE is_alive),
c0 AS (SELECT p0.county, age, sex, count(*)::double AS n FROM p0 WHERE sex IS NOT NULL AND p0.county IS NOT NULL AND age BETWEEN 0 AND 110 GROUP BY ALL),
{", ".join(f"""c{i + 1} AS (SELECT county, age, sex, sum(n) AS n FROM (SELECT county, least(age + 1, 110) AS age, sex, n * exp(-exp(-9.5 + 0.09 * age)) AS n FROM c{i}
  UNION ALL SELECT county, 0, s, sum(n) FILTER (WHERE sex = 1 AND age BETWEEN 18 AND 45) * 0.06 / 2 FROM c{i}, (VALUES (0), (1)) v(s) GROUP BY county, s HAVING count(*) FILTER (WHERE sex = 1 AND age BETWEEN 18 AND 45) > 0) GROUP BY ALL)""" for i in range(3))}
SELECT county, round(sum(n), 5) AS n FROM c3 GROUP BY 1""",
    "gravity": """WITH s AS (SELECT c_nationkey AS place, floor(c_nationkey / 5) AS r, c_nationkey % 5 AS c, count(*) AS mass FROM customer GROUP BY 1), w AS (SELECT a.place AS origin, b.place, b.mass * exp(-greatest(abs(a.r - b.r), abs(a.c - b.c)) / 2.0::double) AS w FROM s a JOIN s b ON a.place <> b.place)
SELECT origin, place, round(w / sum(w) OVER (PARTITION BY origin), 8) AS share FROM w""",
    "present_value": "SELECT o_orderpriority, round(sum(o_totalprice * pow(1.03, -((year(o_orderdate) - 1992) * 12 + month(o_orderdate)) / 12.0)), 1) AS present_value FROM orders GROUP BY 1",
    "rounded_benchmarks": "SELECT c_nationkey, round_even(count(*) / 10.0::double, 0) * 10 AS rounded FROM customer GROUP BY 1",
    "streamed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_values": "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
}
