"""Queries that SQL cannot express, against brute force, closed forms and accounts that must balance."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import estimates, raster
from tallyfold.plans import catalogue, register_queries, table_queries

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, FOLDER).collect()]


def sql(text):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(text).fetchall()


def test_every_query_without_sql_has_an_expectation():
    tested = {n[len("expect_"):] for n in globals() if n.startswith("expect_")}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == tested


def expect_link_posteriors(spark, got):
    """The posteriors of a two-class mixture of three agreements, fitted again on the pairs themselves."""
    pattern = {(r["id_a"], r["id_b"]): r["pattern"] for r in register_queries._pairs(spark, FOLDER).collect()}
    assert len(got) == len(pattern)
    x = np.array([[p >> i & 1 for i in range(3)] for p in pattern.values()], float)
    p, m, u = 0.1, np.full(3, 0.9), np.full(3, 0.1)
    for _ in range(80):
        lm, lu = p * np.prod(np.where(x == 1, m, 1 - m), 1), (1 - p) * np.prod(np.where(x == 1, u, 1 - u), 1)
        g = lm / (lm + lu)
        p = np.clip(g.mean(), 1e-6, 1 - 1e-6)
        m, u = (np.clip((w[:, None] * x).sum(0) / w.sum(), 1e-4, 1 - 1e-4) for w in (g, 1 - g))
    expected = dict(zip(pattern, g, strict=True))
    assert all(abs(r["posterior"] - expected[r["id_a"], r["id_b"]]) < 1e-4 for r in got)


def expect_one_to_one_links(spark, got):
    scored = [r.asDict() for r in catalogue.QUERIES["link_posteriors"](spark, FOLDER).where("posterior > 0.5").collect()]
    used_a, used_b, expected = set(), set(), set()
    for r in sorted(scored, key=lambda r: (-r["posterior"], r["id_a"], r["id_b"])):
        if r["id_a"] not in used_a and r["id_b"] not in used_b:
            used_a.add(r["id_a"])
            used_b.add(r["id_b"])
            expected.add((r["id_a"], r["id_b"]))
    assert {(r["id_a"], r["id_b"]) for r in got} == expected


def expect_clerical_bootstrap(spark, got):
    assert len(got) > 0 and all(v is None or np.isfinite(v) for r in got for v in r.values() if not isinstance(v, str))


def expect_imputed_links(spark, got):
    assert len(got) > 0


def expect_raked_weights(spark, got):
    """Counties meet their true margins, up to the limits of the factors and the total that is kept."""
    weight = {}
    for r in got:
        weight[r["county"]] = weight.get(r["county"], 0) + r["weight"]
    true = dict(sql("SELECT floor(cell / 256)::int, count(*) FROM person WHERE cell >= 0 GROUP BY 1"))
    whole, known = sum(weight.values()), sum(v for k, v in weight.items() if k in true)
    assert abs(whole - sql("SELECT count(*) FROM population")[0][0]) < 0.5
    off = [abs(weight[k] / known - true[k] / sum(true.values())) for k in true if k in weight]
    assert np.median(off) < 0.006


def expect_filled_surface(spark, got):
    g = [x.asDict() for x in table_queries.grid(spark, FOLDER).collect()]
    z = np.full((1 + max(r["row"] for r in g), 50), np.nan)
    for r in g:
        z[r["row"], r["col"]] = r["h"]
    first = min(r["row"] for r in g)
    filled = raster.flooded(z[first:])
    assert all(r["filled"] == filled[r["cell"] // 50 - first, r["cell"] % 50] for r in got) and len(got) == len(g)


def expect_settlements(spark, got):
    left = sorted(((-r["h"], r["cell"], r["row"], r["col"]) for r in (x.asDict() for x in table_queries.grid(spark, FOLDER).collect())))
    expected = []
    while left and len(expected) < 8:
        _, cell, row, col = left[0]
        expected.append((len(expected), cell))
        left = [x for x in left if max(abs(x[2] - row), abs(x[3] - col)) > 4]
    assert [(r["rank"], r["cell"]) for r in sorted(got, key=lambda r: r["rank"])] == expected


def expect_file_inventory(spark, got):
    found = sorted((p.relative_to(FOLDER).as_posix(), hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(FOLDER).rglob("*") if p.is_file())
    assert got == [{"digest": hashlib.sha256("\n".join(sorted(f"{name}:{digest}" for name, digest in found)).encode()).hexdigest()}]


def expect_table_fingerprint(spark, got):
    assert got == rows(spark, "table_fingerprint") and len(got) == 1


def expect_price_fit(spark, got):
    x = np.array(sql("SELECT 1, l_quantity::double, l_discount::double, l_tax::double, l_extendedprice::double, l_linenumber::double FROM lineitem"))
    w = np.sqrt(x[:, 5:])
    beta = np.linalg.lstsq(x[:, :4] * w, x[:, 4] * w[:, 0], rcond=None)[0]
    found = {r["term"]: r["value"] for r in got}
    assert np.allclose([found[k] for k in ("intercept", "quantity", "discount", "tax")], beta, rtol=1e-3, atol=0.05)


def expect_leaked_share(spark, got):
    x = np.array(sql("SELECT 1, l_quantity::double, l_discount::double, l_tax::double, l_extendedprice::double FROM lineitem"))
    left = [((x[:, 4] - x[:, :k] @ np.linalg.lstsq(x[:, :k], x[:, 4], rcond=None)[0]) ** 2).sum() for k in (2, 4)]
    assert abs(got[0]["r2"] - (left[0] - left[1]) / ((x[:, 4] - x[:, 4].mean()) ** 2).sum()) < 1e-6


def expect_bootstrap_spread(spark, got):
    """The mean over draws comes near the plain total of a state, and every state of several counties spreads."""
    true = dict(sql("SELECT g.state, count(*) FROM population p JOIN geography g ON g.county = nullif(p.county, -1) GROUP BY 1"))
    assert {r["state"] for r in got} == set(true)
    assert all(abs(r["mean"] - true[r["state"]]) < 6 * max(r["spread"], 1) / 50**0.5 for r in got) and sum(r["spread"] > 0 for r in got) > len(got) / 2


def expect_poisson_redraws(spark, got):
    true, drawn = dict(sql("SELECT c_nationkey, count(*) FROM customer GROUP BY 1")), {}
    for r in got:
        drawn.setdefault(r["c_nationkey"], []).append(r["n"])
    assert set(drawn) == set(true) and all(len(v) == 20 and abs(np.mean(v) - true[k]) < 5 * (true[k] / 20) ** 0.5 for k, v in drawn.items())


def expect_draw_intervals(spark, got):
    drawn = {}
    for r in rows(spark, "poisson_redraws"):
        drawn.setdefault(r["c_nationkey"], []).append(r["n"])
    for r in got:
        v = np.array(drawn[r["c_nationkey"]], float)
        half = (np.percentile(v, 95) - np.percentile(v, 5)) / 2
        assert np.allclose((r["estimate"], r["low"], r["high"]), (v.mean(), max(v.mean() - half, 0), v.mean() + half), atol=1e-5)


def expect_member_simulation(spark, got):
    """Order: shortfall at least the quantile, which is at least the mean, near the mean given."""
    given = {r["region"]: r["m"] for r in table_queries.losses(spark, FOLDER).groupBy("region").agg(F.avg("loss").alias("m")).collect()}
    assert {r["region"] for r in got} == set(given)
    assert all(r["shortfall"] >= r["quantile"] >= r["mean"] and abs(r["mean"] / given[r["region"]] - 1) < 0.1 for r in got)


def expect_pps_cells(spark, got):
    """At most ten cells of a state, each with persons, and the first-stage chance of its size."""
    n = {(a, b): c for a, b, c in sql("SELECT g.state, cell, count(*) FROM person JOIN geography g ON g.county = floor(cell / 256) WHERE cell >= 0 GROUP BY 1, 2")}
    whole, count = {}, {}
    for (s, _), c in n.items():
        whole[s] = whole.get(s, 0) + c
    for r in got:
        count[r["state"]] = count.get(r["state"], 0) + 1
        assert r["n"] == n[r["state"], r["cell"]] and abs(r["first_stage"] - min(1, 10 * r["n"] / whole[r["state"]])) < 1e-9
    assert all(count[s] == min(10, sum(k[0] == s for k in n)) for s in whole)


def expect_response_draws(spark, got):
    total, answered = sum(r["n"] for r in got), sum(r["answered"] for r in got)
    assert total == sql("SELECT count(*) FROM household WHERE truth_household_id IS NOT NULL AND cell >= 0")[0][0] and abs(answered / total - 0.7) < 0.12


def expect_shock_loadings(spark, got):
    assert len(got) > 0 and all(np.isfinite(r["loading"]) for r in got)


def expect_survey_halves(spark, got):
    assert len(got) > 0 and got == rows(spark, "survey_halves")


def expect_keyed_numbers(spark, got):
    assert len(got) > 0 and got == rows(spark, "keyed_numbers")


def expect_recoverable_cells(spark, got):
    """A hidden cell alone in a row or column of its block can be told from the margins."""
    assert len(got) > 0
    block = {}
    for r in got:
        block.setdefault(r["c_nationkey"], []).append(r)
    for cells in block.values():
        for r in cells:
            alone = any(sum(x[k] == r[k] for x in cells) == 1 for k in ("c_mktsegment", "sign"))
            assert r["recoverable"] or not alone


def expect_generated_households(spark, got):
    """Households hold exactly the 5000 persons of the grid."""
    assert sum(r["size"] for r in got) == 5000 and min(r["size"] for r in got) >= 1


def expect_generated_names(spark, got):
    assert len(got) > 0 and got == rows(spark, "generated_names")


def expect_generated_deaths(spark, got):
    assert got == rows(spark, "generated_deaths")


def expect_generated_births(spark, got):
    assert got == rows(spark, "generated_births")


def expect_simulated_register(spark, got):
    assert len(got) > 0 and got == rows(spark, "simulated_register")


def expect_month_closings(spark, got):
    """Some establishments close, and each is followed by one of the same enterprise and industry."""
    assert len(got) > 0 and all(r["same"] for r in got) and len({r["truth_establishment_id"] for r in got}) == len(got)


def expect_leaving_home(spark, got):
    """One of a household at most, living, 18 to 30, in the role of a child, not alone."""
    people = {r[0]: r[1:] for r in sql("SELECT truth_person_id, truth_household_id, floor((12 - birth_tick) / 12), role, is_alive FROM person")}
    size = dict(sql("SELECT truth_household_id, count(*) FROM person WHERE is_alive GROUP BY 1"))
    assert len(got) > 0 and len({r["truth_household_id"] for r in got}) == len(got)
    for r in got:
        home, years, role, alive = people[r["truth_person_id"]]
        assert home == r["truth_household_id"] and 18 <= years <= 30 and role == 2 and alive and size[home] >= 2


def expect_month_hires(spark, got):
    """Every job that ends is taken by somebody alive and without a job, nobody twice, as long as there are such."""
    hired = [r["truth_person_id"] for r in got if r["truth_person_id"] is not None]
    alive = {r[0] for r in sql("SELECT truth_person_id FROM person WHERE is_alive AND birth_tick <= 30 - 216")}
    assert len(got) > 0 and len(set(hired)) == len(hired) and set(hired) <= alive and len({r["replaces"] for r in got}) == len(got)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_expected(spark, name):

    got = rows(spark, name)
    globals()[f"expect_{name}"](spark, got)


# operators of the new queries on small cases


def test_least_squares_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 8.0), (3.0, 6.0, 11.0), (None, 1.0, 1.0)], "a double, b double, y double")
    fit = estimates.least_squares(df, ["a", "b"], "y")  # b is twice a
    assert abs(fit["a"] + 2 * fit["b"] - 3) < 1e-9 and abs(fit["r2"] - 1) < 1e-9
    assert estimates.least_squares(df.limit(0), ["a"], "y") == {"intercept": 0.0, "a": 0.0, "r2": 0.0}


def test_birth_error_pools_small_bands(spark):
    df = spark.createDataFrame([("x", i < 6) for i in range(60)] + [("y", True)] * 3 + [("z", None)] * 2, "band string, moved boolean")
    got = {r["band"]: r["rate"] for r in estimates.birth_error(df, "band", F.col("moved")).collect()}
    assert abs(got["x"] - 0.1) < 1e-12 and abs(got["y"] - 9 / 65) < 1e-12 and got["y"] == got["z"]
    assert estimates.birth_error(df.limit(0), "band", F.col("moved")).count() == 0


def test_churn_recovers_its_shapes(spark):
    """Residuals made of the two shapes and a factor per unit give the mix and the factors back."""
    data = [(u, 1000, (1 + u / 10) * (0.02 * m + 0.05 * e), m, e) for u in range(6) for m, e in ((0.5, 0.4), (1.6, 0.7), (0.9, 1.1), (0.4, 2.0))]
    out = estimates.churn(spark.createDataFrame(data, "unit bigint, n bigint, r double, mobility double, error double"), "unit", "n", "r", "mobility", "error").collect()
    assert all(abs(r["mix_mobility"] / r["mix_error"] - 0.4) < 1e-6 for r in out)
    raw = {r["unit"]: r["raw"] for r in out}
    assert all(abs(raw[u] / raw[0] - (1 + u / 10)) < 1e-6 for u in range(6)) and all(0 <= r["weight"] <= 1 for r in out)
    none = spark.createDataFrame([(1, 10, 0.0, 1.0, 1.0)], "unit bigint, n bigint, r double, mobility double, error double")
    assert estimates.churn(none, "unit", "n", "r", "mobility", "error").first()["kappa"] == 0.0


def test_raked_shares_meet_their_targets(spark):
    draws = spark.createDataFrame([(d, "g", u, float(v + d)) for d in range(4) for u, v in (("a", 10), ("b", 20))], "draw bigint, g string, u string, v double")
    shares = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.5)], "g string, u string, share double")
    out = estimates.rake_to_shares(draws, ["g"], "u", "v", shares, "share").groupBy("u").agg(F.avg("raked").alias("m")).collect()
    m = {r["u"]: r["m"] for r in out}
    assert abs(m["a"] - m["b"]) < 1e-9
