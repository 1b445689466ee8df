"""Operators of the statistics pipeline against closed forms and brute force."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import scalars
from tallyfold.operators import aggregates, bitemporal, exposure, generators, joins, matching, projection, raster, scoring, survey, tail, windows
from tallyfold.sources import files
from tallyfold.sources.tables import known, without_codes
from tallyfold.streaming import late_counts

rng = random.Random(3)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    assert one(spark, scalars.age(F.lit(0), F.lit(-840)), scalars.age(F.lit(2), F.lit(3))) == (70, -1)
    assert one(spark, scalars.band(F.lit(80)), scalars.band(F.lit(-1)), scalars.edge_index(F.lit(5), [1, 5, 9]), scalars.edge_index(F.lit(5), [1, 5, 9], right=True)) == ("75-84", None, 2, 1)
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0)), scalars.clip(F.lit(9.0), 0.0, 2.0), scalars.half_even(F.lit(2.5)), scalars.half_even(F.lit(35.0), 10)) == (None, 2.0, 2.0, 40.0)
    e = scalars.entity_id(8, F.lit(5))
    assert one(spark, scalars.namespace(e), scalars.sequence_number(e)) == (8, 5)
    assert one(spark, scalars.first_positive(F.lit(-1), F.lit(4)), scalars.has_flag(scalars.flags(a=F.lit(True), b=F.lit(False), c=F.lit(True)), 2)) == (4, True)
    with pytest.raises(Exception, match="no band"):
        spark.range(1).select(scalars.band(F.lit(-1), strict=True)).collect()


def test_keyed_numbers_do_not_depend_on_partitions(spark):
    a = spark.range(1000).select("id", scalars.uniform(1, "id").alias("u"), scalars.normal(2, "id").alias("z"))
    b = spark.range(1000).repartition(7).select("id", scalars.uniform(1, "id").alias("u"), scalars.normal(2, "id").alias("z"))
    assert rows(a, "id", "u", "z") == rows(b, "id", "u", "z")
    assert abs(np.mean([r["u"] for r in a.collect()]) - 0.5) < 0.03


def test_missing_codes(spark):
    df = spark.createDataFrame([(0, -1, float("nan"), 7), (3, 2, 1.0, None)], "id bigint, code int, amount double, other int")
    assert rows(without_codes(df, ["id"], ["code"], ["amount"]), "id", "code", "amount") == [(3, 2, 1.0), (None, None, None)]
    assert rows(df.select(known("id").alias("id")), "id") == [(3,), (None,)]


def test_global_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 2])], "id int, v double")
    assert rows(windows.rank_uniform(df, [], "v", "id"), "id", "rank01") == [(0, 1.0), (1, 0.0), (2, 1 / 3), (3, 2 / 3)]
    assert rows(windows.rank_uniform(df.where("id = 0"), [], "v", "id"), "rank01") == [(0.5,)]
    assert windows.rank_uniform(df.limit(0), [], "v", "id").count() == 0


def test_running_product_dies(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.0), (4, 0.9)], "a int, p double")
    out = df.select("a", F.round(windows.running_product(F.col("p"), [], "a"), 9).alias("s"))
    assert rows(out, "a", "s") == [(1, 0.5), (2, 0.25), (3, 0.0), (4, 0.0)]


def test_keep_first_null_keys_and_ties(spark):
    df = spark.createDataFrame([(None, 2, "a"), (None, 1, "b"), (1, 5, "c"), (1, 5, "d"), (1, 5, "d")], "k int, o int, v string")
    assert rows(aggregates.keep_first(df, ["k"], ["o"]), "k", "o", "v") == [(1, 5, "c"), (None, 1, "b")]


def test_apportion_adds_up(spark):
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(7)] + [("b", 1, 0.0)], "g string, i int, w double").withColumn("t", F.lit(10))
    out = aggregates.apportion(df, ["g"], ["i"], "w", "t")
    assert sum(r["seats"] for r in out.where("g = 'a'").collect()) == 10


def test_exact_unique_join_counts_unknown_codes(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 6), (5, None)], "id int, k int")
    b = spark.createDataFrame([(9, 0), (8, 5), (7, 6), (6, 6)], "id2 int, k int")
    assert rows(joins.exact_unique_join(a, b, ["k"], "id", "id2", ["k"]), "id", "id2") == [(3, 8)]


@pytest.mark.parametrize("bucket", [None, 4])
def test_asof_join(spark, bucket):
    changes = [(rng.choice([1, 2, None]), rng.randrange(20), i, rng.choice([None, i])) for i in range(40)]
    facts = [(rng.choice([1, 2, 3, None]), rng.randrange(22)) for _ in range(50)] + [(1, None)]
    c, f = spark.createDataFrame(changes, "e int, t int, o int, v int"), spark.createDataFrame(facts, "e int, at int")
    expected = []
    for e, at in facts:
        ok = [(t, o, v) for ce, t, o, v in changes if None not in (e, at) and ce == e and t <= at]
        expected.append((e, at, max(ok)[2] if ok else -5))
    assert rows(joins.asof_join(f, c, "e", "at", "t", "v", "o", F.lit(-5), bucket), "e", "at", "v") == sorted(expected, key=repr)


def test_nearest_site_ties(spark):
    p = spark.createDataFrame([(0, 0), (5, 5)], "row int, col int")
    s = spark.createDataFrame([(7, 0, 2), (3, 2, 0), (9, 6, 6)], "site int, row int, col int")
    assert rows(joins.nearest_site(p, s), "row", "nearest", "distance") == [(0, 3, 2), (5, 9, 1)]
    assert rows(joins.nearest_site(p, s.limit(0)), "row", "nearest", "distance") == [(0, None, None), (5, None, None)]
    assert joins.nearest_site(p.limit(0), s).count() == 0


def test_nearest_site_against_all_sites(spark):
    r = np.random.default_rng(6)
    sites = [(i, int(a), int(b)) for i, (a, b) in enumerate(r.integers(-300, 300, (40, 2)))]
    points = [(int(a), int(b)) for a, b in r.integers(-400, 400, (300, 2))] + [(None, 3)]
    got = joins.nearest_site(spark.createDataFrame(points, "row bigint, col bigint"), spark.createDataFrame(sites, "site bigint, row bigint, col bigint")).collect()
    assert len(got) == 301
    for g in got:
        expected = (None, None) if g["row"] is None else min((max(abs(g["row"] - a), abs(g["col"] - b)), i) for i, a, b in sites)
        assert (g["distance"], g["nearest"]) == expected


def test_one_to_one_join_refuses_repeats(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        joins.one_to_one(a, b, ["k"]).collect()


def test_greedy_matching(spark):
    pairs = [(a, b, round(rng.random(), 1)) for a in range(12) for b in range(12) if rng.random() < 0.4]
    out = matching.one_to_one(spark.createDataFrame(pairs, "a int, b int, s double"), "a", "b", "s")
    used_a, used_b, expected = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.append((a, b))
    assert rows(out, "a", "b") == sorted(expected, key=repr)


def test_fellegi_sunter_separates():
    g = np.random.default_rng(1)
    match = g.random(4000) < 0.2
    bits = np.where(match[:, None], g.random((4000, 3)) < 0.9, g.random((4000, 3)) < 0.1)
    codes, n = np.unique(bits @ [1, 2, 4], return_counts=True)
    p, m, u, post = matching.fit_fellegi_sunter(dict(zip(codes.tolist(), n.tolist(), strict=True)), 3)
    assert abs(p - 0.2) < 0.04 and (m > 0.8).all() and (u < 0.2).all() and post[7] > 0.95 > 0.05 > post[0]


def test_month_counts(spark):
    spans = spark.createDataFrame([("a", 0, 3), ("a", 2, 9), ("b", 4, 4), ("a", 11, 12), ("c", -3, 99)], "g string, s int, e int")
    out = bitemporal.month_counts(spans, ["g"], F.col("s"), F.col("e"), 1, 5, "m")
    assert rows(out, "g", "m", "n") == [("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("a", 4, 1), ("a", 5, 1), *[("c", i, 1) for i in range(1, 6)]]


def test_residence_and_fingerprint(spark):
    moves = spark.createDataFrame([(1, 3, 10, "x"), (1, 3, 11, "y"), (1, 7, 12, "z")], "e int, t int, o int, p string")
    base = spark.createDataFrame([(1, "w"), (2, "v")], "e int, p string")
    assert rows(bitemporal.residence_spans(moves, "e", "t", "o", "p", base), "e", "p", "since", "until") == [(1, "w", None, 3), (1, "y", 3, 7), (1, "z", 7, None), (2, "v", None, None)]
    assert bitemporal.fingerprint(moves).first() == bitemporal.fingerprint(moves.repartition(3)).first()


def brute_rake(cells, margins, sweeps):
    w = {k: v for k, v in cells.items()}
    whole = sum(w.values())
    for _ in range(sweeps):
        for at, goal in margins:
            now = {}
            for k, v in w.items():
                now[k[at]] = now.get(k[at], 0) + v
            w = {k: v * (min(4.0, max(0.25, goal[k[at]] / now[k[at]])) if k[at] is not None and goal.get(k[at], 0) > 0 else 1.0) for k, v in w.items()}
        s = sum(w.values())
        w = {k: v * whole / s for k, v in w.items()}
    return w


@pytest.mark.parametrize("limit", [50_000, 0])
def test_raking(spark, monkeypatch, limit):
    monkeypatch.setattr(survey, "CELLS_ON_DRIVER", limit)
    data = [(rng.choice(["m", "f", None]), rng.choice([1, 2, 3]), 1.0) for _ in range(60)]
    a, b = {"m": 40.0, "f": 25.0}, {1: 10.0, 2: 30.0, 3: 0.0}
    out = survey.rake(spark.createDataFrame(data, "s string, c int, w double"), "w", [
        (["s"], spark.createDataFrame(list(a.items()), "s string, t double"), "t"), (["c"], spark.createDataFrame(list(b.items()), "c int, t double"), "t")], sweeps=3)
    cells = {}
    for s, c, w in data:
        cells[s, c] = cells.get((s, c), 0) + w
    expected = brute_rake(cells, [(0, a), (1, b)], 3)
    got = {}
    for r in out.collect():
        got[r["s"], r["c"]] = got.get((r["s"], r["c"]), 0) + r["raked"]
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_bootstrap_factors(spark):
    psus = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "s string, p int")
    out = survey.rescaled_bootstrap(psus, ["s"], "p", 30, 1)
    sums = {(r["draw"], r["s"]): r["f"] for r in out.groupBy("draw", "s").agg(F.sum("factor").alias("f")).collect()}
    assert all(abs(v - (5.0 if s == "a" else 1.0)) < 1e-9 for (_, s), v in sums.items()) and len(sums) == 60


def test_poisson_and_pps(spark):
    cells = spark.createDataFrame([(i, 20.0 + i) for i in range(5)], "k int, m double")
    out = survey.poisson_redraws(cells, "k", "m", 400, 2).groupBy("k").agg(F.avg("n").alias("a"))
    assert all(abs(r["a"] - 20 - r["k"]) < 1.5 for r in out.collect())
    drawn = survey.pps_sample(cells.withColumn("s", F.lit(1)), ["s"], "k", "m", 3, 1)
    assert drawn.count() == 3 and drawn.where("first_stage > 1").count() == 0


def test_greedy_fill_is_optimal(spark):
    losses = [(m, r, float(rng.randrange(0, 50))) for m in range(20) for r in range(3)]
    df = spark.createDataFrame(losses, "member int, region int, loss double")
    best = tail.uncovered(df, tail.greedy_fill(df, "region", "loss", 60.0), "region", "member", "loss").first()[0]
    brute = min(sum(np.mean([max(x - a, 0) for m, r, x in losses if r == i]) for i, a in enumerate((p, q, 60 - p - q))) for p in range(61) for q in range(61 - p))
    assert abs(best - brute) < 1e-9
    assert abs(sum(r["allocation"] for r in tail.greedy_fill(df, "region", "loss", 500.0).collect()) - 500) < 1e-9


def test_reserve_total_is_exact(spark):
    assert spark.createDataFrame([(1000,)], "n int").select(tail.reserve_total(F.col("n"), "0.1", "50").alias("t")).first()["t"] == 100


def test_gates(spark):
    values = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "component string, value double")
    bars = spark.createDataFrame([("a", 1.0, True), ("b", 9.0, False), ("c", 9.0, False)], "component string, ceiling double, decides boolean")
    out = {r["component"]: r["passed"] for r in scoring.gates(values, bars).collect()}
    assert out == {"a": True, "b": False, "c": False, None: True}


def test_recoverable_cells(spark):
    cube = spark.createDataFrame([(1, "a", "x", True), (1, "a", "y", False), (1, "b", "x", True), (1, "b", "y", True), (2, "a", "x", True), (2, "a", "y", True), (2, "b", "x", True), (2, "b", "y", True)], "c int, r string, k string, hidden boolean")
    out = scoring.recoverable_cells(cube, ["c"], [["c", "r"], ["c", "k"]], "hidden")
    assert rows(out, "c", "r", "k", "recoverable") == [(1, "a", "x", True), (1, "b", "x", True), (1, "b", "y", True), *[(2, r, k, False) for r in "ab" for k in "xy"]]


def test_accumulation_on_a_chain_and_a_tree(spark):
    edges = [(i, i + 1 if i < 40 else None, 1) for i in range(41)] + [(100, 20, 5), (101, None, 2)]
    out = {r["cell"]: r["total"] for r in raster.accumulate(spark.createDataFrame(edges, "cell int, down int, w int"), "cell", "down", "w").collect()}
    assert out[0] == 1 and out[19] == 20 and out[20] == 26 and out[40] == 46 and out[101] == 2


def test_flooded_surface_drains(spark):
    """Every cell of a flooded surface has a strictly lower neighbour on its way to the sea or the edge, and is raised no more than needed."""
    z = np.random.default_rng(4).integers(0, 9, (9, 9)).astype(float)
    z[4, 4] = -5
    filled = raster.flooded(z, -1.0)
    assert (filled >= z).all() and filled[4, 4] == -5
    paths = z.copy()  # lowest highest point on the way out, by relaxation
    inner = np.ones_like(z, bool)
    inner[[0, -1], :] = inner[:, [0, -1]] = False
    inner &= z > -1
    paths[inner] = np.inf
    for _ in range(81):
        near = np.min([np.pad(paths, 1, constant_values=np.inf)[1 + a : 10 + a, 1 + b : 10 + b] for a, b in raster.NEIGHBOURS], 0)
        paths = np.where(inner, np.minimum(paths, np.maximum(z, near)), paths)
    assert np.allclose(filled, paths, atol=1e-6)
    rows = [(int(r * 9 + c), int(r), int(c), float(filled[r, c]), bool(not inner[r, c])) for r in range(9) for c in range(9)]
    grid = spark.createDataFrame(rows, "cell bigint, row bigint, col bigint, h double, outlet boolean")
    got = {r["cell"]: r["direction"] for r in raster.flow_direction(grid, "h", "outlet").collect()}
    for cell, r, c, h, outlet in rows:
        drops = [h - filled[r + a, c + b] if 0 <= r + a < 9 and 0 <= c + b < 9 else -np.inf for a, b in raster.NEIGHBOURS]
        assert got[cell] == (-1 if outlet else int(np.argmax(drops))) and (outlet or max(drops) > 0)


def test_fields_and_rain_have_their_shapes():
    z = np.arange(16.0).reshape(4, 4)
    assert abs(raster.spectral_field(16, 20, 2.0, 1).std() - 1) < 1e-9 and raster.rain_steps(z, 3).shape == (3, 4, 4)


def test_discharge_follows_the_rain(spark):
    rain = spark.createDataFrame([(c, h, float(c + h)) for c in range(3) for h in range(4)], "cell bigint, hour bigint, fall double")
    down = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "cell bigint, down bigint")
    got = {(r["cell"], r["hour"]): r["discharge"] for r in raster.discharge(rain, down, "cell", "hour", "fall", "down", 2).collect()}
    mean = lambda c, h: np.mean([c + k for k in range(max(0, h - 1), h + 1)])
    assert all(abs(got[c, h] - sum(mean(k, h) for k in range(c + 1))) < 1e-9 for c in range(3) for h in range(4))


def test_cohorts_are_conserved(spark):
    cube = spark.createDataFrame([("r", a, s, 10.0) for a in (0, 30, 110) for s in (0, 1)], "r string, age int, sex int, n double")
    survival = spark.createDataFrame([(a, s, 1.0) for a in range(111) for s in (0, 1)], "age int, sex int, p double")
    out = projection.project(cube, ["r"], survival, 0.1, 2)
    assert abs(out.agg(F.sum("n")).first()[0] - (60 + 1.0 + 1.0)) < 1e-9


def test_simulated_members_do_not_depend_on_chunks(spark):
    regions = spark.createDataFrame([(1, 50.0, 0.1), (2, 10.0, 0.2)], "region bigint, m double, s double")
    a, b = (projection.simulate_members(regions, "region", "m", "s", 40, 3, c) for c in (7, 128))
    assert rows(a, "member", "region", "loss") == rows(b, "member", "region", "loss")


def test_generators(spark):
    cells = spark.createDataFrame([(1, 7), (2, 1), (3, 0)], "cell int, persons int")
    sizes = generators.household_sizes(cells, "cell", "persons", 4)
    assert rows(sizes.groupBy("cell").agg(F.sum("size").alias("n")), "cell", "n") == [(1, 7), (2, 1)]
    ids = generators.numbered(cells, "person", ["cell"], "id")
    assert rows(ids, "cell", "id") == [(i, (1 << 56) + i - 1) for i in (1, 2, 3)]
    assert generators.weighted_sample(cells, [], "persons", 1, 1, ["cell"]).count() == 1
    free = spark.createDataFrame([(1, 4), (1, 2)], "cell int, bed int")
    asked = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b")], "cell int, who string")
    assert rows(generators.assign_free(asked, free, ["cell"], ["who"], "bed"), "who", "bed") == [("a", 2), ("b", 4), ("c", None)]


def test_csv_round_trip_and_tokens(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.DecimalType(20, 0)), T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame([(Decimal(18446744073709551615), 0.1234567), (Decimal(5), None)], "id decimal(20,0), x double")
    back = files.published(df, str(tmp_path / "t"), schema)
    assert rows(back.select(files.unsigned_to_signed("id").alias("id"), "x"), "id", "x") == sorted([(-1, 0.123457), (5, None)], key=repr)
    assert rows(back.select(files.signed_to_unsigned(files.unsigned_to_signed("id")).alias("id")), "id") == rows(df, "id")
    with pytest.raises(ValueError, match="publication"):
        files.write_csv(df.withColumnRenamed("id", "truth_id"), str(tmp_path / "u"))
    with pytest.raises(ValueError, match="expected"):
        files.expect_columns(df, ["x", "id"])
    files.write_document(df, str(tmp_path / "d"))
    assert files.inventory(spark, str(tmp_path), "*.csv").count() >= 1


def test_inventory_covers_the_whole_tree(spark, tmp_path):
    import hashlib
    from pathlib import Path

    from tallyfold.plans import table_queries

    for name, data in {"a/part.bin": b"x" * 9_000_000, "b/part.bin": b"y", "c d.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    brute = lambda root: sorted((str(p.relative_to(root)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(root).rglob("*") if p.is_file())
    assert sorted(map(tuple, files.inventory(spark, str(tmp_path)).collect())) == brute(tmp_path)
    folder = "/root/testdata/sf0.001"
    digest = hashlib.sha256("\n".join(f"{n}:{h}" for n, _, h in brute(folder)).encode()).hexdigest()
    assert table_queries.file_inventory(spark, folder).first()["digest"] == digest
    assert table_queries.table_fingerprint(spark, folder).first()["n"] == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_stream_corrects_late_events(spark, tmp_path):
    from tests.test_problems import brute_versions

    events = [("h", p, p + rng.choice([0, 1, 2, 5]), rng.choice([None, 1, 2, 3, 9]), i) for i, p in enumerate([1, 1, 2] * 8)]
    schema = "key string, period bigint, arrival bigint, value bigint, event_id bigint"
    for at in sorted({e[2] for e in events}):
        spark.createDataFrame([e for e in events if e[2] == at] * 2, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = late_counts.run_once(late_counts.multiset_versions(stream, "key", "period", "arrival", "value", "event_id", 3), "versions", "update", str(tmp_path / "cp"))
    got = sorted(((r["key"], r["period"], r["arrival"] - r["period"], r["n"], r["n_distinct"], r["min_value"], r["max_value"], r["median_value"]) for r in out.collect()), key=repr)
    assert got == sorted([(v[0], v[1], v[2], *v[4:]) for v in brute_versions([e[:4] for e in events], 3)], key=repr)


def test_residence_exposure_month_by_month(spark):
    """Against counting every month: births, deaths, moves between households and of households, unknown sexes and places."""
    r = np.random.default_rng(8)
    people = [(i, [0, 1, None][r.integers(0, 3)], int(r.integers(-1200, 20)), int(s := r.integers(0, 20)), int(s + r.integers(0, 50))) for i in range(40)] + [(None, 1, 0, 0, 60)]
    homes = [(int(r.integers(0, 40)), int(r.integers(0, 40)), int(k), [None, *range(12)][r.integers(0, 13)]) for k in range(120)]
    cells = [(int(r.integers(0, 12)), int(r.integers(0, 40)), int(k), [None, *range(4)][r.integers(0, 5)]) for k in range(60)]
    stays = exposure.spells(spark.createDataFrame(homes, "p bigint, at bigint, o bigint, h bigint"), "p", "at", "o", "h", 40)
    places = exposure.spells(spark.createDataFrame(cells, "h bigint, at bigint, o bigint, unit bigint"), "h", "at", "o", "unit", 40)
    df = spark.createDataFrame(people, "p bigint, sex int, birth bigint, s bigint, e bigint").withColumn("months", F.lit("clash"))
    got = {(x["unit"], x["sex"], x["band"]): x["months"] for x in exposure.residence_exposure(df, stays, places, "p", "h", "unit", 40).collect()}

    def now(changes, who, month):
        seen = [(at, o, v) for w, at, o, v in changes if w == who and at <= month]
        return max(seen, key=lambda x: x[:2])[2] if seen else None

    expected = {}
    for p, sex, birth, s, e in people:
        for m in range(max(s, 1), min(e, 41)):
            unit = now(cells, now(homes, p, m), m) if p is not None and sex is not None else None
            band = next((b for b, lo, hi in scalars.RATE_BANDS if lo <= (m - birth) // 12 <= hi), None)
            if unit is not None and band is not None:
                expected[unit, sex, band] = expected.get((unit, sex, band), 0) + 1
    assert got == expected and len(got) > 10
    assert exposure.residence_exposure(df.limit(0), stays, places, "p", "h", "unit", 40).count() == 0


def test_months_are_sequenced_and_transitions_checked(spark):
    df = spark.createDataFrame([(9, 1, 6), (8, 1, 7), (7, 1, 5), (1, 2, 6), (2, 2, None)], "id bigint, tick bigint, kind int")
    assert rows(exposure.in_month_order(df, "kind", {7: 0, 6: 1, 5: 2}, "tick", "id"), "id", "seq") == [(1, 1), (2, 2), (7, 3), (8, 1), (9, 2)]
    e = spark.createDataFrame([("a", 1, "o"), ("a", 2, "c"), ("b", 1, "c"), ("c", 1, "o"), ("c", 2, "o"), (None, 1, "c")], "k string, t bigint, what string")
    assert rows(exposure.broken_transitions(e, "k", ["t"], F.col("what") == "o", F.col("what") == "c"), "k", "opened_twice", "closed_unopened") == [("b", 0, 1), ("c", 1, 0)]


def test_heaping_of_few_and_of_none(spark):
    few = spark.createDataFrame([("x", a, 3) for a in range(0, 111, 5)], "g string, age bigint, n bigint")
    assert rows(survey.heaping(few, ["g"], "age", "n"), "excess") == [(0.0,)]
    even = spark.createDataFrame([("x", a, 10) for a in range(111)], "g string, age bigint, n bigint")
    assert abs(survey.heaping(even, ["g"], "age", "n").first()["excess"]) < 1e-12
    heaped = spark.createDataFrame([("x", a, 30 if a % 5 == 0 else 5) for a in range(111)], "g string, age bigint, n bigint")
    out = survey.deheap(heaped, ["g"], "age", "n")
    assert abs(out.agg(F.sum("smoothed")).first()[0] - out.agg(F.sum("n")).first()[0]) < 1e-9 and survey.heaping(heaped.limit(0), ["g"], "age", "n").count() == 0
