"""The data-problem operators against brute force, and on awkward tables."""

import random
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import as_known, change_feed, deliveries, intervals, late_events, snapshots

rng = random.Random(5)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# first deliveries and withdrawals


@pytest.mark.parametrize("kind", ["bigint", "int", "double", "string"])
def test_first_delivery(spark, kind):
    data = [(1, 5, None, 7), (1, 4, 3, None), (1, 4, 3, 9), (2, 1, None, None), (2, 1, None, None), (None, 1, 1, 1), (3, None, 1, 1)]
    df = spark.createDataFrame(data, "id bigint, at bigint, a bigint, b bigint").withColumn("id_", F.lit("clash")).withColumn("at", F.col("at").cast(kind))
    out = deliveries.first_deliveries(df, "id", "at", ["a", "b"]).withColumn("at", F.col("at").cast("int"))
    assert rows(out, "id", "at", "a", "b") == [(1, 4, 3, 9), (2, 1, None, None)]
    assert deliveries.first_deliveries(df.limit(0), "id", "at", ["a"]).count() == 0
    assert rows(deliveries.first_deliveries(df, "id", "at", []).withColumn("at", F.col("at").cast("int")), "id", "at") == [(1, 4), (2, 1)]


def test_first_delivery_of_far_arrivals(spark):
    """Arrivals of any size are told apart: nanoseconds since 1970, and the ends of the type."""
    data = [(1, 1_700_000_000_000_000_001, 5), (1, 1_700_000_000_000_000_000, 4), (2, -(2**63), 1), (2, 2**63 - 1, None), (3, 2**63 - 1, 7)]
    out = deliveries.first_deliveries(spark.createDataFrame(data, "id bigint, at bigint, a bigint"), "id", "at", ["a"])
    assert rows(out, "id", "a") == [(1, 4), (2, 1), (3, 7)]


def test_withdrawals(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 1, 5), (3, 1, 3), (4, 4, 1), (5, 99, 1), (6, None, 1)], "id bigint, target bigint, at bigint")
    assert rows(deliveries.withdrawals(df, "id", "target", "at"), "id", "withdrawn_at") == [(1, 3), (99, 1)]
    kept = deliveries.not_withdrawn(df, deliveries.withdrawals(df, "id", "target"), "id")
    assert rows(kept, "id") == [(2,), (3,), (4,), (5,), (6,)]


# late events


def brute_versions(events, cutoff):
    by = defaultdict(list)
    for k, p, a, v in events:
        if None not in (k, p, a) and max(a - p, 0) <= cutoff:
            by[k, p].append((max(a - p, 0), v))
    out = []
    for (k, p), got in by.items():
        for version in sorted({late for late, _ in got}):
            seen = [v for late, v in got if late <= version]
            known = [v for v in seen if v is not None]
            out.append((k, p, version, sum(late == version for late, _ in got), len(seen), len(set(known)), min(known, default=None), max(known, default=None), float(median(known)) if known else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [2, 16])
def test_period_versions(spark, ranges):
    events = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3]), None, rng.choice([None, *range(-5, 30)])) for _ in range(400)]
    events = [(k, p, p + rng.choice([-1, 0, 0, 1, 2, 3, 4]), v) for k, p, _, v in events] + [("hot", 1, 1, 5)] * 300
    df = spark.createDataFrame(events, "k string, p bigint, a bigint, v bigint")
    state = late_events.multiset_state(df, ["k"], "p", "a", 3, "v")
    out = late_events.period_versions(state, ["k"], "p", 3, ranges)
    assert rows(out, "k", "p", "version", "n_new", "n", "n_distinct", "min_value", "max_value", "median_value") == brute_versions(events, 3)
    expected = sorted({(k, p, a) for k, p, a, _ in events if k and 1 <= a - p <= 3}, key=repr)
    assert rows(late_events.corrections(out, ["k"], "p", "a"), "k", "p", "a") == expected


def test_late_events_empty_and_all_null(spark):
    df = spark.createDataFrame([("a", 1, 1, None)], "k string, p bigint, a bigint, v bigint")
    state = late_events.multiset_state(df, ["k"], "p", "a", 3, "v")
    assert rows(late_events.period_versions(state, ["k"], "p", 3), "k", "n", "n_distinct", "median_value") == [("a", 1, 0, None)]
    empty = late_events.multiset_state(df.limit(0), ["k"], "p", "a", 3, "v")
    assert late_events.period_versions(empty, ["k"], "p", 3).count() == 0


# change feed


def test_replay_any_order(spark):
    changes = [(i, rng.randrange(4), rng.randrange(1, 9), rng.choice("uuud"), rng.choice([None, 1, 2, 3])) for i in range(200)]
    state = {}
    for i, k, c, op, v in sorted(changes, key=lambda x: (x[2], x[0])):
        state[k] = None if op == "d" else (v,)
    shuffled = changes[:] + [(500, None, 3, "u", 1)]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "id bigint, k bigint, c bigint, op string, v bigint").withColumn("extra", F.lit(1))
    log = df.groupBy("c").agg(F.count("*").alias("n_changes"))  # a sender's log that agrees with what came
    out = change_feed.replay(df, "k", ["v"], "c", "id", F.col("op") == "d", log)
    assert rows(out, "k", "v") == sorted(((k, v[0]) for k, v in state.items() if v), key=repr)
    assert change_feed.replay(df.limit(0), "k", ["v"], "c", "id", F.col("op") == "d", log).count() == 0


def numbered_feed(changes):
    """Brute force of a numbered feed: {key: value}, and the watermark. Changes are (number, key, commit, op, value, voids, arrival)."""
    first = {}
    for ch in sorted(changes, key=lambda x: x[6]):
        first.setdefault(ch[0], ch)
    accounted = set(first) | {ch[5] for ch in changes if ch[5] is not None and ch[5] != ch[0]}
    reached = 0
    while reached + 1 in accounted:
        reached += 1
    ends = {}
    for n, ch in first.items():
        ends[ch[2]] = max(n, ends.get(ch[2], 0))
    last = max(accounted, default=0)
    done = [(e, c) for c, e in ends.items() if e < reached or e == reached == last]
    upto, state = max(done, default=(0, None))[0], {}
    void = {ch[5] for n, ch in first.items() if n <= upto and ch[5] is not None and ch[5] != n}
    for n in sorted(first):
        _, k, _, op, v, _, _ = first[n]
        if n <= upto and n not in void and k is not None and op != "x":
            state[k] = None if op == "d" else (v,)
    return sorted(((k, v[0]) for k, v in state.items() if v), key=repr), max(done, default=(0, None))[1]


@pytest.mark.parametrize("lost", [[], [57], [57, 120], [200], [1], [40, 41, 42, 90]])
@pytest.mark.parametrize("span", [7, 64, 1 << 16])
def test_numbered_feed_is_held_at_gaps(spark, lost, span):
    """Dropped changes hold their month and all later ones, unless something withdraws them; repeats and order change nothing."""
    r = random.Random(len(lost) + span)
    changes = [[n, r.choice([None, *range(6)]), 1 + n // 12, r.choice("uuudx"), r.choice([None, 1, 2]), None, r.randrange(100)] for n in range(1, 201)]
    for n in r.sample(range(1, 201), 25):
        changes[n - 1][5] = r.randrange(1, 201)
    changes[9][5] = 42  # 42 is withdrawn, so it may be lost
    changes = [c for c in changes if c[0] not in lost]
    changes += [[*c[:6], 500] for c in changes[::9]]
    r.shuffle(changes)
    df = spark.createDataFrame([tuple(c) for c in changes], "n bigint, k bigint, c bigint, op string, v bigint, voids bigint, at bigint").withColumn("number", F.lit("clash"))
    log = change_feed.numbered_log(df, F.col("n"), F.col("voids"), "c", "at", ["op", "k", "v"], F.col("op") != "x")
    expected, through = numbered_feed([tuple(c) for c in changes])
    assert change_feed.contiguous_watermark(log, span=span).first()["through"] == through
    assert rows(change_feed.replay_numbered(log, "k", ["v"], F.col("op").isNotNull(), F.col("op") == "d", span=span), "k", "v") == expected
    empty = change_feed.numbered_log(df.limit(0), F.col("n"), F.col("voids"), "c", "at", ["op", "k", "v"], F.col("op") != "x")
    assert change_feed.replay_numbered(empty, "k", ["v"], F.col("op").isNotNull(), F.col("op") == "d", span=span).count() == 0


@pytest.mark.parametrize("dense,expected", [(False, 4), (True, 2)])
def test_watermark_holds_gaps(spark, dense, expected):
    changes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 4), (5, 5), (6, 7)], "id bigint, c bigint")
    log = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (5, 2), (7, 1)], "c bigint, n_changes bigint")
    assert change_feed.committed_watermark(changes, log, "c", dense).first()["watermark"] == expected
    feed = changes.withColumns({"k": F.col("id"), "v": F.col("id")})
    state = change_feed.replay(feed, "k", ["v"], "c", "id", F.lit(False), log, dense)
    assert rows(state, "k") == [(i,) for i, c in [(1, 1), (2, 1), (3, 2), (4, 4), (5, 5), (6, 7)] if c <= expected]


def test_watermark_nothing_complete(spark):
    changes = spark.createDataFrame([(1, 1)], "id bigint, c bigint")
    log = spark.createDataFrame([(1, 2), (2, 1)], "c bigint, n_changes bigint")
    assert change_feed.committed_watermark(changes, log, "c").first()["watermark"] is None


@pytest.mark.parametrize("chunk", [2, 4096])
def test_watermarks_over_time(spark, chunk):
    changes = [(rng.randrange(1, 12), rng.randrange(1, 20)) for _ in range(60)]
    out = change_feed.watermarks(spark.createDataFrame(changes, "c bigint, a bigint"), "c", "a", chunk)
    done = {c: max(a for x, a in changes if x == c) for c, _ in changes}
    expected = []
    for a in {a for _, a in changes}:
        mark = None
        for c in sorted(done):
            if done[c] > a:
                break
            mark = c
        expected.append((a, mark))
    assert rows(out, "a", "watermark") == sorted(expected, key=repr)


# attributes as known


def test_as_known(spark):
    changes = [(rng.randrange(3), rng.randrange(1, 8), i, rng.randrange(1, 10), None) for i in range(60)]
    changes = [(e, t, o, max(r, t), rng.choice([None, None, r + rng.randrange(0, 5)])) for e, t, o, r, _ in changes] + [(None, 1, 99, 1, None), (7, None, 98, 1, None)]
    facts = [(rng.choice([0, 1, 2, 3, None]), rng.randrange(0, 9), rng.randrange(0, 14)) for _ in range(150)] + [(1, None, 3), (1, 3, None)] + [(2, 5, 5)] * 20
    c = spark.createDataFrame(changes, "e bigint, t bigint, o bigint, r bigint, v bigint").withColumn("val", F.when(F.col("o") % 5 != 0, F.col("o") * 10))
    f = spark.createDataFrame(facts, "e bigint, at bigint, known bigint").withColumn("t", F.lit("clash"))
    out = as_known.as_known(f, c, "e", "at", "known", ["val"], "t", "o", "r", "v")
    expected = []
    for e, at, known in facts:
        ok = [(t, o) for ce, t, o, r, v in changes if None not in (e, at, known, ce, t) and ce == e and t <= at and r <= known and (v is None or v > known)]
        o = max(ok)[1] if ok else None
        expected.append((e, at, known, o * 10 if ok and o % 5 else None, bool(ok)))
    assert rows(out, "e", "at", "known", "val", "seen") == sorted(expected, key=repr)
    with pytest.raises(ValueError, match="already"):
        as_known.as_known(f.withColumn("val", F.lit(1)), c, "e", "at", "known", ["val"], "t", "o", "r", "v")
    assert rows(as_known.as_known(f, c.limit(0), "e", "at", "known", ["val"], "t", "o", "r", "v"), "seen") == [(False,)] * len(facts)


# snapshots


def brute_changes(a, b):
    content = lambda s: {k: {x[1:] for x in s if x[0] == k} for k in {x[0] for x in s} - {None}}
    a, b = content(a), content(b)
    return sorted(((k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)), key=repr)


@pytest.mark.parametrize("bits", [1, 6, None])
def test_snapshot_changes(spark, bits):
    make = lambda: [(rng.choice([None, *range(80)]), rng.choice([None, "x", "y"]), rng.choice([None, 1.5, 2.5])) for _ in range(120)]
    a = make() + [(5, "x", 1.5)] * 200
    b = a[:100] + make()[:20] + [(5, "x", 1.5)]
    schema = "key bigint, s string, d double"
    da, db = spark.createDataFrame(a, schema).withColumn("leaf", F.lit(0)), spark.createDataFrame(b, schema)
    out = snapshots.snapshot_changes(da, db, "key", ["s", "d"], bits)
    assert rows(out, "key", "change") == brute_changes(a, b)


def test_snapshots_equal_or_empty(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "key bigint, s string")
    assert snapshots.snapshot_changes(a, a, "key", ["s"]).count() == 0
    assert rows(snapshots.snapshot_changes(a.limit(0), a, "key", ["s"]), "key", "change") == [(1, "added"), (2, "added")]
    assert rows(snapshots.snapshot_changes(a, a.limit(0), "key", ["s"]), "key", "change") == [(1, "removed"), (2, "removed")]
    assert snapshots.snapshot_changes(a.limit(0), a.limit(0), "key", ["s"]).count() == 0


def test_only_differing_leaves_are_compared(spark):
    a = spark.range(5000).select(F.col("id").alias("key"), F.lit("x").alias("s"))
    b = a.withColumn("s", F.when(F.col("key") == 17, "y").otherwise(F.col("s")))
    leaves = [snapshots.leaf_digests(x, "key", ["s"], 7) for x in (a, b)]
    assert snapshots.differing_leaves(*leaves, 7).count() == 1


def test_few_changes_leave_most_rows_uncompared(spark):
    """One key in a thousand changed: at most one leaf in ten or so differs, and the rows of the others are not compared."""
    a = spark.range(50_000).select(F.col("id").alias("key"), F.lit("x").alias("s"))
    b = a.withColumn("s", F.when(F.col("key") % 1000 == 17, "y").otherwise(F.col("s")))
    bits = snapshots.leaf_bits(50_000)
    differ = snapshots.differing_leaves(*[snapshots.leaf_digests(x, "key", ["s"], bits) for x in (a, b)], bits)
    assert 32 <= 50_000 / 2**bits <= 64 and 40 <= differ.count() <= 50
    compared = a.where(F.col("key").isNotNull()).withColumn("leaf", snapshots._leaf("key", bits)).join(differ, "leaf", "left_semi").count()
    assert compared < 0.06 * 50_000


def test_a_value_moved_across_a_null_is_a_change(spark):
    a = spark.createDataFrame([(1, 5, None), (2, 1, 1)], "key bigint, g bigint, f bigint")
    b = spark.createDataFrame([(1, None, 5), (2, 1, 1)], "key bigint, g bigint, f bigint")
    assert rows(snapshots.snapshot_changes(a, b, "key", ["g", "f"]), "key", "change") == [(1, "changed")]


# intervals


def brute_periods(spans):
    by = defaultdict(list)
    for e, s, t in spans:
        if None not in (e, s, t) and t > s:
            by[e].append((s, t))
    out = []
    for e, xs in by.items():
        merged = []
        for s, t in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, s, t) for s, t in merged]
    return sorted(out)


@pytest.mark.parametrize("chunk", [None, 5])
def test_periods_and_gaps(spark, chunk):
    spans = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(60)]), None) for _ in range(150)]
    spans = [(e, s, None if s is None else s + rng.choice([-2, 0, 1, 2, 3, 9])) for e, s, _ in spans] + [(9, 3, 4)] * 50 + [(8, 1, 50), (8, 2, 3), (8, 50, 51)]
    df = spark.createDataFrame(spans, "who bigint, a bigint, z bigint").withColumn("reach", F.lit("clash"))
    piece = None if chunk is None else F.floor(F.col("a") / chunk)
    expected = brute_periods(spans)
    assert rows(intervals.periods(df, "who", "a", "z", piece), "who", "a", "z") == sorted(expected, key=repr)
    holes = [(e, t, s2) for (e, _, t), (e2, s2, _) in zip(expected, expected[1:]) if e == e2]
    assert rows(intervals.gaps(df, "who", "a", "z", piece), "who", "gap_start", "gap_end") == sorted(holes, key=repr)
    assert intervals.periods(df.limit(0), "who", "a", "z", piece).count() == 0


def test_hot_entity_is_reduced_before_the_sort(spark):
    df = spark.range(20_000).select(F.lit(1).alias("who"), (F.col("id") % 7).alias("a"), (F.col("id") % 7 + 1).alias("z"))
    assert intervals.distinct_starts(df, "who", "a", "z").count() == 7
    assert Counter(rows(intervals.periods(df, "who", "a", "z"), "a", "z")) == {(0, 7): 1}
