"""Operators for training data against brute force, planted truth and exact accounts."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm import boosting, leakage, linkage, mixing, quality, queries

from .held_out_passages import HELD_OUT
from tallyfold.llm.words import words
from tallyfold.session import checkpoint_dir, settings

from ..harness import oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
rng = random.Random(4)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    columns, got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    expected_columns, expected = oracle_rows(FOLDER, queries.ORACLES[name])
    assert columns == expected_columns and got == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


# linkage


def world(n=1500):
    """Persons in households, and two imperfect registers of them: rows as linkage.records has them, and the truth."""
    people = []
    for i in range(n):
        home = i // 2
        r = random.Random(home)
        family, county = int(r.paretovariate(1.0)) % 300, r.randrange(20)
        people.append((i, int(rng.paretovariate(1.0)) % 200, 1000 + family, -rng.randrange(200, 1000), rng.randrange(2), county, home))

    def seen(base, coverage):
        out = []
        for i, g, f, b, s, c, h in people:
            if rng.random() > coverage:
                continue
            g = rng.randrange(200) if rng.random() < 0.08 else None if rng.random() < 0.02 else g
            f = 1000 + rng.randrange(300) if rng.random() < 0.06 else f
            b = b + rng.choice([-12, -2, -1, 1, 2, 12]) if rng.random() < 0.1 else b
            c = rng.randrange(20) if rng.random() < 0.15 else c
            out.append((base + i, g, f, b, s if rng.random() < 0.98 else 1 - s, c, base + 50_000 + h))
        return out

    return seen(1_000_000, 0.9), seen(2_000_000, 0.85)


SCHEMA = "id bigint, g bigint, f bigint, b bigint, s int, c int, h bigint"


def test_linkage_finds_planted_pairs(spark):
    a, b = world()
    da, db = spark.createDataFrame(a + a[:50], SCHEMA), spark.createDataFrame(b, SCHEMA)
    records = lambda d: linkage.records(d.withColumn("block", F.lit("clash")), "id", "g", "f", "b", "s", "c", "h")
    pairs = linkage.link(records(da), records(db)).collect()
    assert len({(r["id_a"], r["id_b"]) for r in pairs}) == len(pairs) and all(0 <= r["confidence"] <= 1 for r in pairs)
    found = {(r["id_a"] - 1_000_000, r["id_b"] - 2_000_000) for r in pairs if r["confidence"] >= 0.5}
    true = {i - 1_000_000 for i, *_ in a} & {i - 2_000_000 for i, *_ in b}
    right = sum(x == y for x, y in found)
    assert right / len(found) > 0.93 and right / len(true) > 0.9, (right / len(found), right / len(true))
    candidates = {(r["id_a"] - 1_000_000, r["id_b"] - 2_000_000) for r in pairs}
    reached = sum((x, x) in candidates for x in true)
    assert reached / len(true) > 0.94, reached / len(true)


def test_linkage_edges(spark):
    a = spark.createDataFrame([(None, 1, 1, 1, 1, 1, 1), (1, None, None, None, None, None, None)], SCHEMA)
    records = lambda d: linkage.records(d, "id", "g", "f", "b", "s", "c", "h")
    assert linkage.link(records(a), records(a)).count() == 0
    assert linkage.link(records(a.limit(0)), records(a.limit(0))).count() == 0


def test_candidates_bear_a_wrong_name_with_a_birth_off(spark):
    """A given name wrong or missing, or a wrong family name, together with a birth some months off."""
    rows = lambda base, people: spark.createDataFrame([(base + i, *p) for i, p in enumerate(people)], SCHEMA)
    a = rows(100, [(1, 10, 500, 1, 3, 7), (2, 20, 500, 0, 4, 8), (3, 30, 500, 1, 5, 9), (4, 40, 500, 1, 6, 11)])
    b = rows(200, [(9, 10, 495, 1, 3, 17), (None, 20, 512, 0, 4, 18), (3, 99, 501, 1, 5, 19), (9, 40, 513, 1, 6, 21)])
    a, b = (linkage._with_kind(linkage._with_kind(x, linkage._name_classes(a, b, "g"), "g"), linkage._name_classes(a, b, "f"), "f") for x in (a, b))
    pairs = linkage._votes(linkage._candidates(linkage._sized(a), linkage._sized(b))).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in pairs) == [(100, 200), (101, 201), (102, 202)]  # 13 months apart is no near birth
    assert all(linkage.in_blocks({v: r[v] for v in linkage.VOTES}) for r in pairs)


def test_household_pass_bears_a_wrong_given_name_with_a_birth_off(spark):
    """In a tied household, across counties and sexes, so that only the household pass can find the pair."""
    a, b = world(600)
    a += [(1_900_000 + k, 150 + k, 5000 + i, -300 - i, 1, 3, 90_000 + i) for i in range(40) for k in (2 * i, 2 * i + 1)]
    b += [(2_900_000 + k, 150 + k if k % 2 else None, 5000 + i, -300 - i + (0 if k % 2 else 5), 1, 3 if k % 2 else 4, 95_000 + i) for i in range(40) for k in (2 * i, 2 * i + 1)]
    records = lambda d: linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h")
    reached = {(r["id_a"], r["id_b"]) for r in linkage.link(records(a), records(b)).collect()}
    assert {(1_900_000 + 2 * i, 2_900_000 + 2 * i) for i in range(40)} <= reached


def test_members_of_large_households_are_compared_and_say_nothing_of_kin(spark):
    """An institution of 40 in each register; every second member has another county and no given name and a birth off."""
    a, b = world(600)
    a += [(1_900_000 + i, 300 + i, 5000 + i, -300 - i, 1, 3, 90_000) for i in range(40)]
    b += [(2_900_000 + i, 300 + i if i % 2 else None, 5000 + i, -300 - i + (0 if i % 2 else 5), 1, 3 if i % 2 else 4, 95_000) for i in range(40)]
    records = lambda d: linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h")
    rows = linkage.link(records(a), records(b)).collect()
    assert len({(r["id_a"], r["id_b"]) for r in rows}) == len(rows)
    assert {(1_900_000 + i, 2_900_000 + i) for i in range(40)} <= {(r["id_a"], r["id_b"]) for r in rows}
    sized = linkage._sized(records(a)).where("id >= 1900000").collect()
    assert all(r["h"] == 90_000 and r["size"] == 40 for r in sized)


@pytest.mark.parametrize("kind", ["given", "birth", "family"])
def test_members_of_large_households_need_one_agreement_as_in_small_ones(spark, kind):
    """Two institutions of 40; every second member agrees on the given name, the birth, or the family name with a birth near, and on nothing else."""
    a, b = world(600)
    a += [(1_900_000 + i, 300 + i, 5000 + i, -300 - i, 1, 3, 90_000) for i in range(40)]
    half = {"given": lambda i: (300 + i, 7000 + i, -900 - 20 * i), "birth": lambda i: (8000 + i, 7000 + i, -300 - i), "family": lambda i: (8000 + i, 5000 + i, -305 - i)}[kind]
    b += [(2_900_000 + i, *((300 + i, 5000 + i, -300 - i) if i % 2 else half(i)), 1, 3 if i % 2 else 4, 95_000) for i in range(40)]
    records = lambda d: linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h")
    rows = linkage.link(records(a), records(b)).select("id_a", "id_b").collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    assert {(1_900_000 + i, 2_900_000 + i) for i in range(40)} <= {tuple(r) for r in rows}


def test_linkage_leaves_no_intermediate_tables(spark):
    """Votes, votes with ties, and pairs are deleted once the next table is stored; the result can still be read, twice."""
    folder = Path(urlparse(checkpoint_dir(spark)).path)
    before = set(folder.iterdir())
    a, b = (linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h") for d in world(200))
    out = linkage.link(a, b)
    assert out.count() == out.count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "rated" in left and not left & {"votes", "voted", "pairs"}


def test_hot_keys_are_split_without_losing_or_repeating_pairs(spark, monkeypatch):
    """A third of all records under one key: the same candidates, split or not."""
    a, b = world(300)
    a += [(1_900_000 + i, 7, 8, -300, i % 2, 3, None) for i in range(60)]
    b += [(2_900_000 + i, 7, 8, -300, i % 2, 3, None) for i in range(40)]
    found = []
    for hot in (10**9, 7):
        monkeypatch.setattr(linkage, "HOT_KEY", hot)
        x, y = (linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h") for d in (a, b))
        x, y = (linkage._sized(linkage._with_kind(linkage._with_kind(z, linkage._name_classes(x, y, "g"), "g"), linkage._name_classes(x, y, "f"), "f")) for z in (x, y))
        found.append(sorted(map(tuple, linkage._votes(linkage._candidates(x, y)).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) >= 2400


def test_exchanged_names_are_found(spark):
    """Given and family name exchanged in one register, without a household that could tie them."""
    a, b = world(2000)
    a = [(*r[:6], None) for r in a]
    b = [(i, f, g, *rest[:3], None) if i % 9 == 0 else (i, g, f, *rest[:3], None) for i, g, f, *rest in b]
    records = lambda d: linkage.records(spark.createDataFrame(d, SCHEMA), "id", "g", "f", "b", "s", "c", "h")
    found = {(r["id_a"] - 1_000_000, r["id_b"] - 2_000_000) for r in linkage.link(records(a), records(b)).where("confidence >= 0.5").collect()}
    names = {i: (g, f) for i, g, f, *_ in a}
    crossed = [i - 2_000_000 for i, g, f, *_ in b if i % 9 == 0 and names.get(i - 1_000_000) == (f, g) and f != g]
    assert len(crossed) > 50 and sum((x, x) in found for x in crossed) > 0.9 * len(crossed)


def test_later_votes_are_learned():
    """A vote that holds for nine of ten matches and for one in a hundred others; one that says nothing."""
    r = np.random.default_rng(2)
    match = r.random(20_000) < 0.3
    odds = np.round(1.75 * np.where(match, r.normal(3, 2, 20_000), r.normal(-4, 2, 20_000)), 1)  # the log odds of such a score, with three matches in ten
    vote = np.where(r.random(20_000) < np.where(match, 0.9, 0.01), 1, 0)
    seen, n = np.unique(np.stack([odds, vote], 1), axis=0, return_counts=True)
    ratio = linkage._later([(o, int(v), int(c)) for (o, v), c in zip(seen, n, strict=True)], 3, [2])
    assert abs(ratio[1] - np.log(90)) < 0.5 and abs(ratio[0] - np.log(0.1 / 0.99)) < 0.3 and ratio[2] == 0


def test_model_joins_dependent_votes():
    shape = [len(v) for v in linkage.VOTES.values()]
    chance = {k: np.array([0.9, *[0.1 / (len(v) - 2)] * (len(v) - 2), 1e-6]) for k, v in linkage.VOTES.items()}
    chance = {k: v / v.sum() for k, v in chance.items()}
    g, counts = np.random.default_rng(2), {}
    for _ in range(20_000):
        birth = 1 if g.random() < 0.8 else 2
        county = 1 if g.random() < (0.95 if birth == 1 else 0.1) else 0
        x = (3 if g.random() < 0.9 else 0, 3, birth, 1, county)
        if linkage.in_blocks(dict(zip(linkage.VOTES, x, strict=True))):
            counts[x] = counts.get(x, 0) + 1
    model = linkage.fit(counts, 1e6, chance)
    assert any({"birth", "county"} <= set(group) for group in model.groups) and model.log_odds.shape == tuple(shape)
    assert model.log_odds[3, 3, 1, 1, 1] > model.log_odds[0, 3, 1, 1, 0]


# leakage


def brute_leaks(docs, items, length):
    def holds(d, w):
        for i in range(len(w) - length + 1):
            part = w[i : i + length]
            for j in range(len(d)):
                if d[j : j + length] == part:
                    return True
                for k in range(1, length - 1):
                    if d[j : j + k] != part[:k]:
                        continue
                    if any(d[j + k + skip : j + k + skip + length - rest] == part[rest:] for skip, rest in ((1, k + 1), (0, k + 1), (1, k))):
                        return True
        return False

    return {(i, k) for i, t in docs if t for k, x in items if x and holds(words(t), words(x))}


def test_leakage_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SEGMENT_WORDS", 300)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 18)))) for k in range(12)]
    docs = []
    for i in range(60):
        d = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if rng.random() < 0.8:
            w = items[rng.randrange(12)][1].split()
            start = rng.randrange(len(w))
            part = w[start : start + rng.randrange(4, 14)]
            at = rng.randrange(len(part))
            part = rng.choice([part, part[:at] + ["new"] + part[at:], part[:at] + part[at + 1 :], part[:at] + ["alt"] + part[at + 1 :]])
            d = d[:5] + part + d[5:]
        docs.append((i, " ".join(d).upper() if i % 3 == 0 else "*" + ",  ".join(d) + "."))
    docs += [(100, None), (None, items[0][1]), (101, ""), (7, docs[7][1]), (8, "another text")]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    di = spark.createDataFrame([*items, (90, None), (None, "x")], "item_id bigint, text string")
    expected = brute_leaks([d for d in docs if d[0] is not None], items, 8)
    for block in (10_000, 40):
        got = {tuple(r) for r in leakage.leaked_items(dd.repartition(2), di, length=8, block_words=block).select("doc_id", "item_id").collect()}
        assert got == expected
    assert leakage.leaked_items(dd.limit(0), di, length=8).count() == 0 and leakage.leaked_items(dd, di.limit(0), length=8).count() == 0


def test_long_documents_are_searched_whole(spark, monkeypatch):
    """Documents of many segments: a passage is found wherever it stands, across the cuts too, and its position is told."""
    monkeypatch.setattr(leakage, "SEGMENT_WORDS", 120)
    monkeypatch.setattr(leakage, "OVERLAP_WORDS", 40)
    item = [f"q{i}" for i in range(16)]
    docs, at = [], {}
    for i in range(40):
        d = [f"w{rng.randrange(50)}" for _ in range(rng.choice([30, 119, 120, 121, 700]))]
        at[i] = rng.randrange(len(d))
        docs.append((i, " ".join(d[: at[i]] + item + d[at[i] :])))
    dd = spark.createDataFrame([*docs, (99, " ".join(f"w{i % 50}" for i in range(900)))], "doc_id bigint, text string").coalesce(2)
    index = leakage.build_index(dd, "doc_id", "text")
    frequency = {r["term"]: r["n"] for r in leakage.term_frequencies(index).collect()}
    got = leakage.passages(index, [("a", item)], frequency, T.StringType(), 12).collect()
    assert {r["doc"]: r["position"] - r["spot"] for r in got if r["n_words"] == 16} == at
    assert {r["doc"] for r in got} == set(at)


def test_segments_are_held_one_at_a_time(spark, monkeypatch):
    """A row group of its own for each segment, and one segment a batch, however many stand in a file."""
    monkeypatch.setattr(leakage, "SEGMENT_WORDS", 100)
    dd = spark.createDataFrame([(i, " ".join(f"w{(7 * i + j) % 50}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    index = leakage.build_index(dd.coalesce(1), "doc_id", "text")
    groups = [pq.ParquetFile(urlparse(f).path).metadata for f in index.inputFiles()]
    assert [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)] == [1] * 20
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(leakage.BATCH_SEGMENTS)}):
        sizes = index.coalesce(1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    assert [r["n"] for r in sizes] == [1] * 20


def test_words_ignore_dress():
    plain = words("Clerk of Marmovik holds 63.1 cards and two, of band 85+")
    assert plain == ["clerk", "of", "marmovik", "holds", "631", "cards", "and", "two", "of", "band", "85"]
    assert words("<p>CLERK&nbsp;<b>of</b> Mar­mo​vik\\nholds 63.1\n> *cards* &amp; two, of band 85+</p>") == plain
    assert words(None) == [] and words(" -- ") == []


def test_longest_stretch():
    item = np.arange(20)
    doc = np.concatenate([[99], np.arange(2, 9), [77], np.arange(10, 18)])
    assert leakage.best_stretch(item, doc, -1, 1)[0] == 16 and leakage.best_stretch(item, doc, -1, 0)[0] == 8


# mixing


def test_token_counts_agree(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()] + ["", "<|endoftext|> ok"]
    ranks = mixing.token_counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts)
    assert ranks == mixing.token_counter("/opt/tokenizers/byte_bpe_50k.json")(texts) and ranks[-2] == 0


@pytest.mark.parametrize("quotas,shards", [([17, 0, 5, 100], 7), ([70_001, 3, 250_000], 1000), ([3 * 10**10, 10**9, 0, 17], 500), ([0, 0], 3), ([2, 1], 9)])
def test_split_tree_is_exact(quotas, shards):
    """Shards get whole blocks, all of them, each within a few of an equal share; subtrees give what the whole tree gives."""
    zero = np.zeros(len(quotas), np.int64)
    leaves = mixing.split_tree(np.array(quotas), 0, shards, zero, 5)
    assert [leaf[0] for leaf in leaves] == list(range(shards))
    dealt = np.array([leaf[3] for leaf in leaves])
    assert (dealt.sum(0) == quotas).all() and (dealt >= 0).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 3
    assert (np.array([leaf[2] for leaf in leaves]) == np.cumsum(dealt, 0) - dealt).all()
    parts = [leaf for lo, hi, first, n in mixing.split_tree(np.array(quotas), 0, shards, zero, 5, 4) for leaf in mixing.split_tree(n, lo, hi, first, 5)]
    assert all((a[3] == b[3]).all() and (a[2] == b[2]).all() for a, b in zip(leaves, parts, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 70_001])
def test_permutation_holds_each_place_once(n):
    got = mixing.permuted(np.arange(n), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != np.arange(n)).mean() > 0.9


@pytest.mark.parametrize("fan,few", [(2, 1), (4, 5), (12, 20_000)])
def test_quota_ends(spark, monkeypatch, fan, few):
    monkeypatch.setattr(mixing, "FAN_BITS", fan)
    monkeypatch.setattr(mixing, "LAST_TEXTS", few)
    rows = [(s, rng.getrandbits(63), f"{i:03d}", rng.randrange(1, 9)) for s in "ab" for i in range(200)] + [("a", 77, f"t{i}", 3) for i in range(4)]
    room = {"a": 5, "b": 400}
    expected = {}
    for s, left in room.items():
        for order, mark, n in sorted(r[1:] for r in rows if r[0] == s):
            if n > left:
                expected[s] = (order, mark)
                break
            left -= n
    assert mixing.quota_ends(spark.createDataFrame(rows, "source string, order bigint, mark string, n_tokens bigint"), room) == expected


def test_mixture_accounts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 400)
    docs = [(i, " ".join(rng.choices("abcdefg", k=rng.randrange(1, 30))), rng.choice(["One", "two-x", " TWO_X ", "three", "stray", None])) for i in range(300)]
    docs += [(900 + i, "same text again", "one") for i in range(200)] + [(1, None, "one"), (2, "", "one")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("copy", F.lit("clash"))
    targets = spark.createDataFrame([("one", 0.5, 1), ("two_x", 0.3, 2), ("three", 0.1, 4), ("gone", 0.1, 3), ("off", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, queries.TOKENIZER_FILE)
    got = mixed.rows.collect()
    report = {r["source"]: r for r in mixed.report.collect()}
    assert set(report) == {"one", "two_x", "three", "gone", "off"} and report["gone"]["n_tokens"] == 0
    uses, text = {}, dict((i, t) for i, t, _ in docs)
    for r in got:
        uses[r["source"], text[r["doc_id"]], r["copy"]] = uses.get((r["source"], text[r["doc_id"]], r["copy"]), 0) + 1
    assert max(uses.values()) == 1
    for s, repeats in (("one", 1), ("two_x", 2), ("three", 4)):
        assert max(r["copy"] for r in got if r["source"] == s) < repeats
    shares = {s: report[s]["n_tokens"] / sum(r["n_tokens"] for r in got) for s in report}
    assert abs(shares["one"] / 0.5 * 0.9 - 1) < 0.06 and abs(shares["two_x"] / 0.3 * 0.9 - 1) < 0.08
    assert sorted((r["shard"], r["place"]) for r in got) == sorted((s, p + 1) for s in {r["shard"] for r in got} for p in range(sum(r["shard"] == s for r in got)))
    again = mixing.mix(df.repartition(3), targets, queries.TOKENIZER_FILE)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.rows.collect()))


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("one", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, queries.TOKENIZER_FILE)
    assert mixed.rows.count() == 0 and mixed.report.first()["n_tokens"] == 0


# quality


def test_statistics_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The cat sat.\n\n- x"), (4, "¡¿?!")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.document_statistics(docs).collect()}
    assert got[1]["n_words"] is None and got[2]["mean_word_length"] is None and got[4]["symbol_ratio"] == 1.0
    assert got[3]["n_words"] == 4 and got[3]["punctuated_lines"] == 0.5


def test_passage_statistics_do_not_depend_on_neighbouring_texts():
    texts = ["One line here.\n- a\n- b", "Another text of words, long enough to count.", "x" * 300, "| a | b |\n| c | d |", "\U0001f600 <b>of</b> &amp; the 12.5"]
    cut = [quality.passages(t) for t in texts]
    alone = np.vstack([quality.statistics(ps, [0]) for ps in cut])
    starts = np.cumsum([0, *map(len, cut)])[:-1]
    assert np.allclose(alone, quality.statistics([p for ps in cut for p in ps], starts.tolist()))


def prose(i):
    return f"The clerk of the office said that the letter number {i} had not been found, and so we went home with it."


def listing(i):
    return f"Vik{i} | {i * 7} | 18-44 | {i % 10}.5"


def test_junk_is_told_from_prose(spark):
    docs = []
    for i in range(400):
        n = rng.randrange(1, 8)
        kinds = [rng.random() < (0.9 if i % 2 else 0.1) for _ in range(n)]
        lines = [listing(rng.randrange(900)) if junk else prose(rng.randrange(900)) for junk in kinds]
        junk = sum(len(x) for x, j in zip(lines, kinds, strict=True) if j) / sum(map(len, lines))
        docs.append((i, "\n".join(lines), junk))
    docs += [(1000, None, 0.0), (1001, " \n ", 0.0), (None, "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, truth double").withColumn("junk", F.lit("clash"))
    got = {r["doc_id"]: r["junk_share"] for r in quality.junk_shares(df.union(df.limit(20))).collect()}
    assert set(got) == set(range(400))
    assert sum((got[i] > 0.5) == (t > 0.5) for i, _, t in docs[:400]) >= 392


def test_quality_of_nothing_and_of_one_kind(spark):
    df = spark.createDataFrame([(1, prose(1))], "doc_id bigint, text string")
    assert quality.junk_shares(df.limit(0)).count() == 0
    assert quality.junk_shares(df).first()["junk_share"] == 0.0


def test_quality_without_words(spark):
    """A corpus without any prose is judged by what the made-up documents taught."""
    df = spark.createDataFrame([(i, "\n".join(listing(j) for j in range(i, i + 5))) for i in range(30)], "doc_id bigint, text string")
    assert min(r["junk_share"] for r in quality.junk_shares(df).collect()) > 0.9


def test_a_text_of_a_third_of_all_rows_changes_nothing(spark):
    rows = [(i, prose(i) + "\n" + listing(i)) for i in range(60)]
    some, many = (spark.createDataFrame(rows + [(100 + i, listing(7)) for i in range(n)], "doc_id bigint, text string") for n in (1, 30))
    got = [{r["doc_id"]: (r["junk_share"], r["expected_share"]) for r in quality.junk_shares(d).where("doc_id <= 100").collect()} for d in (some, many)]
    assert got[0] == got[1]


def test_held_out_passages(spark):
    """Passages written by hand, of many kinds and languages, that neither training nor calibration sees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judge = quality.train(docs)
    cut = [quality.passages(b) for _, _, b in HELD_OUT]
    starts = np.cumsum([0, *map(len, cut)])[:-1]
    p = judge.probabilities(quality.statistics([x for c in cut for x in c], starts.tolist(), judge.language))
    called, at = [], 0
    for c in cut:
        sizes = np.array([len(x) for x in c])
        called.append((sizes * (p[at : at + len(c)] > 0.5)).sum() > sizes.sum() / 2)
        at += len(c)
    called, truth = np.array(called), np.array([y == 1 for _, y, _ in HELD_OUT])
    recall, precision = (called & truth).sum() / truth.sum(), (called & truth).sum() / called.sum()
    assert recall >= 0.85 and precision >= 0.9, [k for (k, _, _), c, t in zip(HELD_OUT, called, truth, strict=True) if c != t]


def test_kinds_of_junk_that_no_label_names(spark, monkeypatch):
    """Trained without one label of junk from the corpus, on made-up layouts alone, the judge still finds its junk."""
    texts = sorted({r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()})
    both = quality.fit(texts, 1500)
    rules = quality.weak_labels
    monkeypatch.setattr(quality, "weak_labels", lambda x: np.where(rules(x) == 1, -1, rules(x)))
    alone = quality.fit(texts, 1500)

    def junk(judge):
        out = []
        for counts, ps, x in quality.in_passes(texts, judge.language):
            size, doc = np.array([len(p) for p in ps]), np.repeat(np.arange(len(counts)), counts)
            out += list(np.bincount(doc, size * (judge.probabilities(x) > 0.5), len(counts)) / np.bincount(doc, size, len(counts)) > 0.5)
        return np.array(out)

    a, b = junk(both), junk(alone)
    assert a.sum() > 100 and (a & b).sum() >= 0.93 * a.sum() and (a & b).sum() >= 0.93 * b.sum()


def test_every_text_teaches(spark):
    """Words that stand in two of 4,000 texts each are all known, whatever texts they stand in."""
    letters = "bcdfghjklmnpqrstvwxz"
    words = ["q" + "".join(letters[i // 20**k % 20] + "a" for k in range(3)) for i in range(2000)]
    df = spark.createDataFrame([(i, f"The clerk said in the letter number {i} that the {words[i % 2000]} was not to be found.") for i in range(4000)], "doc_id bigint, text string")
    language = quality.train(df).language
    spot = np.minimum(np.searchsorted(language.words, quality._hashed(words)), len(language.words) - 1)
    assert ((language.words[spot] == quality._hashed(words)) & ((language.flags[spot] & 2) != 0)).all()


def test_a_judge_does_not_depend_on_where_it_is_trained(spark, monkeypatch):
    """In memory, in one task and by all tasks, from rows in any parts, the same judge is learned."""
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "MADE_UP_DOCUMENTS", 150)
    monkeypatch.setattr(quality, "ROUND_PASSAGES", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    judges = [quality.fit(texts, 150), quality.train(docs)]
    monkeypatch.setattr(quality, "ONE_TASK", 0)
    judges.append(quality.train(docs.union(docs.limit(30)).repartition(5)))
    numbers = [[j.trees.feature, j.trees.threshold, j.trees.value, j.language.words, j.language.flags, j.language.own, j.language.usual, np.array([j.trees.base, j.slope, j.offset])] for j in judges]
    assert all(np.array_equal(a, b) for other in numbers[1:] for a, b in zip(numbers[0], other, strict=True))


def test_characters_are_read_once(monkeypatch):
    """The order of words and the statistics that depend on the language come from the units found at the first reading."""
    read, codes = Counter(), quality._Codes.__init__
    monkeypatch.setattr(quality._Codes, "__init__", lambda self, plain, *a: (read.update(plain), codes(self, plain, *a))[1])
    monkeypatch.setattr(quality, "ROUNDS", 2)
    lines = [listing(i) for i in range(300)]
    quality.fit([prose(i) + "\n" + line for i, line in enumerate(lines)], 60)
    assert {read[line] for line in lines} == {1}


def test_words_are_counted_as_they_are_written():
    """Counts of words in small letters by their numbers equal those of a reading word by word."""
    r = random.Random(8)
    some = "the The tHe iphone iPhone eBay McDonald İstanbul ıslak ǅep straße 漢字かなthe ไทย x1y don't co-op 𐐀a ﬁn été ÉTÉ ªb".split()
    ps = [" ".join(r.choice(some) for _ in range(r.randint(1, 9))) for _ in range(400)]
    flags, slow, fast = np.array([r.random() < 0.7 for _ in ps]), Counter(), Counter()
    quality.count_words([p for p, f in zip(ps, flags, strict=True) if f], slow)
    z = quality._Codes(ps)
    z.units()
    quality.count_lower_words(z, flags, fast)
    assert dict(quality.lower_words(fast)) == dict(quality.lower_words(slow))


@pytest.mark.parametrize("depth", (1, 3, 6, 8))
def test_rows_walk_down_trees(depth, monkeypatch):
    """Rows that walk together come to the leaves that each finds alone, also by codes of numbers."""
    monkeypatch.setattr(boosting, "WALKED", 300)
    r, inner = np.random.default_rng(depth), 2**depth - 1
    x = r.normal(size=(1000, 5)).astype(np.float32)
    x = quality.decoded(quality.encoded(np.where(r.random(x.shape) < 0.2, 0, x)))
    threshold = np.where(r.random((4, inner)) < 0.3, np.inf, r.choice(np.append(x.ravel(), 0), (4, inner))).astype(np.float32)
    trees = boosting.Trees(r.integers(0, 5, (4, inner)), threshold, r.normal(size=(4, inner + 1)), 0.5)
    alone = np.full(len(x), 0.5)
    for feature, limit, value in zip(trees.feature, threshold, trees.value, strict=True):
        for i, row in enumerate(x):
            at = 0
            while at < inner:
                at = 2 * at + 1 + int(row[feature[at]] > limit[at])
            alone[i] += value[at - inner]
    assert (trees.margins(x) == alone).all()
    judge = quality.Judge(quality.plain_language(), trees)
    assert (judge.probabilities_of_codes(quality.encoded(x.T)) == judge.probabilities(x)).all()


@pytest.mark.parametrize("few", range(1, boosting.MOST_STRATA + 1))
def test_all_groups_of_passages_are_dealt_equally(few):
    seen = [g for r in range(quality.ROUNDS) for g in boosting.dealt(r, few)]
    assert [seen.count(g) for g in range(boosting.STRATA)] == [quality.ROUNDS * few // boosting.STRATA] * boosting.STRATA


def test_codes_of_statistics():
    whole = np.arange(512)
    assert (quality.decoded(quality.encoded(whole)) == whole).all()
    x = np.sort(np.random.default_rng(5).normal(size=4000) * np.random.default_rng(6).choice([1e-8, 0.01, 1, 100], 4000)).astype(np.float32)
    c = quality.encoded(x)
    assert (np.diff(c) >= 0).all() and (quality.encoded(quality.decoded(c)) == c).all() and np.abs(quality.decoded(c) - x).max() <= np.abs(x).max() / 256


def test_trees_learn():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.boost(x[:2000], y[:2000], np.ones(2000), 60, 4)
    assert ((trees.margins(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    again = boosting.boost(x[:2000], y[:2000], np.ones(2000), 60, 4)
    assert (trees.margins(x) == again.margins(x)).all()
