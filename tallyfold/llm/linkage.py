"""Entities matched across two tables without a shared key, by a label model.

Heuristic matching functions vote on every candidate pair: on given name, family name, birth, sex, county, on exchanged
names, on links between the other members of the two households, and on whether a better rival exists. A vote is a category (a name
that agrees votes by how rare it is; a missing value abstains). A generative model explains how often each combination
of votes occurs by true matches and by chance, learns how often each function is right and which functions depend on
each other, and gives every pair the posterior probability of being one entity.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import forget, stored

#: Names that at least this share of records bear are common, or fairly common; 1 / the smallest bounds their number.
COMMON, FAIRLY_COMMON = 0.01, 0.001
#: Household members up to which all members of tied households are paired before the pairs are chosen; in larger ones they
#: are joined on what they agree on. What a tie of larger households says is learned apart.
CLOSE_HOME = 20
#: Kinds of blocks that are joined at a time.
BLOCKS = ((1,), (2, 3), (4,), (5,), (6,))
#: Records of one blocking key beyond which its join is split, each part meeting all records of the other side.
HOT_KEY = 2_000
#: Largest table of votes that are learned together, in cells; it keeps every table well filled.
MOST_CELLS = 30
#: Categories of the votes. 0 disagrees, the last but one of sex and county and the last of names abstain.
NAME = ("differs", "common", "fairly_common", "rare", "missing")
BIRTH = ("differs", "exact", "near", "within_a_year", "missing")
PLAIN = ("differs", "agrees", "missing")
#: Exchanged names are a vote of the given name; the family name then abstains, since it has been told already.
GIVEN = ("differs", "common", "fairly_common", "rare", "exchanged", "missing")
VOTES = {"given": GIVEN, "family": NAME, "birth": BIRTH, "sex": PLAIN, "county": PLAIN}
MATES = ("none", "linked", "unknown", "none_of_many", "linked_among_many")
RIVAL = ("best", "close", "beaten")
NEAR, YEAR = 3, 12


@dataclass
class LabelModel:
    """What is learned: expected matches, and log odds per combination of votes."""

    matches: float = 0.0
    groups: list[tuple[str, ...]] = field(default_factory=list)
    log_odds: np.ndarray | None = None
    accuracies: dict[str, np.ndarray] = field(default_factory=dict)
    chance: dict[str, np.ndarray] = field(default_factory=dict)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``stored``, and the shuffle files of the step removed once it is written: nothing reads them again."""
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean)
    conf.set(clean, "true")
    try:
        return stored(df, label, {"compression": "zstd"})
    finally:
        conf.set(clean, before)


def records(df: DataFrame, entity: str, given: str, family: str, birth: str, sex: str, county: str, household: str) -> DataFrame:
    """Distinct descriptions of the entities; rows without an id are left out, other columns are pruned."""
    return df.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("id"), F.col(given).alias("g"), F.col(family).alias("f"), F.col(birth).cast("long").alias("b"),
        F.col(sex).alias("s"), F.col(county).alias("c"), F.col(household).alias("h"),
    ).distinct()


def _name_classes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Names that are common in the two tables together: ``name, kind`` (1 common, 2 fairly common), at most 1000 rows."""
    both = a.select(column).unionByName(b.select(column)).where(F.col(column).isNotNull())
    total = both.count()
    counts = both.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FAIRLY_COMMON * total)
    return counts.select("name", F.when(F.col("n") >= COMMON * total, 1).otherwise(2).alias("kind"))


def _with_kind(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """``rows`` with the class of a name; the classes are at most 1 / FAIRLY_COMMON rows and may be broadcast."""
    kinds = F.broadcast(classes.select(F.col("name").alias(column), F.col("kind").alias(f"{column}_kind")))
    return rows.join(kinds, column, "left").withColumn(f"{column}_kind", F.coalesce(f"{column}_kind", F.lit(3)))


def _name_vote(column: str) -> Column:
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    missing = len(GIVEN if column == "g" else NAME) - 1
    return F.when(a.isNull() | b.isNull(), missing).when(_exchanged(), 4).when(a == b, F.col(f"a.{column}_kind")).otherwise(0)


def _plain_vote(column: str) -> Column:
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return F.when(a.isNull() | b.isNull(), 2).when(a == b, 1).otherwise(0)


def _exchanged() -> Column:
    """Whether one record has as given name what the other has as family name, and the other way round."""
    return F.coalesce((F.col("a.g") == F.col("b.f")) & (F.col("a.f") == F.col("b.g")) & (F.col("a.g") != F.col("a.f")), F.lit(False))


def _birth_vote() -> Column:
    apart = F.abs(F.col("a.b") - F.col("b.b"))
    return F.when(apart.isNull(), 4).when(apart == 0, 1).when(apart <= NEAR, 2).when(apart <= YEAR, 3).otherwise(0)


def _votes(pairs: DataFrame) -> DataFrame:
    cast = {"given": _name_vote("g"), "family": _name_vote("f"), "birth": _birth_vote(), "sex": _plain_vote("s"), "county": _plain_vote("c")}
    return pairs.select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b"),
        ((F.col("a.size") > CLOSE_HOME) | (F.col("b.size") > CLOSE_HOME)).alias("many"), *[v.cast("int").alias(k) for k, v in cast.items()]
    )


def _blocks(rows: DataFrame, neighbours: bool, kinds: tuple[int, ...]) -> DataFrame:
    """Each record under its blocking keys: 1 both names and the year of birth, 2 family name and birth, 3 given name, birth and county,
    4 family name, county, sex and the year of birth, 5 given name, county, sex and the year of birth, 6 both names exchanged and the year of birth.

    The side with ``neighbours`` stands under the years before and after as well, and has its names exchanged in the last. Only
    keys of ``kinds`` are made."""
    year = F.floor(F.col("b") / YEAR)
    by_year = ((1, ("g", "f")), (4, ("f", "c", "s")), (5, ("g", "c", "s")), (6, ("f", "g") if neighbours else ("g", "f")))
    keys = [(k, year + d) for k in by_year for d in ((-1, 0, 1) if neighbours else (0,))] + [((2, ("f",)), F.col("b")), ((3, ("g", "c")), F.col("b"))]
    # a key with a missing part is NULL and joins nothing
    each = [F.struct(F.lit(kind).alias("kind"), F.when(F.concat(*[F.col(c).cast("string") for c in names], at.cast("string")).isNotNull(), F.xxhash64(*names, at)).alias("key")) for (kind, names), at in keys if kind in kinds]
    return rows.withColumn("z", F.explode(F.array(*each))).withColumns({"kind": F.col("z.kind"), "key": F.col("z.key")}).where(F.col("key").isNotNull()).drop("z")


def _split_hot(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: the records of a key that many of ``a`` share are spread over parts, and those of ``b`` repeated for each."""
    hot = a.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("kind", "key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("parts"))
    hot = _kept(hot, "hot-keys")
    if hot.isEmpty():
        return a.withColumn("part", F.lit(0)), b.withColumn("part", F.lit(0))
    a, b = (x.join(hot, ["kind", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (a, b))
    whole = F.pmod(F.xxhash64("id", "b", "h"), F.col("parts")).cast("int")
    return a.withColumn("part", whole).drop("parts"), b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _candidates(a: DataFrame, b: DataFrame, kinds: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Every pair of records that shares a block of ``kinds``, once: a pair is left to the first kind of block that it shares."""
    a, b = _split_hot(_blocks(a, True, kinds), _blocks(b.drop("g_kind", "f_kind"), False, kinds))
    pairs = a.alias("a").join(b.alias("b"), ["kind", "key", "part"])
    same = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
    apart = F.abs(F.col("a.b") - F.col("b.b"))
    first = F.when(F.col("kind") == 2, ~same("g")).when(F.col("kind") == 3, ~same("f"))
    # births alike are left to blocks 2 and 3, both names alike to block 1
    first = first.when(F.col("kind") == 4, ~same("g") & (apart > 0) & (apart <= YEAR)).when(F.col("kind") == 5, ~same("f") & (apart > 0) & (apart <= YEAR))
    first = first.when(F.col("kind") == 6, ~same("g") & ~same("f"))
    return pairs.where(first.otherwise(True))


def in_blocks(votes: dict[str, int]) -> bool:
    """Whether every pair with these votes shares a block, so that its number is fully observed."""
    given, family, near = votes["given"] in (1, 2, 3), votes["family"] in (1, 2, 3), votes["birth"] in (1, 2, 3)
    exact, placed = votes["birth"] == 1, votes["county"] == 1 and votes["sex"] == 1
    return (given and family and near) or (family and exact) or (given and exact and votes["county"] == 1) or ((given or family) and near and placed) or (votes["given"] == 4 and near)


def _unblocked() -> Column:
    """The opposite of ``in_blocks`` for a row of votes."""
    given, family, near = (F.col(v).isin(1, 2, 3) for v in ("given", "family", "birth"))
    exact, county = F.col("birth") == 1, F.col("county") == 1
    crossed = (F.col("given") == 4) & near
    return ~((given & family & near) | (family & exact) | (given & exact & county) | ((given | family) & near & county & (F.col("sex") == 1)) | crossed)


def _chance(a: DataFrame, b: DataFrame, classes: dict[str, DataFrame]) -> tuple[float, dict[str, np.ndarray]]:
    """Number of all pairs, and the exact shares of every vote among them, from the frequencies of values."""
    def shares(column: str, kinds: int, offsets: dict[int, int] | None = None, kind: Column | None = None, also: float = 0.0) -> np.ndarray:
        fa = a.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("na"))
        fb = b.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("nb"))
        ta, tb = (x.agg(F.sum(n).alias("t"), F.sum(F.when(F.col("v").isNull(), F.col(n)).otherwise(0)).alias("m")).first() for x, n in ((fa, "na"), (fb, "nb")))
        out = np.zeros(kinds)
        known = fa.where(F.col("v").isNotNull())
        if offsets:
            known = known.select(F.explode(F.array(*[F.struct((F.col("v") + d).alias("v"), F.lit(k).alias("k")) for d, k in offsets.items()])).alias("z"), "na").select("z.v", "z.k", "na")
        elif kind is not None:
            known = _with_kind(known.withColumnRenamed("v", column), classes[column], column).select(F.col(column).alias("v"), F.col(f"{column}_kind").alias("k"), "na")
        else:
            known = known.withColumn("k", F.lit(1))
        out[4:-1] = also
        for r in known.join(fb, "v").groupBy("k").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("n")).collect():
            out[r["k"]] = r["n"]
        pairs = float(ta["t"] or 0) * float(tb["t"] or 0)
        both = float((ta["t"] or 0) - (ta["m"] or 0)) * float((tb["t"] or 0) - (tb["m"] or 0))
        out[0], out[-1] = max(both - out.sum(), 0.0), pairs - both
        sizes.append(pairs)
        return (out + 0.5) / (pairs + 0.5 * kinds)

    sizes: list[float] = []
    births = {d: 1 if d == 0 else 2 if abs(d) <= NEAR else 3 for d in range(-YEAR, YEAR + 1)}
    u = {
        "given": shares("g", 6, kind=F.lit(0), also=_exchanged_pairs(a, b)), "family": shares("f", 5, kind=F.lit(0)), "birth": shares("b", 5, offsets=births),
        "sex": shares("s", 3), "county": shares("c", 3),
    }
    return sizes[0], u


def _exchanged_pairs(a: DataFrame, b: DataFrame) -> float:
    """The number of all pairs with exchanged names."""
    fa, fb = (x.where(F.col("g").isNotNull() & F.col("f").isNotNull()).groupBy("g", "f").agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "n"), (b, "m")))
    crossed = fa.where(F.col("g") != F.col("f")).join(fb.select(F.col("g").alias("f"), F.col("f").alias("g"), "m"), ["g", "f"])
    return float(crossed.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0)


def fit(counts: dict[tuple[int, ...], int], pairs: float, chance: dict[str, np.ndarray], rounds: int = 200, dependence: float = 0.01) -> LabelModel:
    """Fit the label model to the number of candidates with each combination of votes.

    A combination x is expected M m(x) + pairs u(x) times, where u is known from the frequencies of values and M, the
    number of matches, and m are learned by EM. Combinations that no block reaches are missing data: the matches among
    them are imputed; births that differ by more than a year, which no block reaches, are taken to be as frequent as those
    three months to a year apart, and missing ones as frequent as in the tables. m is a product over groups of functions, at first one each; as long as two groups are more
    dependent among the matches than ``dependence`` (mutual information in nats), they are joined, and m is refitted,
    up to tables of ``MOST_CELLS`` (larger ones would be learned from few matches a cell).
    """
    names = list(VOTES)
    shape = tuple(len(VOTES[v]) for v in names)
    n = np.zeros(shape)
    for x, c in counts.items():
        n[x] = c
    observed = np.zeros(shape, bool)
    for x in itertools.product(*[range(s) for s in shape]):
        observed[x] = in_blocks(dict(zip(names, x, strict=True)))
    u = np.ones(shape)
    for i, v in enumerate(names):
        u = u * chance[v].reshape([-1 if j == i else 1 for j in range(len(shape))])
    # start: matches agree nine times out of ten on every function, abstaining as chance does
    start = {}
    for v in names:
        agree = np.array([0.1, *[0.9 / (len(VOTES[v]) - 2)] * (len(VOTES[v]) - 2), 0.0])
        start[v] = agree * (1 - chance[v][-1]) + np.eye(len(agree))[-1] * chance[v][-1]
    groups: list[tuple[int, ...]] = [(i,) for i in range(len(names))]
    matches = max(n[observed].sum() / 2, 1.0)
    m = np.ones(shape)
    for i, v in enumerate(names):
        m = m * start[v].reshape([-1 if j == i else 1 for j in range(len(shape))])

    def em(m: np.ndarray, matches: float) -> tuple[np.ndarray, float, np.ndarray]:
        for _ in range(rounds):
            hit = matches * m
            expected = np.where(observed, n * hit / np.maximum(hit + pairs * u, 1e-300), hit)
            # no block reaches births that differ or are missing, so nothing could be learned of them
            expected[:, :, 0] = expected[:, :, 3]
            missing = chance["birth"][-1]
            expected[:, :, 4] = expected[:, :, :4].sum(axis=2) * missing / (1 - missing)
            matches = max(expected.sum(), 1e-9)
            m = np.ones(shape)
            for g in groups:
                other = tuple(j for j in range(len(shape)) if j not in g)
                table = expected.sum(axis=other, keepdims=True) + 0.01
                m = m * table / table.sum()
        return m, matches, expected

    m, matches, expected = em(m, matches)
    while True:
        best, pick = dependence, None
        p = np.where(observed, expected, 0.0)
        q = np.where(observed, matches * m, 0.0)
        if p.sum() < 100 or q.sum() <= 0:
            break
        for g, h in itertools.combinations(groups, 2):
            if np.prod([shape[i] for i in g + h]) > MOST_CELLS:
                continue
            other = tuple(j for j in range(len(shape)) if j not in g + h)
            a, b = p.sum(axis=other) / p.sum(), q.sum(axis=other) / q.sum()
            gain = float((a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12))).sum())
            if gain > best:
                best, pick = gain, (g, h)
        if pick is None:
            break
        groups = [g for g in groups if g not in pick] + [tuple(sorted(pick[0] + pick[1]))]
        m, matches, expected = em(m, matches)
    odds = np.log(np.maximum(matches * m, 1e-300)) - np.log(np.maximum(pairs * u, 1e-300))
    own = {v: expected.sum(axis=tuple(j for j in range(len(shape)) if j != i)) / max(expected.sum(), 1e-9) for i, v in enumerate(names)}
    return LabelModel(matches, [tuple(names[i] for i in g) for g in groups], odds, own, chance)


def _odds(model: LabelModel) -> Column:
    """The learned log odds of a row's votes, as a lookup in a literal table of 1350 numbers."""
    place = F.lit(0)
    for v, kinds in VOTES.items():
        place = place * len(kinds) + F.col(v)
    return F.element_at(F.array(*[F.lit(float(x)) for x in model.log_odds.ravel()]), (place + 1).cast("int"))


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of records of their household, 1 where it is missing."""
    sizes = rows.where(F.col("h").isNotNull()).groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "h", "left").withColumn("size", F.coalesce("size", F.lit(1)))


def _within_large(ties: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of tied households of which one is large, ``h_a, h_b, size_a, size_b``, who agree on birth, on given name, or on family name with births within a year.

    The same pairs as in small households, found by joins on what agrees; each pair of records once. The
    smaller household of a tie is spread over its ties, so a large one tied to many others is not.
    """
    a, b = (x.where(F.col("h").isNotNull()).withColumn("home", F.col("h")) for x in (a, b))
    sized = ties.withColumnsRenamed({"h_a": "home_a", "h_b": "home_b"})
    spread_a = F.col("size_a") <= F.col("size_b")
    year, out = F.floor(F.col("b") / YEAR), []

    def keyed(x: DataFrame, neighbours: bool) -> DataFrame:
        keys = [(1, ("f",), year + d) for d in ((-1, 0, 1) if neighbours else (0,))] + [(2, (), F.col("b")), (3, ("g",), F.lit(0))]
        each = [F.struct(F.lit(k).alias("kind"), F.when(F.concat(*[F.col(c).cast("string") for c in names], at.cast("string")).isNotNull(), F.xxhash64(*names, at)).alias("key")) for k, names, at in keys]
        return x.withColumn("z", F.explode(F.array(*each))).withColumns({"kind": F.col("z.kind"), "key": F.col("z.key")}).where(F.col("key").isNotNull()).drop("z")

    for side, x, y in (("a", a, b), ("b", b, a)):
        to = "home_b" if side == "a" else "home_a"
        mine = sized.where(spread_a if side == "a" else ~spread_a).select(F.col(f"home_{side}").alias("home"), F.col(to).alias("to"))
        l, r = keyed(x.join(mine, "home"), True).alias(side), keyed(y, False).withColumnRenamed("home", "to").alias("b" if side == "a" else "a")
        pairs = l.join(r, ["to", "kind", "key"])
        given, family = (F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False)) for c in ("g", "f"))
        apart = F.abs(F.col("a.b") - F.col("b.b"))
        first = F.when(F.col("kind") == 1, family & ~given & (apart > 0) & (apart <= YEAR)).when(F.col("kind") == 2, apart == 0).otherwise(given & (F.coalesce(apart, F.lit(1)) > 0))
        out.append(_votes(pairs.where(first)).where(_unblocked()))
    return out[0].unionByName(out[1])


def _numbered(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the values of a column replaced by small numbers, and the stored numbers, ``v, n``."""
    numbers = _kept(rows.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct().withColumn("n", F.monotonically_increasing_id()), f"numbers-{column}")
    return rows.withColumnRenamed(column, "v").join(numbers, "v", "left").drop("v").withColumnRenamed("n", column), numbers


def _later(counts: list[tuple[float, int, int]], kinds: int, unknown: list[int], rounds: int = 50) -> np.ndarray:
    """Log likelihood ratio of each category of a later vote, by EM from ``(log odds so far, category, number)``.

    Categories in ``unknown`` say nothing by definition. Votes that depend on each other are given as one with a category per combination.
    """
    ratio = np.zeros(kinds)
    if not counts:
        return ratio
    base, vote, n = (np.array(x, float) for x in zip(*counts, strict=True))
    vote = vote.astype(int)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(base + ratio[vote], -500, 500)))
        m, u = (np.bincount(vote, weights=w * n, minlength=kinds) + 0.5 for w in (p, 1 - p))
        ratio = np.log(m / m.sum()) - np.log(u / u.sum())
        ratio[unknown] = 0.0
    return ratio


def _ratio(table: np.ndarray, category: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in table]), (category + 1).cast("int"))


def link(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidate pairs of two tables of ``records`` with their confidence: ``id_a, id_b, confidence``, one row per pair.

    Confidence is the posterior of the pair's best pair of descriptions. An id may be in several pairs (ids are split
    and merged). Missing values abstain; repeated rows count once; an empty side gives no pairs. Every pair of records
    that shares a block is compared, without a cap; after the first fit, members of linked households that share a
    birth, a given name, or a family name with births within a year are compared as well, whatever the size of the
    households. What ties of households and better rivals say is learned too, by size of household and for both together, since they depend on
    each other. Only counts per combination of votes and frequencies of at most a few categories reach the driver.
    """
    classes = {c: _name_classes(a, b, c) for c in ("g", "f")}
    classes = {c: _kept(k, f"names-{c}") for c, k in classes.items()}
    # what every candidate carries is kept small: ids and households are tokens that do not compress
    (a, ids_a), (b, ids_b) = (_numbered(_numbered(x, "h")[0], "id") for x in (a, b))
    a, b = (_kept(_sized(_with_kind(_with_kind(x, classes["g"], "g"), classes["f"], "f")), "records") for x in (a, b))
    pairs, chance = _chance(a, b, classes)
    # one kind of block after the other, so that the shuffle of one is gone before the next
    parts = [_kept(_votes(_candidates(a, b, kinds)), "votes") for kinds in BLOCKS]
    content = reduce(DataFrame.unionByName, parts)
    counts = {tuple(r[v] for v in VOTES): r["n"] for r in content.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(counts, pairs, chance)

    sure = content.withColumn("odds", _odds(model)).where(F.col("odds") > np.log(9))
    tied = sure.where(F.col("h_a").isNotNull() & F.col("h_b").isNotNull()).select("h_a", "h_b", "id_a", "id_b").distinct()
    ties = tied.groupBy("h_a", "h_b").agg(F.count_distinct("id_a").alias("n_a"), F.count_distinct("id_b").alias("n_b"), F.min("id_a").alias("only_a"), F.min("id_b").alias("only_b"))
    for x, side in ((a, "a"), (b, "b")):
        ties = ties.join(x.where(F.col("h").isNotNull()).select(F.col("h").alias(f"h_{side}"), F.col("size").alias(f"size_{side}")).distinct(), f"h_{side}")
    ties = _kept(ties, "ties")
    many = (F.col("size_a") > CLOSE_HOME) | (F.col("size_b") > CLOSE_HOME)
    # members of tied households, by the same birth, the same given name, or the same family name and births within a year; not those that share a block
    left = ties.where(~many).select("h_a", "h_b").join(a.withColumnRenamed("h", "h_a"), "h_a").withColumnRenamed("h_a", "h")
    mates = _votes(left.alias("a").join(b.alias("b"), F.col("a.h_b") == F.col("b.h"))).where(_unblocked())
    mates = mates.where((F.col("birth") == 1) | F.col("given").isin(1, 2, 3) | (F.col("family").isin(1, 2, 3) & F.col("birth").isin(2, 3)))
    large = ties.where(many).select("h_a", "h_b", "size_a", "size_b")
    if not large.isEmpty():
        mates = mates.unionByName(_within_large(large, a, b))
    every = content.unionByName(mates).withColumn("odds", _odds(model))
    # a tie counts for a pair if another entity on both sides made it; a household that is missing says nothing
    other = (F.col("n_a") > 1) | (F.col("only_a") != F.col("id_a"))
    other = other & ((F.col("n_b") > 1) | (F.col("only_b") != F.col("id_b")))
    unknown = F.col("h_a").isNull() | F.col("h_b").isNull()
    mate = F.when(unknown, 2).otherwise(F.when(F.col("n_a").isNotNull() & other, 1).otherwise(0) + F.when(F.col("many"), 3).otherwise(0))
    voted = _kept(every.join(ties.drop("size_a", "size_b"), ["h_a", "h_b"], "left").select("id_a", "id_b", "odds", mate.alias("mates")), "voted")
    for part in parts:
        forget(part)
    count = F.count(F.lit(1)).alias("n")
    tie = _later([tuple(r) for r in voted.groupBy(F.round("odds", 1).alias("odds"), "mates").agg(count).collect()], len(MATES), [2])
    # one row per pair of ids: its best description, by content and by what its tie says
    scored = voted.withColumn("score", F.col("odds") + _ratio(tie, F.col("mates")))
    best = scored.groupBy("id_a", "id_b").agg(F.max("score").alias("score"), F.max_by("mates", F.col("score") + F.col("mates") * 1e-9).alias("mates"))
    best = _kept(best.withColumn("odds", F.col("score") - _ratio(tie, F.col("mates"))), "pairs")
    forget(voted)
    top_a = best.groupBy("id_a").agg(F.max("score").alias("top_a"))
    top_b = best.groupBy("id_b").agg(F.max("score").alias("top_b"))
    behind = F.greatest("top_a", "top_b") - F.col("score")
    rated = best.join(top_a, "id_a").join(top_b, "id_b").withColumn("rival", F.when(behind <= 0, 0).when(behind <= 3, 1).otherwise(2))
    rated = _kept(rated.select("id_a", "id_b", "odds", (F.col("mates") * len(RIVAL) + F.col("rival")).alias("later")), "rated")
    forget(best)
    both = _later([tuple(r) for r in rated.groupBy(F.round("odds", 1).alias("odds"), "later").agg(count).collect()], len(MATES) * len(RIVAL), [])
    z = F.col("odds") + _ratio(both, F.col("later"))
    out = rated.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("confidence"))
    out = out.join(ids_a.select(F.col("n").alias("a"), F.col("v").alias("id_a")), "a").join(ids_b.select(F.col("n").alias("b"), F.col("v").alias("id_b")), "b")
    return out.select("id_a", "id_b", "confidence")
