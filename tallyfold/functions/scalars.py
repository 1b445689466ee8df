"""Scalar expressions: ages, bands, safe ratios, identifier bits, keyed random numbers, discounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Age bands of releases, of rates, and the broad bands of rates (inclusive ends).
RELEASE_BANDS = (("0-15", 0, 15), ("16-24", 16, 24), ("25-44", 25, 44), ("45-64", 45, 64), ("65+", 65, 999))
RATE_BANDS = (("0-17", 0, 17), ("18-44", 18, 44), ("45-64", 45, 64), ("65-74", 65, 74), ("75-84", 75, 84), ("85+", 85, 999))
BROAD_BANDS = (("0-17", 0, 17), ("18-64", 18, 64), ("65+", 65, 999))
NAMESPACE_BITS = 56


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age(tick: str | Column, birth_tick: str | Column) -> Column:
    """Completed years from month ticks; floors, as birth ticks may be negative."""
    return F.floor((as_column(tick) - as_column(birth_tick)) / 12)


def band(value: str | Column, bands=RATE_BANDS, strict: bool = False) -> Column:
    """Label of the inclusive band that holds ``value``; outside all of them NULL, or an error if ``strict``."""
    v = as_column(value)
    out = reduce(lambda c, b: c.when((v >= b[1]) & (v <= b[2]), b[0]), bands[1:], F.when((v >= bands[0][1]) & (v <= bands[0][2]), bands[0][0]))
    return out.otherwise(F.when(v.isNotNull(), F.raise_error(F.concat(F.lit("no band for "), v.cast("string"))))) if strict else out


def edge_index(value: str | Column, edges: list[float], right: bool = False) -> Column:
    """Number of edges at or below ``value`` (``right``: below it), the index of a half-open class."""
    v = as_column(value)
    over = [(v > e) if right else (v >= e) for e in edges]
    return F.when(v.isNotNull(), reduce(lambda a, b: a + b, [o.cast("int") for o in over], F.lit(0)))


def clip(value: str | Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_column(value)))


def ratio(over: str | Column, under: str | Column, otherwise=None) -> Column:
    """``over / under``, and ``otherwise`` where ``under`` is zero or NULL."""
    under = as_column(under)
    return F.when(under != 0, as_column(over) / under).otherwise(F.lit(otherwise))


def first_positive(*columns: str | Column) -> Column:
    """The first of the columns that is zero or more."""
    return F.coalesce(*[F.when(as_column(c) >= 0, as_column(c)) for c in columns])


def namespace(entity: str | Column) -> Column:
    """The kind of an entity, from the top byte of its id."""
    return F.shiftrightunsigned(as_column(entity), NAMESPACE_BITS)


def sequence_number(entity: str | Column) -> Column:
    return as_column(entity).bitwiseAND(F.lit((1 << NAMESPACE_BITS) - 1))


def entity_id(kind: int, number: str | Column) -> Column:
    return F.shiftleft(F.lit(kind).cast("long"), NAMESPACE_BITS).bitwiseOR(as_column(number).cast("long"))


def flags(**conditions: Column) -> Column:
    """A bit mask of conditions, the first in bit 0; NULL conditions leave their bit clear."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())])


def has_flag(mask: str | Column, bit: int) -> Column:
    return as_column(mask).bitwiseAND(F.lit(1 << bit)) != 0


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in (0, 1) that depends on seed and key alone, not on partitions or order."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[as_column(k) for k in key]), 11)
    return (bits + 0.5) / float(1 << 53)


def normal(seed: int, *key: str | Column) -> Column:
    """A standard normal draw keyed like ``uniform`` (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * F.pi() * uniform(seed + 1, *key))


def expit(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-as_column(x)))


def logit(p: str | Column) -> Column:
    return F.log(as_column(p) / (1 - as_column(p)))


def gompertz(age_: str | Column, a: float, b: float) -> Column:
    """Yearly probability of death, 1 - exp(-exp(a + b age))."""
    return 1 - F.exp(-F.exp(F.lit(a) + F.lit(b) * as_column(age_)))


def monthly(yearly: str | Column, multiplier=1.0) -> Column:
    """Monthly probability from a yearly one under a hazard multiplier."""
    return 1 - F.pow(1 - as_column(yearly), F.lit(multiplier) / 12)


def discount(month: str | Column, yearly_rate: float) -> Column:
    return F.pow(F.lit(1.0 + yearly_rate), -as_column(month) / 12.0)


def half_even(value: str | Column, unit: float = 1.0) -> Column:
    """Rounded to a multiple of ``unit``, halves to the even one."""
    return F.rint(as_column(value) / unit) * unit


def rogan_gladen(share: str | Column, sensitivity: float, specificity: float) -> Column:
    """A prevalence corrected for a test's errors, kept within 0 and 1."""
    return clip((as_column(share) + specificity - 1) / (sensitivity + specificity - 1), 0.0, 1.0)


def gamma_quantile(mean: str | Column, shape: str | Column, z: float) -> Column:
    """Approximate quantile of a gamma variable (Wilson-Hilferty), z the normal quantile."""
    k = as_column(shape)
    t = 1 - 1 / (9 * k) + z / (3 * F.sqrt(k))
    return as_column(mean) * F.greatest(t, F.lit(0.0)) * F.greatest(t, F.lit(0.0)) * F.greatest(t, F.lit(0.0))
