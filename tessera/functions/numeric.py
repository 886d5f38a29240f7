"""Division, null and growth rules. Three divisions and three sums differ on purpose and stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_positive(a: Column, b: Column) -> Column:
    """Null unless the denominator is above zero."""
    return F.when(b > 0, a / b)


def ratio_nonzero(a: Column, b: Column) -> Column:
    """Null where the denominator is zero; a negative one counts."""
    return F.when(b != 0, a / b)


def per_share(a: Column, shares: Column) -> Column:
    return F.when(shares > 0, a / shares)


def sum_any(a: Column, b: Column) -> Column:
    """Null only if both are; a missing one is zero."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def minus_optional(a: Column, b: Column) -> Column:
    """Null if the first is; a missing second is zero."""
    return a - F.coalesce(b, F.lit(0))


def annual_growth(first: Column, last: Column, days: Column) -> Column:
    """Compound growth a year over ``days``; both ends must be positive."""
    years = days / 365.25
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow((last / first).cast("double"), 1 / years) - 1)


def relative_error(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """|a - b| over the larger magnitude."""
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor)))


def gated(count: Column, least: int, value: Column) -> Column:
    return F.when(count >= least, value)


def unscaled_share(weight: Column, largest: Column) -> Column:
    """A weight as a share: percentages are scaled where the largest exceeds one."""
    return F.when(largest > 1, weight / 100).otherwise(weight)


def nearest_factor(ratio: Column, factors: tuple[float, ...] = (1.5, 2.0, 3.0, 4.0, 5.0, 10.0), tolerance: float = 0.06) -> Column:
    """The factor or inverse within tolerance of the ratio, else one."""
    known = [f for x in factors for f in (x, 1 / x)]
    out = None
    for f in known:
        hit = F.abs(ratio / f - 1) <= tolerance
        out = F.when(hit, F.lit(f)) if out is None else out.when(hit, F.lit(f))
    return out.otherwise(F.lit(1.0))
