"""Column helpers with the rounding and guards that the indicators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; default where b is 0 or either is null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def places(x: Column | str, n: int) -> Column:
    """x to n places as Python's round() gives it: by the exact value of the double, true ties to the even neighbour.

    The product x * 10^n may be off by a rounding, which matters only where it looks like a tie. There its error, exact as
    a sum of products of halves of the factors, tells on which side of the tie x lies. Numbers too large to have n places
    stay as they are.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale, split = 10.0**n, 134217729.0
    high = scale * split - (scale * split - scale)

    def exact(v: Column) -> Column:
        p, c = v * scale, v * split
        upper = c - (c - v)
        lower = v - upper
        error = ((upper * high - p) + upper * (scale - high) + lower * high) + lower * (scale - high)
        whole = F.when((F.abs(p - F.rint(p)) != 0.5) | (error == 0), F.rint(p)).when(error > 0, p + 0.5).otherwise(p - 0.5)
        return F.when(F.abs(p) >= 2.0**53, v).otherwise(whole / scale)

    # evaluated once, whatever x is
    return F.element_at(F.transform(F.array(x.cast("double")), exact), 1)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ladder(steps: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first step whose condition holds."""
    condition, value = steps[0]
    out = F.when(condition, F.lit(value))
    for condition, value in steps[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def at_least(x: Column, steps: dict[float, object], default: object) -> Column:
    """The value of the first threshold (in the order given) that x reaches."""
    return ladder([(x >= t, v) for t, v in steps.items()], default)


def grade(score: Column) -> Column:
    return at_least(score, {80: "Strong Buy", 60: "Buy", 40: "Neutral", 20: "Caution"}, "Avoid")


def sector_grade(average: Column) -> Column:
    return at_least(average, {70: "Strong", 55: "Bullish", 40: "Neutral", 25: "Bearish"}, "Weak")


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
