"""Column helpers used by all operators; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals: results stay comparable whatever the order of summation was."""
    return F.round(c, 6)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b; a zero or null denominator gives ``otherwise``."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; null counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows that have both; null where one of them doesn't vary (``corr`` fails there)."""
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def slope(y: Column, x: Column) -> Column:
    """Slope of the least-squares line; null where x doesn't vary."""
    v = F.var_pop(F.when(y.isNotNull(), x))
    return F.when(v > 0, F.covar_pop(x, y) / v)


def std0(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def once(c: Column, f) -> Column:
    """f(c), with c evaluated a single time (a column that is used within a lambda is evaluated per element otherwise)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def ladder(c: Column, steps: Sequence[tuple[float, str]], last: str, strict: bool = False) -> Column:
    """First label whose bound is reached (c >= bound, or c > bound if strict); bounds descend."""
    out = F
    for bound, label in steps:
        out = out.when(c > bound if strict else c >= bound, label)
    return out.otherwise(last)


def bucket(c: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """First label whose bound isn't exceeded (c <= bound); bounds ascend."""
    out = F
    for bound, label in steps:
        out = out.when(c <= bound, label)
    return out.otherwise(last)


#: Colours of a simple and a medium panel, gates below the root of an easy and a medium tree.
COMPLEXITY = ((15, "simple"), (25, "medium"))
DIFFICULTY = ((10, "easy"), (18, "medium"))


def z_quantile(p: float) -> float:
    """Normal quantile by the rational approximation with three coefficients each (Abramowitz and Stegun 26.2.23)."""
    import math

    if p <= 0 or p >= 1:
        return math.copysign(math.inf, p - 0.5)
    if p == 0.5:
        return 0.0
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    # Fixed values of the approximation.
    top = 2.515517 + 0.802853 * t + 0.010328 * t * t
    bottom = 1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3
    return math.copysign(t - top / bottom, p - 0.5)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by the five-term polynomial for erf (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    # Fixed values of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * (1 + F.signum(x) * (1 - poly * F.exp(-z * z)))
