"""Two-sided p-values. Applied to result tables with one row per tested feature."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    result = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + top / c
            c = c if abs(c) > floor else floor
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    weight = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return weight * _beta_fraction(a, b, x) / a
    return 1.0 - weight * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


# ---- the same as column expressions: a row is worked out by folds over short sequences, without Python ----------------------

#: Terms of the folds; beyond LARGE degrees of freedom Student's t is turned into a normal deviate instead.
BETA_TERMS, ERFC_TERMS, GAMMA_STEPS = 700, 80, 16
LARGE = 20_000.0


def _fold(terms: int, start: Column, step: Callable[[Column, Column], Column], first: int = 1) -> Column:
    return F.aggregate(F.sequence(F.lit(first), F.lit(terms)).cast("array<double>"), start, step)


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) > 1e-300, x).otherwise(F.lit(1e-300))


def _beta_fraction_column(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of `_beta_fraction`, with as many terms as its slowest case needs."""
    one = F.lit(1.0)
    d0 = one / _away_from_zero(one - (a + b) * x / (a + 1.0))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("r"))

    def half(state: Column, top: Column) -> Column:
        d = one / _away_from_zero(one + top * state["d"])
        c = _away_from_zero(one + top / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["r"] * c * d).alias("r"))

    def even(state: Column, m: Column) -> Column:
        return half(state, m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2)))

    def odd(state: Column, m: Column) -> Column:
        return half(state, -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1)))

    # one fold step takes one of the two terms of each m, so that an expression is not repeated within another
    def step(state: Column, k: Column) -> Column:
        m = F.floor((k + 1) / 2).cast("double")
        return F.when(k % 2 == 1, even(state, m)).otherwise(odd(state, m))

    return _fold(2 * BETA_TERMS, start, step)["r"]


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the series for large arguments, brought down step by step."""
    big = a + GAMMA_STEPS
    i = 1.0 / big
    series = -i / 8 + i**3 / 192 - i**5 / 640 + i**7 * 17 / 14336 - i**9 * 31 / 18432
    down = _fold(GAMMA_STEPS, F.lit(1.0), lambda product, k: product * (a + k - 1) / (a + k - 0.5))
    return F.sqrt(big) * F.exp(series) * down


def _half_beta(a: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function I(x; a, 1/2); `rest` is 1 - x, given apart as it may be tiny."""
    half = F.lit(0.5)
    weight = F.exp(a * F.log(x) + F.log(rest) / 2) * _gamma_ratio(a) / math.sqrt(math.pi)
    low = x < (a + 1.0) / (a + 2.5)
    return F.when(low, weight * _beta_fraction_column(a, half, x) / a).otherwise(1.0 - weight * _beta_fraction_column(half, a, rest) / half)


def z_p_value(z: Column | str) -> Column:
    """Two-sided p-value of a normal deviate: the series of the error function near zero, a continued fraction in the tail."""
    x = F.abs(F.col(z) if isinstance(z, str) else z).cast("double") / math.sqrt(2.0)
    near = _fold(
        ERFC_TERMS, F.struct(x.alias("t"), x.alias("s")),
        lambda state, n: F.struct((state["t"] * x * x * 2 / (n * 2 + 1)).alias("t"), (state["s"] + state["t"] * x * x * 2 / (n * 2 + 1)).alias("s")),
    )["s"]
    series = 1.0 - F.exp(-x * x) * near * 2.0 / math.sqrt(math.pi)
    tail = _fold(ERFC_TERMS, x, lambda f, k: x + (ERFC_TERMS + 1 - k) / 2.0 / f)
    fraction = F.exp(-x * x) / tail / math.sqrt(math.pi)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x < 2.5, series).otherwise(fraction)


def _deviate(t: Column, df: Column) -> Column:
    """The normal deviate with the tail of Student's t, for many degrees of freedom."""
    a = df - 0.5
    b = a * a * 48.0
    y = a * F.log1p(t * t / df)
    return (((((y * -0.4 - 3.3) * y - 24.0) * y - 85.5) / (y * y * 0.8 + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)


def t_p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value of Student's t with any (also fractional) degrees of freedom; null where one is missing."""
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    t, df = t.cast("double"), df.cast("double")
    whole = df + t * t
    exact = F.when(t == 0, 1.0).otherwise(_half_beta(df / 2.0, df / whole, t * t / whole))
    missing = t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df)
    return F.when(missing, F.lit(None)).when(df > LARGE, z_p_value(_deviate(t, df))).otherwise(exact)
