"""Tail probabilities of t, F, chi-square and normal, as column functions for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * front


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 and not math.isnan(t) else math.nan


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f >= 0 else math.nan


def chi2_upper(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


def _column(f):
    @F.pandas_udf(T.DoubleType())
    def one(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else f(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype="float64")

    def of(*columns: Column) -> Column:
        padded = [*columns, *[F.lit(0.0)] * (3 - len(columns))]
        return one(*[c.cast("double") for c in padded])

    return of


t_p_value = _column(lambda t, df, _: t_two_sided(t, df))
f_p_value = _column(f_upper)
chi2_p_value = _column(lambda x, df, _: chi2_upper(x, df))


# Coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution to about 1e-9, as one column expression; null outside (0, 1)."""
    tail = lambda q: _poly(_C, q) / _poly(_D, q)
    middle = (p - 0.5) * _poly(_A, (p - 0.5) * (p - 0.5)) / _poly(_B, (p - 0.5) * (p - 0.5))
    inside = F.when(p < _LOW, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - _LOW, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)
    return F.when((p > 0) & (p < 1), inside)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, for small result tables."""
    return _column(lambda x, _, __: 0.5 * math.erfc(x / math.sqrt(2)))(z)
