"""Elementwise mathematics on columns. Results are doubles; NaN and null pass through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num | str) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def missing(x: Column) -> Column:
    """Null or NaN."""
    return x.isNull() | F.isnan(x.cast("double"))


def valid(x: Column) -> Column:
    """The value as double, null where it is NaN."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


# Logarithms follow IEEE, not SQL: log(0) is -Infinity, log of a negative number NaN.
def _ieee_log(x: Column, value: Column) -> Column:
    return F.when(x > 0, value).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x)


def log(x: Column) -> Column:
    return _ieee_log(x.cast("double"), F.log(x))


def log2(x: Column) -> Column:
    return _ieee_log(x.cast("double"), F.log2(x))


def log10(x: Column) -> Column:
    return _ieee_log(x.cast("double"), F.log10(x))


def log1p(x: Column) -> Column:
    return _ieee_log(x.cast("double") + 1, F.log1p(x))


def logb(x: Column) -> Column:
    """The binary exponent."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.floor(F.log2(F.abs(x))).cast("double"))


exp, expm1, sqrt, cbrt = F.exp, F.expm1, F.sqrt, F.cbrt
sin, cos, tan, asin, acos, atan, atan2, hypot = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2, F.hypot
sinh, cosh, tanh, asinh, acosh, atanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh
deg2rad, rad2deg = F.radians, F.degrees


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def square(x: Column) -> Column:
    return x.cast("double") * x


def power(x: Column, y: Num) -> Column:
    return F.pow(x, col(y))


def divide(x: Column, y: Num) -> Column:
    """x / y; anything over zero is +Infinity."""
    return F.when(col(y) == 0, F.lit(float("inf"))).otherwise(x.cast("double") / F.nullif(col(y).cast("double"), F.lit(0.0)))


def reciprocal(x: Column) -> Column:
    return divide(F.lit(1.0), x)


def mod(x: Column, y: Num) -> Column:
    """Remainder with the sign of the dividend; modulo zero is NaN."""
    return F.when(col(y) == 0, F.lit(float("nan"))).otherwise(x.cast("double") % F.nullif(col(y).cast("double"), F.lit(0.0)))


def remainder(x: Column, y: Num) -> Column:
    """IEEE remainder: x minus the nearest multiple of y, ties to even."""
    return x - col(y) * F.rint(x / col(y))


def trunc(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double")


fix = trunc
rint = F.rint


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_n(x: Column, n: int = 0) -> Column:
    """Half away from zero, by scaling with 10^n."""
    scaled = x.cast("double") * (10.0**n)
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / (10.0**n)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def copysign(x: Column, y: Num) -> Column:
    return F.abs(x) * F.when(col(y) < 0, -1.0).otherwise(1.0)


def maximum(x: Column, y: Column) -> Column:
    """The larger; NaN if either is NaN (Spark sorts NaN above all numbers)."""
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def minimum(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).when(x.isNotNull() & y.isNotNull(), F.least(x, y))


def all_close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Aggregate: whether |x - y| <= atol + rtol |y| everywhere; NaN or null makes it false."""
    near = F.abs(x - y) <= atol + rtol * F.abs(y)
    return F.coalesce(F.bool_and(F.coalesce(near & ~F.isnan(x) & ~F.isnan(y), F.lit(False))), F.lit(True))


def horner(x: Column, coefficients: list[float]) -> Column:
    """A polynomial, lowest coefficient first."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


ELEMENTWISE = {f.__name__: f for f in (log, log2, log10, log1p, logb, exp2, exp10, square, reciprocal, trunc, floor, ceil, round_n, sign)} | {
    n: getattr(F, n) for n in ("exp", "expm1", "sqrt", "cbrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "radians", "degrees", "rint", "abs")
}
