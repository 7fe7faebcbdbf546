"""Generated tables: ranges, grids and random samples; the same for a seed however many executors there are partitions of."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """(pos, value), half-open."""
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(float(start)) + F.col("id") * step).alias("value"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """(pos, value), endpoint included."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(float(start)) + F.col("id") * step).alias("value"))


def full(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(float(value)).alias("value"))


def _u(seed: int, k: int = 0) -> F.Column:
    """A uniform number in (0, 1): 52 bits of the MD5 of seed:k:id, which any database can draw again."""
    h = F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _drawn(seed: int, key: str) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _let(x: F.Column, f) -> F.Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def draw_uniform(key: F.Column, seed: int, turn: F.Column | int = 0) -> F.Column:
    """A number in (0, 1): 52 bits of the MD5 of seed:turn:key."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    h = F.md5(F.concat(F.lit(f"{seed}:"), turn.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: Attempts at a gamma draw; each succeeds with 95 % or more, and what comes after the successful one is not computed.
ATTEMPTS = 64


def draw_gamma(shape: F.Column, key: F.Column, seed: int = 0) -> F.Column:
    """A gamma draw of any positive shape (a column, so each row may have its own) and scale 1; null for other shapes.

    Marsaglia and Tsang's rejection: attempt i takes the draws 3 i, 3 i + 1 (a
    normal z) and 3 i + 2 (the test) of the row's key. Shapes below 1 are drawn
    at shape + 1 and multiplied by u^(1 / shape).
    """
    own = shape.cast("double")
    lifted = F.when(own < 1, own + 1).otherwise(own)
    d = lifted - 1.0 / 3.0
    c = 1 / F.sqrt(9 * d)
    u = lambda i, j: draw_uniform(key, seed, i * 3 + j)

    def attempt(i: F.Column) -> F.Column:
        z = F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1))
        taken = lambda z, v: F.when((v > 0) & (F.log(u(i, 2)) < z * z / 2 + d * (1 - v + F.log(F.when(v > 0, v)))), d * v)
        return _let(z, lambda z: _let((1 + c * z) * (1 + c * z) * (1 + c * z), lambda v: taken(z, v)))

    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), lambda s, i: F.coalesce(s, attempt(i)))
    lifting = F.when(own < 1, F.pow(draw_uniform(key, seed, -1), 1 / own)).otherwise(1.0)
    return F.when(own > 0, drawn * lifting)


def draw_beta(a: F.Column, b: F.Column, key: F.Column, seed: int = 0) -> F.Column:
    """A beta draw of any positive shapes: x / (x + y) of two gamma draws with seeds of their own."""
    x, y = draw_gamma(a, key, 2 * seed), draw_gamma(b, key, 2 * seed + 1)
    return _let(x, lambda x: x / (x + y))


def sample(spark: SparkSession, kind: str, n: int, seed: int = 0, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """(pos, value): uniform(a, b), normal(mean a, sd b), exponential(rate b), binomial(trials a, p b), poisson(mean b), gamma(shape a, scale b), beta(a, b)."""
    if kind == "binomial" and (a != int(a) or a < 0):
        raise ValueError("the number of trials must be whole")
    if kind in ("gamma", "beta") and not (a > 0 and b > 0):
        raise ValueError("shapes and scales must be positive")
    normal = F.sqrt(-2 * F.log(_u(seed, 0))) * F.cos(2 * math.pi * _u(seed, 1))
    if kind == "poisson":
        p, steps, total = math.exp(-b), [], 0.0
        for k in range(int(b + 12 * math.sqrt(b) + 30)):
            total += p
            steps.append(total)
            p *= b / (k + 1)
        value = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= _u(seed))).cast("double")
    else:
        value = {
            "uniform": lambda: a + _u(seed) * (b - a),
            "normal": lambda: a + b * normal,
            "exponential": lambda: -F.log(_u(seed)) / b,
            "binomial": lambda: sum(((_u(seed, i) < b).cast("double") for i in range(int(a))), F.lit(0.0)),
            "gamma": lambda: draw_gamma(F.lit(float(a)), F.col("id"), seed) * b,
            "beta": lambda: draw_beta(F.lit(float(a)), F.lit(float(b)), F.col("id"), seed),
        }[kind]()
    return spark.range(n).select(F.col("id").alias("pos"), value.alias("value"))


def choice(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, those of least hash: no global sort, only the n best of each part."""
    return df.orderBy(_drawn(seed, key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in hashed order."""
    return df.orderBy(_drawn(seed, key), key)
