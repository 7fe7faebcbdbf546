"""Fourier transforms of one endless series, as two rounds of short transforms.

A series of n = n1 x n2 values is dealt twice: into n2 groups of n1 values that
lie n2 apart, and, after a turn of each value, into n1 groups of n2. So a task
holds about the square root of the series. A length without such factors is
turned into a convolution with a chirp, whose length is a power of two.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import POS, with_position

#: Values of one group from which on a series takes the way over a chirp.
LONGEST = 1 << 17


def _factors(n: int) -> tuple[int, int]:
    """The two factors of n that lie nearest to its root, the smaller one first."""
    low = math.isqrt(n)
    while n % low:
        low -= 1
    return low, n // low


def _turned(angle: Column) -> tuple[Column, Column]:
    """re and im, turned by ``angle``."""
    c, s = F.cos(angle), F.sin(angle)
    return F.col("re") * c - F.col("im") * s, F.col("re") * s + F.col("im") * c


def _short(rows: DataFrame, group: str, place: str, size: int, name: str, sign: int) -> DataFrame:
    """(group, name, re, im): transforms of ``size`` values per group; absent places are zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size, complex)
        x[pdf[place].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * size
        return pd.DataFrame({group: pdf[group].iloc[0], name: np.arange(size), "re": y.real, "im": y.imag})

    return rows.select(group, place, "re", "im").groupBy(group).applyInPandas(run, f"{group} long, {name} long, re double, im double")


def _two_rounds(rows: DataFrame, low: int, high: int, sign: int) -> DataFrame:
    """(k, re, im), unnormalised, of (n, re, im) with places below low x high; absent places are zero."""
    dealt = rows.select((F.col("n") % high).alias("b"), F.floor(F.col("n") / high).alias("a"), "re", "im")
    first = _short(dealt, "b", "a", low, "k1", sign)
    # b * k1 is below n, so the angle is a fraction of one turn.
    re, im = _turned(F.col("b") * F.col("k1") * F.lit(sign * 2 * math.pi / (low * high)))
    second = _short(first.select("k1", "b", re.alias("re"), im.alias("im")), "k1", "b", high, "k2", sign)
    return second.select((F.col("k1") + F.lit(low) * F.col("k2")).alias("k"), "re", "im")


def _chirp(place: str, n: int, sign: int) -> Column:
    """The angle sign * pi * place^2 / n, from the square's exact rest modulo 2n."""
    wide = F.col(place).cast("decimal(18,0)")
    return F.pmod(wide * wide, F.lit(2 * n).cast("decimal(18,0)")).cast("double") * F.lit(sign * math.pi / n)


def _by_chirp(rows: DataFrame, n: int, sign: int) -> DataFrame:
    """(k, re, im) of any length: n * k = (n^2 + k^2 - (k - n)^2) / 2 makes the transform a convolution."""
    bits = (2 * n - 2).bit_length()
    low, high = 1 << bits // 2, 1 << (bits - bits // 2)
    m = low * high
    re, im = _turned(_chirp("n", n, sign))
    ours = _two_rounds(rows.select("n", re.alias("re"), im.alias("im")), low, high, -1)
    away = rows.sparkSession.range(1 - n, n).withColumn("d", F.col("id"))
    angle = _chirp("d", n, -sign)
    wave = away.select(F.pmod("id", F.lit(m)).alias("n"), F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    theirs = _two_rounds(wave, low, high, -1).select(F.col("k").alias("k_"), F.col("re").alias("re_"), F.col("im").alias("im_"))
    both = ours.join(theirs, F.col("k") == F.col("k_"))
    product = both.select(F.col("k").alias("n"), (F.col("re") * F.col("re_") - F.col("im") * F.col("im_")).alias("re"), (F.col("re") * F.col("im_") + F.col("im") * F.col("re_")).alias("im"))
    back = _two_rounds(product, low, high, 1).where(F.col("k") < n)
    re, im = _turned(_chirp("k", n, sign))
    return back.select("k", (re / m).alias("re"), (im / m).alias("im"))


def _transform(rows: DataFrame, n: int, sign: int, longest: int) -> DataFrame:
    if n == 0:
        return rows.select(F.col("n").alias("k"), "re", "im")
    low, high = _factors(n)
    done = _two_rounds(rows, low, high, sign) if high <= longest else _by_chirp(rows, n, sign)
    return done if sign < 0 else done.select("k", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im"))


def fft_series(df: DataFrame, order: list[str], value: str, inverse: bool = False, longest: int = LONGEST) -> DataFrame:
    """(k, re, im) of one series of any length in ``order``; forward unnormalised, inverse by 1/n.

    ``value`` is a number or a struct of re and im. A null or NaN value makes
    every result null; an empty table gives no rows; rows equal in ``order`` take
    either place. No task holds more than about the larger of two factors of
    the length, or twice its root if that is above ``longest``.
    """
    paired = df.schema[value].dataType.typeName() == "struct"
    re, im = (F.col(f"{value}.re"), F.col(f"{value}.im")) if paired else (F.col(value), F.lit(0.0))
    placed = with_position(df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], re.cast("double").alias("re"), im.cast("double").alias("im")), [f"__o{i}" for i in range(len(order))])
    return _transform(placed.select(F.col(POS).alias("n"), "re", "im"), df.count(), 1 if inverse else -1, longest)


def rfft_series(df: DataFrame, order: list[str], value: str, longest: int = LONGEST) -> DataFrame:
    """The rows k <= n / 2 of ``fft_series``: what determines the transform of real values."""
    return fft_series(df, order, value, False, longest).where(2 * F.col("k") <= df.count())


def irfft_series(half: DataFrame, n: int, longest: int = LONGEST) -> DataFrame:
    """(n, v): the real series of ``n`` values whose ``rfft_series`` is ``half`` (k, re, im); absent rows are zero."""
    rest = half.where((F.col("k") > 0) & (2 * F.col("k") < n)).select((F.lit(n) - F.col("k")).alias("n"), "re", (-F.col("im")).alias("im"))
    whole = half.where((F.col("k") >= 0) & (2 * F.col("k") <= n)).select(F.col("k").alias("n"), "re", "im").unionByName(rest)
    return _transform(whole, n, 1, longest).select(F.col("k").alias("n"), F.col("re").alias("v"))


def power_spectrum(df: DataFrame, order: list[str], value: str, longest: int = LONGEST) -> DataFrame:
    """(k, frequency, power) of the series less its mean, 0 < k <= n / 2: the shares of its variance that sum to it."""
    n = df.count()
    mean = df.agg(F.avg(F.col(value).cast("double"))).first()[0]
    centred = df.select(*order, (F.col(value).cast("double") - F.lit(mean)).alias("__v"))
    some = fft_series(centred, order, "__v", False, longest).where((F.col("k") > 0) & (2 * F.col("k") <= n))
    twice = F.when(2 * F.col("k") == n, 1.0).otherwise(2.0)
    return some.select("k", (F.col("k") / n).alias("frequency"), (twice * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (float(n) * n)).alias("power"))
