"""Transforms of one series against numpy, by factors and over a chirp."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import frame, spectrum


def series(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, v double")


def complexes(df):
    return np.array([complex(r["re"], r["im"]) for r in sorted(df.collect())])


@pytest.mark.parametrize("n", [1, 2, 12, 97, 360])
@pytest.mark.parametrize("longest", [1, 1 << 17])
def test_series_of_any_length(spark, n, longest):
    x = np.random.default_rng(n).normal(size=n)
    there = spectrum.fft_series(series(spark, x), ["t"], "v", longest=longest)
    assert np.allclose(complexes(there), np.fft.fft(x), atol=1e-9)
    back = spectrum.fft_series(there.select("k", F.struct("re", "im").alias("z")), ["k"], "z", inverse=True, longest=longest)
    assert np.allclose(complexes(back), x, atol=1e-9)


@pytest.mark.parametrize("n", [9, 10])
def test_real_halves(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    half = spectrum.rfft_series(series(spark, x), ["t"], "v")
    assert np.allclose(complexes(half), np.fft.rfft(x))
    assert np.allclose([r["v"] for r in sorted(spectrum.irfft_series(half, n).collect())], x)


def test_power_is_the_variance(spark):
    t = np.arange(240)
    x = 3 * np.sin(2 * np.pi * t / 12) + np.cos(2 * np.pi * t / 5) + 7
    got = {r["k"]: r["power"] for r in spectrum.power_spectrum(series(spark, x), ["t"], "v").collect()}
    assert sorted(got, key=got.get)[-2:] == [48, 20] and abs(sum(got.values()) - np.var(x)) < 1e-9


def test_order_nulls_and_emptiness(spark):
    shuffled = spark.createDataFrame([(3, 4.0), (1, 2.0), (2, None), (0, 1.0)], "re long, im double")
    assert all(r["re"] is None for r in spectrum.fft_series(shuffled, ["re"], "im").collect())
    got = complexes(spectrum.fft_series(shuffled.fillna(3.0), ["re"], "im"))
    assert np.allclose(got, np.fft.fft([1, 2, 3, 4]))
    assert spectrum.fft_series(shuffled.limit(0), ["re"], "im").count() == 0


def test_no_group_holds_the_series(spark, monkeypatch):
    monkeypatch.setattr(frame, "PART_ROWS", 500)
    x = np.random.default_rng(1).normal(size=8191)  # a prime
    there = spectrum.fft_series(series(spark, x), ["t"], "v", longest=1000)
    assert np.allclose(complexes(there), np.fft.fft(x), atol=1e-8)
