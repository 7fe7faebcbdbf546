"""Operators of the second round against numpy, the standard library or brute force on small fixtures."""

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.distributions import normal_quantile
from tessera.operators import bayes, describe, frame, inference, matrix, ndarray
from tessera.sources import files


def sign_pairs(x, y):
    return sum(int(np.sign((b[0] - a[0]) * (b[1] - a[1]))) for a, b in combinations(list(zip(x, y, strict=True)), 2))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 200])
def test_concordance_is_all_pairs(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float)
    assert describe.concordance(x, y) == sign_pairs(x, y)


@pytest.mark.parametrize("hot", [False, True])
def test_kendall_over_many_strips(spark, monkeypatch, hot):
    monkeypatch.setattr(frame, "PART_ROWS", 40)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 60, 400).astype(float), rng.normal(size=400).round(1)
    if hot:
        x[:150] = 7.0
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, float("nan"))]
    got = describe.kendall_tau(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()[0]
    assert got == pytest.approx(sign_pairs(x, y) / (400 * 399 / 2), abs=1e-12)
    assert describe.kendall_tau(spark.createDataFrame([], "x double, y double"), "x", "y").first()[0] is None


def test_kfold_strata_are_even(spark, monkeypatch):
    monkeypatch.setattr(frame, "PART_ROWS", 50)
    rows = [(i, "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(600)]
    folded = inference.kfold(spark.createDataFrame(rows, "id long, s string"), 5, "id", stratify="s")
    counts = {}
    for r in folded.collect():
        counts.setdefault(r["s"], [0] * 5)[r["fold"]] += 1
    assert {k: max(v) - min(v) for k, v in counts.items()} == {"hot": 0, "a": 0, None: 0}


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02, 0.02425, 0.3, 0.5, 0.9, 0.98, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-8, rtol=2e-9)
    assert spark.range(1).select(normal_quantile(F.lit(0.0)), normal_quantile(F.lit(1.5))).first() == (None, None)


def test_shapiro_wilk_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(1)
    w = lambda v: inference.shapiro_wilk(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()["w"]
    assert w(rng.normal(size=500)) > 0.99 > 0.9 > w(rng.exponential(size=500) ** 2)
    assert w([1.0] * 5) is None


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.agg(describe.correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert describe.spearman(df, "x", "y").first()[0] is None


def test_permutation_test(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v + (3 if i % 2 else 0)), float(v), bool(i % 2)) for i, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame([*rows, (900, None, None, True), (901, 1.0, 1.0, None)], "id long, moved double, same double, g boolean")
    moved = inference.permutation_test(df, "moved", F.col("g"), key=["id"]).first()
    same = inference.permutation_test(df, "same", F.col("g"), key=["id"]).first()
    assert moved["observed"] == pytest.approx(3, abs=0.4) and moved["p_value"] == 0
    assert 0.01 < same["p_value"] < 0.99


def test_manova_of_equal_groups(spark):
    rows = [(g, float(x), float(y)) for g in "ab" for x, y in [(1, 2), (2, 1), (4, 4), (3, 0)]]
    got = inference.manova(spark.createDataFrame(rows, "g string, x double, y double"), ["x", "y"], "g").first()
    assert got["wilks"] == pytest.approx(1) and got["pillai"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("tables", [False, True])
def test_solvers_of_unsymmetric_systems(spark, monkeypatch, tables):
    if tables:
        monkeypatch.setattr(matrix, "_on_driver", lambda a, b: None)
    m = [[4.0, 1.0, 0.0], [-1.0, 3.0, 0.5], [0.0, 2.0, 5.0]]
    b = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -1.0)], "i long, v double")
    for f in (matrix.bicgstab, matrix.gmres):
        x = {r["i"]: r["v"] for r in f(matrix.from_rows(spark, m), b, 1e-10).collect()}
        assert np.allclose([x[0], x[1], x[2]], np.linalg.solve(m, [1, 2, -1]))


def test_solvers_raise_on_singular_systems(spark):
    a, b = matrix.from_rows(spark, [[1.0, 1.0], [1.0, 1.0]]), spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    for f in (matrix.bicgstab, matrix.gmres):
        with pytest.raises(ArithmeticError):
            f(a, b, most=3)


def test_invariants(spark):
    m = [[2.0, 1.0], [1.0, 3.0]]
    got = matrix.invariants(matrix.from_rows(spark, m), 2).first()
    assert (got["determinant"], got["rank"]) == (pytest.approx(5), 2) and got["condition"] == pytest.approx(np.linalg.cond(m))
    flat = matrix.invariants(matrix.from_rows(spark, [[1.0, 2.0], [2.0, 4.0]]), 2).first()
    assert flat["rank"] == 1 and flat["determinant"] == pytest.approx(0, abs=1e-12)


def test_fft2_there_and_back(spark):
    m = np.arange(12.0).reshape(3, 4) ** 1.5
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(4)], "i long, j long, v double")
    there = matrix.fft2(cells)
    got = {(r["i"], r["j"]): complex(r["re"], r["im"]) for r in there.collect()}
    assert all(abs(got[i, j] - np.fft.fft2(m)[i, j]) < 1e-9 for i in range(3) for j in range(4))
    back = {(r["i"], r["j"]): r["re"] for r in matrix.fft2(there.select("i", "j", F.struct("re", "im").alias("v")), inverse=True).collect()}
    assert all(abs(back[i, j] - m[i, j]) < 1e-9 for i in range(3) for j in range(4))


def as_table(spark, x):
    index = ", ".join(f"i{d} long" for d in range(x.ndim))
    return spark.createDataFrame([(*[int(i) for i in at], float(v)) for at, v in np.ndenumerate(x)], f"{index}, v double")


def as_array(df, shape):
    out = np.full(shape, np.nan)
    for *at, v in df.collect():
        out[tuple(at)] = v
    return out


def test_arrays_as_tables(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    assert np.array_equal(as_array(ndarray.reshape(as_table(spark, x), [2, 3, 4], [6, -1]), (6, 4)), x.reshape(6, 4))
    assert np.array_equal(as_array(ndarray.permute(as_table(spark, x), [2, 0, 1]), (4, 2, 3)), x.transpose(2, 0, 1))
    assert np.array_equal(as_array(ndarray.reduce(as_table(spark, x), 3, [0, 2]), (3,)), x.sum(axis=(0, 2)))
    with pytest.raises(ValueError):
        ndarray.reshape(as_table(spark, x), [2, 3, 4], [5, 5])


@pytest.mark.parametrize("a, b", [((2, 3, 4), (4,)), ((2, 3, 4), (3, 1)), ((3, 1), (1, 4)), ((1, 3), (2, 3)), ((4,), (2, 1)), ((2, 1, 4), (3, 1)), ((2, 2), (2, 2))])
def test_broadcasting(spark, a, b):
    x, y = np.arange(float(np.prod(a))).reshape(a), 100 * np.arange(1, 1 + float(np.prod(b))).reshape(b)
    got, shape = ndarray.combine(as_table(spark, x), list(a), as_table(spark, y), list(b), lambda p, q: p - q)
    assert tuple(shape) == (x - y).shape and np.array_equal(as_array(got, shape), x - y)


def test_broadcasting_of_unfit_shapes(spark):
    with pytest.raises(ValueError, match="go together"):
        ndarray.combine(as_table(spark, np.ones(3)), [3], as_table(spark, np.ones(4)), [4], lambda p, q: p + q)


def test_effective_sizes_and_thinning(spark):
    rng = np.random.default_rng(3)
    walk, v = [], 0.0
    for e in rng.normal(size=2000):
        v = 0.9 * v + e
        walk.append(v)
    rows = [(0, i, True, [float(e), float(w)]) for i, (e, w) in enumerate(zip(rng.normal(size=2000), walk, strict=True))]
    df = spark.createDataFrame(rows, "chain int, sample int, accepted boolean, x array<double>")
    size = {r["dim"]: r["effective_size"] for r in bayes.effective_sizes(df).collect()}
    assert size[0] > 1200 and 40 < size[1] < 250
    assert bayes.thinned(df, 10).count() == 200


def test_array_json(spark):
    df = spark.createDataFrame([("k", '{"data": [1, 2, 3, 4, 5, 6], "shape": [2, 3]}')], "name string, json string")
    got = {tuple(r["index"]): r["value"] for r in files.from_array_json(df, "json").collect()}
    assert got == {(i, j): float(3 * i + j + 1) for i in range(2) for j in range(3)}
    with pytest.raises(Exception, match="does not fill"):
        files.from_array_json(df.withColumn("json", F.lit('{"data": [1], "shape": [2]}')), "json").collect()


def test_execute_sql(spark):
    files.execute_sql(spark, "CREATE OR REPLACE TEMPORARY VIEW made_here AS SELECT 7 AS x")
    assert spark.table("made_here").first()["x"] == 7


def test_normality_p_values(spark):
    rng = np.random.default_rng(4)
    for values, low, high in ((rng.normal(size=800), 0.05, 1.0), (rng.exponential(size=800), 0.0, 1e-6)):
        r = inference.shapiro_wilk(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()
        assert low <= r["p_value"] <= high and r["p_rough"] == pytest.approx((1 - r["w"]) ** 2)
    few = inference.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").first()
    assert few["p_value"] is None and few["n"] == 3
