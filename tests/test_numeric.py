"""Starts of k-means, exact neighbours, draws of any shape, error-free sums, seasonal periods."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import exact, inference, montecarlo, neighbours, series
from tessera.sources import generate


def blobs(spark, n=1_500, k=7, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-50, 50, (k, 3))
    x = centres[rng.integers(0, k, n)] + rng.normal(0, 1, (n, 3))
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(4)


def test_kmeans_from_drawn_starts_is_close_to_the_best_of_ten(spark):
    x, df = blobs(spark)
    columns = ["a", "b", "c"]
    cost = lambda c: neighbours.within_cost(df, columns, c)
    best = math.inf
    for seed in range(10):
        rng = np.random.default_rng(seed)
        c = [x[rng.integers(len(x))]]
        while len(c) < 7:  # k-means++ and Lloyd in numpy
            d = ((x[:, None] - np.array(c)) ** 2).sum(2).min(1)
            c.append(x[rng.choice(len(x), p=d / d.sum())])
        c = np.array(c)
        for _ in range(30):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(7)])
        best = min(best, ((x[:, None] - c) ** 2).sum(2).min(1).sum())
    for start in ("parallel", "plusplus"):
        centres = inference.kmeans(df, columns, k=7, key="id", seed=1, start=start)[1]
        assert cost(centres) <= best * (1.05 if start == "parallel" else 3)
    first = neighbours.start_centres(df, columns, 7, "id", 1)
    assert first == neighbours.start_centres(df.repartition(3), columns, 7, "id", 1)
    assert cost(first) <= best * 2


def test_kmeans_reads_its_source_once_in_a_part_a_core_and_leaves_missing_rows_out(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = [(float(v),) for v in [*range(30), *range(60, 90)]] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(x, "a double").coalesce(1).mapInArrow(counted, "a double")
    centres = inference.kmeans(df, ["a"], [[0.0], [10.0]])[1]
    assert centres == [[14.5], [74.5]] and read.value == len(x)
    assert neighbours.spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nearest_centre_equals_all_distances(spark):
    x, df = blobs(spark, 300)
    rows = df.select("id", neighbours.vector(["a", "b", "c"]).alias("__x"))
    centres = np.vstack([x[:150], x[:20]])  # more than a block, and equal ones
    got = {r["id"]: r for r in neighbours.nearest_centre(rows, centres.tolist(), "id").collect()}
    d = ((x[:, None] - centres) ** 2).sum(2)
    assert [got[i]["__i"] for i in range(300)] == d.argmin(1).tolist()
    assert [got[i]["__d"] for i in range(300)] == pytest.approx(d.min(1).tolist())


def test_starts_of_few_equal_and_missing_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, float("nan"))], "id long, a double")
    for method in ("parallel", "plusplus", "random"):
        assert sorted(neighbours.start_centres(df, ["a"], 5, "id", method=method)) == [[1.0], [2.0]]
        assert neighbours.start_centres(df.limit(0), ["a"], 5, "id", method=method) == []
    with pytest.raises(ValueError):
        neighbours.start_centres(df, ["a"], 0, "id")
    with pytest.raises(ValueError):
        inference.kmeans(df, ["a"])


@pytest.mark.parametrize(("metric", "seed"), [("euclidean", 1), ("manhattan", 2), ("euclidean", 3)])
def test_nearest_rows_equal_all_pairs(spark, metric, seed):
    rng = np.random.default_rng(seed)
    n = 700
    x = np.round(rng.normal(0, 3, (n, 2)) * (rng.random((n, 1)) < 0.7), 1 if seed == 3 else 6)  # a third of the rows are one point
    keys = rng.permutation(n)
    df = spark.createDataFrame([(int(k), float(a), float(b) if i % 50 else None) for i, (k, (a, b)) in enumerate(zip(keys, x, strict=True))], "k long, a double, b double").repartition(5)
    asked, donors = df.where("k % 5 = 0"), df.where("k % 5 <> 0")
    got = {}
    for r in neighbours.nearest_rows(asked, donors, ["a", "b"], "k", 4, metric).collect():
        got.setdefault(r["__k"], []).append((r["__r"], r["__dk"]))
    full = {int(k): p for i, (k, p) in enumerate(zip(keys, x, strict=True)) if i % 50}
    for k, p in full.items():
        if k % 5 == 0:
            d = lambda o: np.abs(full[o] - p).sum() if metric == "manhattan" else ((full[o] - p) ** 2).sum()  # noqa: B023, E731
            best = sorted((float(d(o)), o) for o in full if o % 5)[:4]
            assert [o for _, o in sorted(got[k])] == [o for _, o in best]
    assert set(got) == {k for k in full if k % 5 == 0}


def test_knn_imputation_has_no_nested_loop_and_stands_repeated_keys(spark):
    df = spark.createDataFrame([("x", 0.0, 1.0), ("x", 10.0, 5.0), ("y", 1.0, None), ("y", 9.0, None), ("z", None, None), ("x", 0.0, 3.0)], "k string, f double, v double")
    made = inference.impute_knn(df, "v", ["f"], "k", 1)
    assert sorted((-1 if r["f"] is None else r["f"], r["v"]) for r in made.collect()) == [(-1, None), (0.0, 1.0), (0.0, 3.0), (1.0, 1.0), (9.0, 5.0), (10.0, 5.0)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    weighted = {r["f"]: r["v"] for r in inference.impute_knn(df, "v", ["f"], "k", 3, weighted=True).where("k = 'y'").collect()}
    assert weighted[1.0] == pytest.approx((1 / 1 + 3 / 1 + 5 / 9) / (1 + 1 + 1 / 9))
    assert inference.impute_knn(df.where("v is null"), "v", ["f"], "k").where("v is not null").count() == 0


@pytest.mark.parametrize(("shape", "scale"), [(0.3, 1.0), (2.7, 3.0), (40.5, 0.5)])
def test_gamma_moments(spark, shape, scale):
    r = generate.sample(spark, "gamma", 40_000, 3, shape, scale).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.min("value").alias("low"), F.skewness("value").alias("s")).first()
    assert r["m"] == pytest.approx(shape * scale, rel=0.03)
    assert r["v"] == pytest.approx(shape * scale**2, rel=0.08)
    assert r["s"] == pytest.approx(2 / math.sqrt(shape), rel=0.2)
    assert r["low"] > 0


def test_beta_moments_and_shapes_that_are_no_shapes(spark):
    r = generate.sample(spark, "beta", 40_000, 4, 0.5, 1.5).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.max("value").alias("high")).first()
    assert r["m"] == pytest.approx(0.25, rel=0.03) and r["v"] == pytest.approx(0.0625, rel=0.05) and r["high"] < 1
    for kind, a, b in (("gamma", 0.0, 1.0), ("beta", -1.0, 1.0), ("binomial", 2.5, 0.5)):
        with pytest.raises(ValueError):
            generate.sample(spark, kind, 5, 0, a, b)
    odd = spark.createDataFrame([(1, 0.0), (2, -3.0), (3, None), (4, 1.0)], "k long, a double").select("k", generate.draw_gamma(F.col("a"), F.col("k")).alias("g"))
    assert [r["g"] is None for r in odd.orderBy("k").collect()] == [True, True, True, False]


def number_lists():
    rng = random.Random(5)
    yield [1e300, 1.0, -1e300]
    yield [0.1] * 10
    yield [5e-324, 1.5, -1.5, 2.2250738585072014e-308, -0.0, 0.0]
    yield [1.7976931348623157e308, 1.0, -1.7976931348623157e308, 2.0**-1040]
    yield [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-30, 30) for _ in range(500)]
    yield [2.0**e for e in range(-60, 60)] + [math.nextafter(2.0**e, 0) for e in range(-60, 60)]


def test_sums_equal_fsum(spark):
    rows = [(i, x) for i, values in enumerate(number_lists()) for x in values] + [(0, None), (1, float("nan")), (99, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    got = {r["g"]: (r["s"], r["m"]) for r in exact.exact_aggregates(df, {"s": ("sum", "x"), "m": ("mean", "x")}, ["g"]).collect()}
    for i, values in enumerate(number_lists()):
        assert got[i] == (math.fsum(values), float(sum(map(Fraction, values)) / len(values)))
    assert 99 not in got


def test_products_and_variances_are_rounded_once(spark):
    rng = random.Random(6)
    pairs = [(1e8 + rng.random(), rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8)) for _ in range(400)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (2.0, None)], "x double, y double").where("x is null or y is not null").repartition(3)
    wanted = {"v": ("var", "x"), "p": ("var_pop", "x"), "s": ("std", "x"), "d": ("dot", "x", "y"), "n": ("norm", "y")}
    got = exact.exact_aggregates(df.where("x is not null"), wanted).first()
    x, y = ([Fraction(p[i]) for p in pairs] for i in (0, 1))
    spread = sum(a * a for a in x) - sum(x) ** 2 / len(x)
    assert got["v"] == float(spread / (len(x) - 1)) and got["p"] == float(spread / len(x))
    assert got["s"] == pytest.approx(math.sqrt(spread / (len(x) - 1)), rel=1e-15)
    assert got["d"] == float(sum(a * b for a, b in zip(x, y, strict=True)))
    assert got["n"] == pytest.approx(math.sqrt(sum(b * b for b in y)), rel=1e-15)


def test_exact_sums_work_every_exponent_out_once(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "g int, x double, y double")
    plan = exact.exact_aggregates(df, {"v": ("var", "x"), "d": ("dot", "x", "y"), "n": ("norm", "y")}, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2(") == plan.count("POWER(") == 1


def test_exact_sums_of_nothing_and_of_infinities(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, 2.0), (2, float("inf")), (2, float("-inf")), (3, float("-inf"))], "g int, x double")
    got = {r["g"]: r["s"] for r in exact.exact_aggregates(df, {"s": ("sum", "x")}, ["g"]).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[3] == -math.inf
    assert exact.exact_aggregates(df.limit(0), {"s": ("sum", "x"), "v": ("var", "x")}).collect()[0].asDict() == {"s": None, "v": None}


def test_two_planted_periods_are_found(spark):
    rng = np.random.default_rng(1)
    t = np.arange(400)
    x = 3 * np.sin(2 * np.pi * t / 7) + 2.5 * np.sin(2 * np.pi * t / 31) + rng.normal(0, 0.3, len(t))
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, x, strict=True)] + [(None, int(i), float(v)) for i, v in zip(t, rng.normal(0, 1, len(t)), strict=True)] + [("few", i, 1.0) for i in range(4)], "k string, t long, x double")
    found = {(r["k"], r["place"]): r["period"] for r in series.spectral_periods(df, "x", ["t"], ["k"]).collect()}
    assert found["a", 1] == 7 and found["a", 2] == 31
    lags = series.seasonal_periods(df, "x", ["t"], ["k"], most=2).collect()
    assert {r["k"] for r in lags} == {"a", None}
    d = x - x.mean()
    acf = {k: abs((d[k:] * d[:-k]).sum() / (d * d).sum()) for k in range(2, 51)}
    taken = []
    for p in sorted(acf, key=lambda k: (-acf[k], k)):
        if acf[p] >= 0.3 and len(taken) < 2 and not any(abs(p - k * q) <= 1 or abs(q - k * p) <= 1 for q in taken for k in range(1, 7)):
            taken.append(p)
    assert [r["period"] for r in sorted(lags, key=lambda r: r["place"]) if r["k"] == "a"] == taken
    whole = series.spectral_periods(df.where("k = 'a'").drop("k"), "x", ["t"], [])
    assert [r["period"] for r in whole.orderBy("place").collect()][:2] == [7, 31]


def test_trend_keeps_rows_of_null_keys(spark):
    df = spark.createDataFrame([(None, i, 2.0 * i) for i in range(5)] + [("a", i, 1.0) for i in range(3)], "k string, t int, x double")
    got = series.linear_trend(df, "x", ["t"], ["k"]).collect()
    assert len(got) == 8 and all(abs(r["detrended"]) < 1e-9 for r in got)


@pytest.mark.parametrize(("method", "worst"), [("plain", 0.05), ("antithetic", 0.03), ("halton", 0.005)])
def test_integrals_and_their_errors(spark, method, worst):
    boxes = spark.createDataFrame([("unit", 0.0, 1.0, 0.0, 1.0), ("wide", -1.0, 2.0, 1.0, 3.0), ("empty", 1.0, 1.0, 0.0, 1.0), ("open", None, 1.0, 0.0, 1.0), ("endless", 0.0, float("inf"), 0.0, 1.0)], "k string, a double, b double, c double, d double")
    found = montecarlo.integrate(boxes, "k", [("a", "b"), ("c", "d")], lambda x, y: x * x + y, 16_000, method, sizes=[1_600], seed=3)
    got = {(r["k"], r["samples"]): r for r in found.collect()}
    assert len(got) == 10
    for k, true in (("unit", 1 / 3 + 1 / 2), ("wide", 18.0)):
        r = got[k, 16_000]
        assert r["value"] == pytest.approx(true, rel=worst) and abs(r["value"] - true) < 6 * r["std_error"]
        assert r["std_error"] < got[k, 1_600]["std_error"] and r["low"] < r["value"] < r["high"]
    assert all(got[k, 16_000]["value"] is None for k in ("empty", "open", "endless"))
    assert {r["k"]: r["converged"] for r in montecarlo.converged(found, "k", 0.2).collect()} == {"unit": True, "wide": True, "empty": False, "open": False, "endless": False}


def test_many_points_of_one_box_are_dealt_out_and_odd_values_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(montecarlo, "CHUNK", 100)
    box = spark.createDataFrame([(1, 0.0, 1.0)], "k int, a double, b double")
    half = lambda x: F.when(x < 0.5, F.lit(2.0)).when(x < 0.75, F.lit(float("nan")))
    r = montecarlo.integrate(box, "k", [("a", "b")], half, 1_024, "halton", repeats=1).first()
    assert r["value"] == 2.0 and r["std_error"] is None
    with pytest.raises(ValueError):
        montecarlo.integrate(box, "k", [("a", "b")], half, method="importance")
