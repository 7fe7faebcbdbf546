"""Endless series in blocks and parts, and tall factorisations, beside the plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import factor, frame, inference, series
from tessera.sources.scratch import arrow_batches


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(frame, "PART_ROWS", 60)
    monkeypatch.setattr(frame, "BLOCK_ROWS", 37)


def walk(spark, n=700, gaps=0.4, seed=1, keys=("a", "a", "a", "b", None)):
    rng = np.random.default_rng(seed)
    rows = [(int(t), keys[rng.integers(len(keys))], None if rng.random() < gaps or t < 25 or 300 < t < 450 else float(rng.normal())) for t in range(n)]
    return rows, spark.createDataFrame([rows[i] for i in rng.permutation(n)], "t long, k string, x double").repartition(6)


def collected(df, column):
    return {r["t"]: r[column] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9, nan_ok=True)), k


def test_windows_without_keys_equal_one_key(spark, small_parts):
    rows, df = walk(spark)
    one = df.withColumn("one", F.lit(1))
    for how, window in (("mean", 5), ("sum", 90), ("std", 3), ("min", 40)):
        same(collected(frame.rolling(df, "x", window, how, ["t"], [], "y"), "y"), collected(frame.rolling(one, "x", window, how, ["t"], ["one"], "y"), "y"))
    for periods in (1, 50, -3, -80):
        same(collected(frame.shift(df, "x", periods, ["t"], [], "y"), "y"), collected(frame.shift(one, "x", periods, ["t"], ["one"], "y"), "y"))
    same(collected(frame.difference(df, "x", 2, ["t"], [], "y"), "y"), collected(frame.difference(one, "x", 2, ["t"], ["one"], "y"), "y"))
    for how in ("sum", "prod"):
        same(collected(frame.cumulative(df, "x", how, ["t"], [], "y"), "y"), collected(frame.cumulative(one, "x", how, ["t"], ["one"], "y"), "y"))
    assert frame.rolling(df, "x", 5, "mean", ["t"], []).columns == frame.rolling(one, "x", 5, "mean", ["t"], ["one"]).drop("one").columns


def test_filling_without_keys_carries_over_empty_parts(spark, small_parts):
    rows, df = walk(spark)
    one = df.withColumn("one", F.lit(1))
    for forward in (True, False):
        for limit in (None, 1, 45):
            same(collected(frame.fill_direction(df, "x", ["t"], None, forward, limit), "x"), collected(frame.fill_direction(one, "x", ["t"], ["one"], forward, limit), "x"))
    assert frame.fill_direction(df.limit(0), "x", ["t"]).count() == 0


def test_unkeyed_plans_have_no_window_over_all_rows(spark, small_parts):
    _, df = walk(spark)
    for made in (frame.fill_direction(df, "x", ["t"]), frame.rolling(df, "x", 5, "mean", ["t"], []), frame.cumulative(df, "x", "sum", ["t"], [])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        unkeyed = [line for line in plan.splitlines() if "Window [" in line and "__part" in line and "[__part" in line.split("]", 1)[1][:12]]
        assert all("sum" in line or "last(" in line or "first(" in line for line in unkeyed)  # only over a row a part


def plain_average(x, alpha):
    out, s = [], math.nan
    for v in x:
        s = s if v is None else v if math.isnan(s) else alpha * v + (1 - alpha) * s
        out.append(s)
    return out


def plain_holt(x, alpha, beta):
    there = [i for i, v in enumerate(x) if v is not None]
    if len(there) < 2:
        return [math.nan] * len(x)
    level, trend = x[there[0]], (x[there[1]] - x[there[0]]) / (there[1] - there[0])
    out = [level] * len(x)
    for t in range(there[0] + 1, len(x)):
        if x[t] is not None:
            before, level = level, alpha * x[t] + (1 - alpha) * (level + trend)
            trend += beta * (level - before - trend)
        out[t] = level + trend
    return out


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scans_in_parts_equal_the_recursion(spark, small_parts, keys):
    rows, df = walk(spark, keys=("a", "a", "a", "b", None))
    rows.append((9_999, "lonely", 3.0))
    df = df.union(spark.createDataFrame([rows[-1]], df.schema))
    groups = {}
    for t, k, x in sorted(rows):
        groups.setdefault(k if keys else 0, []).append((t, x))
    for made, plain, column in ((series.exponential_average(df, "x", 0.3, ["t"], keys), lambda x: plain_average(x, 0.3), "ema"), (series.holt(df, "x", 0.4, 0.2, ["t"], keys), lambda x: plain_holt(x, 0.4, 0.2), "holt")):
        expected = {t: v for g in groups.values() for (t, _), v in zip(g, plain([x for _, x in g]), strict=True)}
        assert made.columns == ["t", "k", "x", column]
        same({t: math.nan if v is None else v for t, v in collected(made, column).items()}, expected)
    assert series.holt(df.limit(0), "x", 0.4, 0.2, ["t"], keys).count() == 0


def test_many_short_series_are_no_groups_of_their_own(spark, small_parts, monkeypatch):
    rng = np.random.default_rng(4)
    keys = [None, math.nan, *map(float, range(150))]
    rows = [(t, keys[rng.integers(len(keys))], None if rng.random() < 0.3 else float(rng.normal())) for t in range(1_500)]
    df = spark.createDataFrame(rows, "t long, k double, x double").repartition(6)
    groups = {}
    for t, k, x in rows:
        groups.setdefault(str(k), []).append((t, x))
    for f, plain, column in ((lambda: series.exponential_average(df, "x", 0.3, ["t"], ["k"]), lambda x: plain_average(x, 0.3), "ema"), (lambda: series.holt(df, "x", 0.4, 0.2, ["t"], ["k"]), lambda x: plain_holt(x, 0.4, 0.2), "holt")):
        expected = {t: v for g in groups.values() for (t, _), v in zip(g, plain([x for _, x in g]), strict=True)}
        with arrow_batches(spark, 7):  # so series reach over batches
            same({t: math.nan if v is None else v for t, v in collected(f(), column).items()}, expected)
        with monkeypatch.context() as m:
            m.setattr(frame, "PART_ROWS", 100_000)  # no bound cuts a series
            assert "FlatMapGroupsInPandas" not in f()._jdf.queryExecution().optimizedPlan().toString()
            same({t: math.nan if v is None else v for t, v in collected(f(), column).items()}, expected)


def tall(spark, n=3_000, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 4))
    a[:, 3] = a[:, 0] + 1e-9 * rng.normal(size=n)  # condition 1e9
    y = a @ np.array([1.0, -2.0, 0.5, 0.0]) + 3 + 1e-3 * rng.normal(size=n)
    return a, y, spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(a, y, strict=True)], "a double, b double, c double, d double, y double").repartition(40)


def test_tall_qr_at_condition_1e9(spark, monkeypatch):
    monkeypatch.setattr(factor, "FAN", 3)
    monkeypatch.setattr(factor, "ROWS", 50)
    a, y, df = tall(spark)
    assert factor.singular_values(df, ["a", "b", "c", "d"]) == pytest.approx(np.linalg.svd(a, compute_uv=False), rel=1e-6)
    r = factor.tall_qr(df, ["a", "b", "c"])
    assert r == pytest.approx(np.linalg.cholesky(a[:, :3].T @ a[:, :3]).T, rel=1e-9, abs=1e-9)
    fit = {x["term"]: x for x in factor.tall_regression(df, "y", ["a", "b", "c", "d"]).collect()}
    best = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), y, rcond=None)[0]
    # the sum of the two columns that nearly agree is well determined, and so are the rest
    assert fit["a"]["coefficient"] + fit["d"]["coefficient"] == pytest.approx(best[1] + best[4], abs=1e-4)
    assert [fit[c]["coefficient"] for c in ("intercept", "b", "c")] == pytest.approx(best[[0, 2, 3]], abs=1e-6)
    q = factor.orthonormal(df, ["a", "b", "c"]).select(*[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"s{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)]).first()
    assert np.array(q).reshape(3, 3) == pytest.approx(np.eye(3), abs=1e-9)


def test_tall_regression_equals_the_plain_one_and_names_dependence(spark):
    a, y, df = tall(spark)
    key = lambda d: {r["term"]: (r["coefficient"], r["std_error"], r["r2"]) for r in d.collect()}
    mine, plain = key(factor.tall_regression(df, "y", ["a", "b", "c"])), key(inference.linear_regression(df, "y", ["a", "b", "c"]))
    for term, values in plain.items():
        assert mine[term] == pytest.approx(values, rel=1e-6)
    with pytest.raises(ValueError):
        factor.tall_regression(df.withColumn("e", F.col("a") * 0), "y", ["a", "e"])
    with pytest.raises(ValueError):
        factor.tall_qr(df, [])


def test_components_there_and_back(spark):
    a, _, df = tall(spark)
    df = df.withColumn("b", F.when(F.rand(1) > 0.1, F.col("b")))
    whole = df.where("b is not null")
    model = factor.fit_components(df, ["a", "b", "c"])
    x = np.array([list(r) for r in whole.select("a", "b", "c").collect()])
    assert model.variance == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rel=1e-9)
    assert model.share.sum() == pytest.approx(1)
    back = factor.from_components(factor.to_components(whole, model), model)
    worst = back.select(*[F.max(F.abs(F.col(c) - F.col(f"{c}_back"))) for c in ("a", "b", "c")]).first()
    assert max(worst) < 1e-12
    first = factor.fit_components(df, ["a", "b", "c"], 1)
    lost = factor.from_components(factor.to_components(whole, first), first).agg(*[F.sum((F.col(c) - F.col(f"{c}_back")) ** 2) for c in ("a", "b", "c")]).first()
    assert sum(lost) / (len(x) - 1) == pytest.approx(model.variance[1:].sum(), rel=1e-9)


def test_by_blocks_copies_only_neighbours(spark, small_parts):
    _, df = walk(spark, 300)
    seen = frame.by_blocks(df, ["t"], 4, 2, lambda d, o, k: d.withColumn("n", F.count("*").over(Window.partitionBy(*k))))
    assert seen.count() == 300 and seen.agg(F.max("n")).first()[0] <= 37 + 6
