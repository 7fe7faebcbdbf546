import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, strings
from tessera.operators import describe, frame, inference, matrix, series
from tessera.sources import excel, files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grouping_rejects_text_and_no_keys(spark):
    df = spark.createDataFrame([("A", "hello"), ("B", "world")], "k string, v string")
    with pytest.raises(TypeError):
        frame.group_aggregate(df, ["k"], "sum")
    with pytest.raises(ValueError):
        frame.group_aggregate(df, [], "count")


def test_group_fixture(spark):
    df = spark.createDataFrame([("A", 10.0, 1), ("B", 20.0, 2), ("A", 30.0, 3), ("B", 40.0, 4), ("A", 50.0, 5)], "category string, value double, quantity long")
    assert rows(frame.group_aggregate(df, ["category"], "sum")) == [("A", 90.0, 9), ("B", 60.0, 6)]


def test_outer_join_keeps_left_key_null(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "id long, pay double")
    assert rows(frame.join(a, b, ["id"], how="full")) == [(1, "x", None), (2, "y", 5.0), (None, None, 6.0)]
    with pytest.raises(KeyError):
        frame.join(a, b, ["nope"])


def test_pivot_fixture(spark):
    df = spark.createDataFrame([(r, p, v) for r, p, v in zip("NSNSNS", "AABBAB", [100.0, 150.0, 200.0, 250.0, 120.0, 300.0], strict=True)], "region string, product string, sales double")
    assert rows(frame.pivot_table(df, "region", "product", "sales")) == [("N", 220.0, 200.0), ("S", 150.0, 550.0)]


def test_positions_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = frame.with_position(df, ["k"]).collect()
    assert all(r["k"] == r["__pos"] for r in got) and len(got) == 1000


def test_interpolate_edges(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k int, t int, v double")
    assert [r["v"] for r in frame.interpolate(df, "v", ["t"], ["k"]).orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_strings(spark):
    df = spark.createDataFrame([("hello wOrld",), ("é",), ("",), (None,)], "s string")
    s = F.col("s")
    got = df.select(strings.title(s), strings.slice_(s, -3, -1), strings.center(s, 4, "*"), strings.count(s, ""), strings.isalpha(s), strings.replace(s, "l", "L", 1)).collect()
    assert tuple(got[0]) == ("Hello WOrld", "rl", "hello wOrld", 12, False, "heLlo wOrld")
    assert tuple(got[1]) == ("É", "", "*é**", 2, True, "é")
    assert tuple(got[3]) == (None, None, None, 0, False, None)


def test_distributions():
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, rel=1e-8)
    assert distributions.f_upper(3.0, 2, 20) == pytest.approx(0.0725381503, rel=1e-8)
    assert distributions.chi2_upper(5.0, 3) == pytest.approx(0.1717971443, rel=1e-8)


def test_kmeans_blobs(spark):
    points = [(x + dx, y + dy) for x, y in ((1, 1), (5, 5), (1, 5)) for dx in (0.0, 0.2) for dy in (0.0, 0.2)]
    got, centres = inference.kmeans(spark.createDataFrame(points, "a double, b double"), ["a", "b"], [[0.0, 0.0], [6.0, 6.0], [0.0, 6.0]])
    assert np.allclose(centres, [[1.1, 1.1], [5.1, 5.1], [1.1, 5.1]]) and got.groupBy("cluster").count().count() == 3


def test_pca_matches_svd(spark):
    x = np.random.default_rng(0).normal(size=(60, 3)) @ np.diag([3.0, 1.0, 0.2])
    _, comp, var = inference.pca(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"], 2)
    s = np.linalg.svd(x - x.mean(0))
    assert np.allclose(var, s[1][:2] ** 2 / 59) and np.allclose(np.abs(comp), np.abs(s[2][:2]))


def test_solvers(spark):
    a = matrix.from_rows(spark, [[4.0, 1.0], [1.0, 3.0]])
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    for x in (matrix.conjugate_gradient(a, b), matrix.solve(a, b, 2)):
        assert [round(r["v"], 6) for r in x.orderBy("i").collect()] == [round(1 / 11, 6), round(7 / 11, 6)]
    f = matrix.factorise(a, 2, "lu")
    product = matrix.matmul(f["l"], f["u"])
    assert np.allclose(matrix.small(product, 2, 2), matrix.small(matrix.matmul(f["p"], a), 2, 2))


def test_seasonal_decomposition(spark):
    values = [(1, i, i + 1.0 + [2, -1, -1, 2][i % 4]) for i in range(12)]
    got = series.decompose(spark.createDataFrame(values, "k int, t int, v double"), "v", 4, ["t"], ["k"]).orderBy("t").collect()
    assert got[0]["trend"] is None and [round(r["seasonal"], 6) for r in got[:4]] == [1.5, -1.5, -1.5, 1.5]


def test_csv_and_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Alice", 25, 95.5), ("Bob", None, 87.2)], "name string, age long, score double")
    files.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), schema=df.schema)) == rows(df)
    excel.write_xlsx(str(tmp_path / "b.xlsx"), {"people": df, "more": df.limit(1)})
    assert excel.sheet_names(str(tmp_path / "b.xlsx")) == ["people", "more"]
    spark.dataSource.register(excel.XlsxSource)
    back = spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("sheet", "people").load()
    assert rows(back) == [("Alice", "25", "95.5"), ("Bob", None, "87.2")]
    with pytest.raises(ValueError):
        files.checked("a; drop table b")


def test_stream_windows(spark, tmp_path):
    from tessera.streaming import streams

    src = "/root/testdata/sf0.001/events.parquet"
    static = spark.read.parquet(src)
    static.write.parquet(str(tmp_path / "in"))
    live = streams.windowed(streams.read_stream(spark, str(tmp_path / "in"), static.schema), "ts", "1 day", {"n": F.count("*")}, ["event_type"])
    q = streams.write_stream(live, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.agg(F.sum("n")).first()[0] <= 1000


def test_bayes_and_polynomials(spark):
    from tessera.operators import bayes

    df = spark.createDataFrame([(float(i), 2.0 + 3.0 * i + (i % 3 - 1) * 0.1) for i in range(60)], "x double, y double")
    got = {r["term"]: r for r in bayes.bayesian_linear(df, "y", ["x"]).collect()}
    assert got["x"]["low"] < 3.0 < got["x"]["high"] and abs(got["intercept"]["mean"] - 2) < 0.1
    fit = {r["power"]: r["coefficient"] for r in bayes.polynomial_fit(df.withColumn("z", 1 + F.col("x") ** 2), "x", "z", 2).collect()}
    assert fit[2] == pytest.approx(1, abs=1e-6) and fit[1] == pytest.approx(0, abs=1e-4)
    assert sorted(r.real for r in bayes.polynomial_roots([2, -3, 1])) == pytest.approx([1, 2])
    draws = bayes.metropolis(spark, lambda x: -0.5 * float((x - 1) @ (x - 1)), [0.0, 0.0], [1.0, 1.0], 1500)
    assert all(abs(r["mean"] - 1) < 0.25 and r["r_hat"] < 1.1 for r in bayes.gelman_rubin(draws).collect())


def test_positions_of_a_million_wide_rows(spark):
    n = 1_000_000
    k = (F.col("id") * 7_919 % n).cast("long")
    df = spark.range(n).select(k.alias("k"), F.concat(F.lit("text "), "id").alias("a"), (F.col("id") / 3).alias("b"), F.col("id").cast("string").alias("c"))
    got = frame.with_position(df, ["k"])
    assert got.columns == ["k", "a", "b", "c", "__pos"]
    assert tuple(got.agg(F.count("*"), F.countDistinct("__pos"), F.sum((F.col("__pos") != F.col("k")).cast("int"))).first()) == (n, n, 0)
    parts = frame.split_rows(df, 4, ["k"]).groupBy("section").count().collect()
    assert sorted(tuple(r) for r in parts) == [(i, n // 4) for i in range(4)]


def test_positions_of_nulls_and_mixed_types(spark, monkeypatch):
    monkeypatch.setattr(frame, "PART_ROWS", 50)
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 13), None if i % 5 == 0 else f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, x double, s string").withColumn("t", F.timestamp_seconds("i").cast("timestamp_ntz")).withColumn("d", F.col("i").cast("decimal(12,2)"))
    for order in (["x", "s", "i"], ["s", "t"], ["d"], ["t"]):
        got = [r["i"] for r in frame.with_position(df, order).orderBy("__pos").collect()]
        assert got == [r["i"] for r in df.orderBy(*order).collect()]
    assert frame.with_position(df.limit(0), ["x"]).count() == 0


def test_quantiles_by_key(spark, monkeypatch):
    monkeypatch.setattr(frame, "PART_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = [(None if k == 2 else f"k{k}", float(v)) for k, n in enumerate((1, 2, 300, 77)) for v in rng.integers(0, 40, n)] + [("k0", None), ("k9", None), ("k3", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in describe.quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.9}, ["k"]).collect()}
    for key in ("k0", "k1", None, "k3"):
        v = [x for k, x in rows if k == key and x is not None and x == x]
        assert np.allclose(got[key], np.quantile(v, [0.0, 0.37, 0.9]))
    assert len(got) == 4
    assert describe.modes(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,), (None,)], "v double"), "v").first()["mode"] == 1.0
    assert describe.quantiles(df.where("v is null"), "v", {"a": 0.5}).collect() == [] or describe.quantiles(df.where("v is null"), "v", {"a": 0.5}).first()["a"] is None


def test_holt_keeps_level_and_trend_over_gaps(spark):
    nan = float("nan")
    x = np.array([nan, 10.0, nan, 14.0, nan, 20.0])

    def holt(values, alpha, beta):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t int, x double")
        return np.array([r["holt"] for r in series.holt(df, "x", alpha, beta, ["t"], []).orderBy("t").collect()], dtype=float)

    # Starts at 10 with a trend of 2 a step; a gap changes neither.
    assert np.allclose(holt(x, 0.5, 0.0), [10.0, 10.0, 12.0, 15.0, 15.0, 18.5 + 1.0])
    got = series._holt_winters(np.array([1.0, 3.0, 1.0, nan, 2.0, 3.0]), 0.5, 0.1, 0.2, 2, False)
    assert np.isfinite(got).all() and got[0] == got[1] == 2.0 and np.isnan(holt(x[:2], 0.5, 0.1)).all()


def test_regression_with_large_means(spark):
    rows = [(1.7e12 + i, 3.0 * i + (i % 5)) for i in range(500)]
    got = {r["term"]: r["coefficient"] for r in inference.linear_regression(spark.createDataFrame(rows, "x double, y double"), "y", ["x"]).collect()}
    slope = np.polyfit(np.arange(500), [y for _, y in rows], 1)[0]
    assert abs(got["x"] - slope) < 1e-9


def test_lda_predicts(spark):
    rng = np.random.default_rng(5)
    rows = [(c, float(x), float(y)) for c, (a, b) in {"p": (0, 0), "q": (8, 1), "r": (1, 9)}.items() for x, y in rng.normal((a, b), 1, (60, 2))]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    got = inference.lda_predict(df, inference.lda(df, ["x", "y"], "c")).collect()
    assert np.mean([r["c"] == r["predicted"] for r in got]) > 0.98
    assert all(abs(sum(r["predicted_proba"].values()) - 1) < 1e-9 and max(r["predicted_proba"], key=r["predicted_proba"].get) == r["predicted"] for r in got)


def test_repeated_labels_have_a_defined_value(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double")
    b = spark.createDataFrame([(1, 5.0, 2), (1, 9.0, 1), (3, 7.0, 1)], "k int, value double, t int")
    assert rows(frame.align(a, b, "k")) == [(1, 1.0, 9.0), (2, 2.0, None), (3, None, 7.0)]
    assert rows(frame.align(a, b, "k", order=["t"])) == [(1, 1.0, 5.0), (2, 2.0, None), (3, None, 7.0)]


def test_arg_extremes_skip_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 1.0), (4, 3.0), (5, None), (6, 1.0)], "i int, v double")
    assert tuple(describe.arg_extremes(df, "v", "i").first()) == (3, 2)


def test_bootstrap_of_equal_rows_needs_a_key(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("v"))
    spread = lambda key: inference.bootstrap_means(df.select("v") if key is None else df, "v", 50, key=key).agg(F.stddev("mean")).first()[0]
    assert 0.015 < spread(["id"]) < 0.04 < spread(None)
