"""Statistical tests, regression, scaling, metrics, outliers, clustering: aggregates first, small algebra on the driver.

Tests return one row with their statistic and degrees of freedom; add a p-value
with ``functions.distributions``. Models collect only sums of products, whose
size depends on the number of features, never on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distributions import normal_quantile, normal_tail
from tessera.functions.math import missing, valid
from tessera.operators.describe import correlation, median_absolute_deviation, modes, quantiles, ranked
from tessera.operators.frame import running_before
from tessera.operators.neighbours import nearest_rows, spread, start_centres, vector
from tessera.sources.generate import draw_uniform
from tessera.sources.scratch import forget, written

#: Strata whose starts are broadcast, and folds that are fitted one after another, at most.
STRATA_BROADCAST, MOST_FOLDS = 100_000, 100


def one_sample_t(df: DataFrame, column: str, mean: float) -> DataFrame:
    v = valid(F.col(column))
    return df.agg(((F.avg(v) - mean) / (F.stddev_samp(v) / F.sqrt(F.count(v)))).alias("t"), (F.count(v) - 1).cast("double").alias("df"))


def two_sample_t(df: DataFrame, column: str, first: Column) -> DataFrame:
    """Welch's test of the rows where ``first`` holds against the others."""
    a, b = F.when(first, valid(F.col(column))), F.when(~first, valid(F.col(column)))
    moments = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) / F.count(a)).alias("va"), (F.var_samp(b) / F.count(b)).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    va, vb = F.col("va"), F.col("vb")
    return moments.select(((F.col("ma") - F.col("mb")) / F.sqrt(va + vb)).alias("t"), ((va + vb) * (va + vb) / (va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))).alias("df"))


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    return one_sample_t(df.select((F.col(x) - F.col(y)).alias("d")), "d", 0.0)


def chi_square(df: DataFrame, observed: str, expected: str) -> DataFrame:
    o, e = F.col(observed), F.col(expected)
    return df.agg(F.sum((o - e) * (o - e) / e).alias("chi2"), (F.count("*") - 1).cast("double").alias("df"))


def anova_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """ss_between, ss_within, df1, df2, f."""
    v = valid(F.col(value))
    groups = df.where(v.isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    total = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    parts = groups.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("ss_between"), F.sum(F.col("n") * F.col("v")).alias("ss_within"), (F.count("*") - 1).cast("double").alias("df1"), (F.sum("n") - F.count("*")).cast("double").alias("df2"))  # one row
    return parts.withColumn("f", (F.col("ss_between") / F.col("df1")) / (F.col("ss_within") / F.col("df2")))


def anova_twoway(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """(source, ss, df, f) of a balanced design: both factors, their interaction, the error."""
    v = F.col(value).cast("double")
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    rolled = cells.groupBy().agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("cell"), F.count("*").alias("k"))
    by = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias(f"ss_{c}"), F.count("*").alias(f"k_{c}"))
    r = rolled.crossJoin(by(a)).crossJoin(by(b))  # one row each
    base = F.col("s") ** 2 / F.col("n")
    ssa, ssb = F.col(f"ss_{a}") - base, F.col(f"ss_{b}") - base
    inter, err = F.col("cell") - base - ssa - ssb, F.col("q") - F.col("cell")
    dfa, dfb, dfe = F.col(f"k_{a}") - 1, F.col(f"k_{b}") - 1, F.col("n") - F.col("k")
    row = lambda name, ss, d: F.struct(F.lit(name).alias("source"), ss.alias("ss"), d.cast("double").alias("df"), ((ss / d) / (err / dfe)).alias("f"))
    return r.select(F.inline(F.array(row(a, ssa, dfa), row(b, ssb, dfb), row("interaction", inter, (F.col(f"k_{a}") - 1) * (F.col(f"k_{b}") - 1)), row("error", err, dfe))))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H on averaged ranks without tie correction."""
    r = ranked(df.where(~missing(F.col(value))), value, "__r")
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("__r").alias("s"))
    n = F.sum("n")
    return g.agg((12 / (n * (n + 1)) * F.sum(F.col("s") ** 2 / F.col("n")) - 3 * (n + 1)).alias("h"), (F.count("*") - 1).cast("double").alias("df"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Chi-square of ranks within blocks (long form), ties averaged."""
    w = Window.partitionBy(block)
    o = w.orderBy(value)
    low = F.rank().over(o)
    same = F.count("*").over(Window.partitionBy(block, value))
    r = df.withColumn("__r", low + (same - 1) / 2)
    t = r.groupBy(treatment).agg(F.sum("__r").alias("s"), F.count("*").alias("n"))
    k, n = F.count("*"), F.max("n")
    return t.agg((12 / (n * k * (k + 1)) * F.sum(F.col("s") ** 2) - 3 * n * (k + 1)).alias("chi2"), (k - 1).cast("double").alias("df"))


def repeated_measures_anova(df: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """One row (f, df1, df2, ss_time, ss_subjects, ss_error): long form with one value of each subject at each time.

    Rows with a missing key or value do not count; a subject without all times makes the design unbalanced and is left to the caller to remove.
    """
    rows = df.where(F.col(subject).isNotNull() & F.col(time).isNotNull() & ~missing(F.col(value))).select(F.col(subject).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    whole = rows.agg(F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("total"))
    spread = lambda key: rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("a")).agg((F.var_pop("a") * F.sum("n")).alias(f"ss_{key}"), F.count("*").alias(f"k_{key}"))
    r = whole.crossJoin(spread("s")).crossJoin(spread("t"))  # one row each
    d1, d2 = F.col("k_t") - 1, (F.col("k_s") - 1) * (F.col("k_t") - 1)
    error = F.col("total") - F.col("ss_s") - F.col("ss_t")
    return r.select(((F.col("ss_t") / d1) / F.nullif(error / d2, F.lit(0.0))).alias("f"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"), F.col("ss_t").alias("ss_time"), F.col("ss_s").alias("ss_subjects"), error.alias("ss_error"))


def manova(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """One row (wilks, pillai, f, df1, df2): several columns against one grouping, with Rao's F for Wilks' lambda.

    One grouped aggregation; sums of products are added up by Spark, so the number of groups does not matter.
    """
    df, p = _complete(df, columns).where(F.col(group).isNotNull()), len(columns)
    t, means = _moments(df, columns)
    x = [F.col(c).cast("double") - float(m) for c, m in zip(columns, means, strict=True)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per = df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(x)])
    row = per.agg(F.count("*").alias("k"), *[F.sum(F.col("n") * F.col(f"a{i}") * F.col(f"a{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
    h = np.zeros((p, p))
    for i, j in pairs:
        h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
    n, total = t[0, 0], t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:]) / max(t[0, 0], 1.0)
    wilks = float(np.linalg.det(total - h) / np.linalg.det(total))
    q = row["k"] - 1
    power = np.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, d2 = p * q, power * (n - 1 - (p + q + 1) / 2) - (p * q - 2) / 2
    root = wilks ** (1 / power)
    return df.sparkSession.createDataFrame([(wilks, float(np.trace(h @ np.linalg.pinv(total))), float((1 - root) / root * d2 / d1), float(d1), float(d2))], "wilks double, pillai double, f double, df1 double, df2 double")


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """One row (w, n, p_value, p_rough): squared correlation of the sorted values with normal scores at (i - 3/8) / (n + 1/4); near 1 for normal data, null for constant or empty columns.

    Order statistics come from positions over fixed bounds, so any number of rows
    will do. p_value is Royston's normal approximation of ln(1 - w) for this
    correlation (Shapiro-Francia's), made for 5 to 5,000 values and null outside;
    p_rough is (1 - w)^2, defined for any number.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where(~missing(F.col("v")))
    n = rows.count()
    scored = running_before(rows, ["v"], {"i": F.lit(1).cast("long")}).withColumn("z", normal_quantile((F.col("i") + 0.625) / (n + 0.25)))
    found = scored.agg(F.pow(correlation(F.col("v"), F.col("z")), F.lit(2.0)).alias("w"), F.count("*").alias("n"))
    p = F.lit(None).cast("double")
    if 5 <= n <= 5_000:
        size = math.log(n)
        mean, sd = -1.2725 + 1.0521 * (math.log(size) - size), 1.0308 - 0.26758 * (math.log(size) + 2 / size)
        p = F.when(F.col("w") < 1, normal_tail((F.log(1 - F.col("w")) - mean) / sd)).when(F.col("w") >= 1, 1.0)
    return found.select("w", "n", p.alias("p_value"), F.pow(1 - F.least("w", F.lit(1.0)), F.lit(2)).alias("p_rough"))


# Regression.


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(~missing(F.col(c)))
    return df


def _moments(df: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of (weighted) sums of products of 1 and the columns less their means, and these means.

    Means are taken first, so large ones (timestamps, ids) cost no digits.
    """
    df = _complete(df, columns)
    means = np.array([x or 0.0 for x in df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()])
    w = F.lit(1.0) if weight is None else weight
    cols = [F.lit(1.0), *[F.col(c).cast("double") - float(m) for c, m in zip(columns, means, strict=True)]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.coalesce(F.sum(w * cols[i] * cols[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"m{i}_{j}"]
    return m, means


def linear_regression(df: DataFrame, y: str, xs: list[str], ridge: float = 0.0, weight: Column | None = None) -> DataFrame:
    """(term, coefficient, std_error, t, r2): least squares with an intercept, L2 on the slopes if ``ridge``."""
    m, means = _moments(df, [*xs, y], weight)
    a, b, yy, n = m[:-1, :-1].copy(), m[:-1, -1], m[-1, -1], m[0, 0]
    penalised = a + np.diag([0.0, *[ridge] * len(xs)])
    beta = np.linalg.solve(penalised, b)
    rss = yy - 2 * beta @ b + beta @ a @ beta
    tss = yy - m[0, -1] ** 2 / n
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    # Back from columns less their means: only the intercept changes.
    back = np.eye(len(beta))
    back[0, 1:] = -means[:-1]
    cov = back @ np.linalg.inv(penalised) @ back.T * rss / max(1.0, n - len(xs) - 1)
    beta = back @ beta
    beta[0] += means[-1]
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rows = [(t, float(c), float(s), float(c / s) if s > 0 else None, float(r2)) for t, c, s in zip(["intercept", *xs], beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, r2 double")


def predict(df: DataFrame, coefficients: DataFrame, name: str = "prediction") -> DataFrame:
    """Adds the linear prediction of a coefficient table (as many rows as features)."""
    out = F.lit(0.0)
    for r in coefficients.collect():
        out = out + (F.lit(r["coefficient"]) if r["term"] == "intercept" else F.lit(r["coefficient"]) * F.col(r["term"]))
    return df.withColumn(name, out)


def robust_regression(df: DataFrame, y: str, xs: list[str], kind: str = "huber", tuning: float | None = None, rounds: int = 20) -> DataFrame:
    """Huber (1.345) or Tukey bisquare (4.685) by iteratively reweighted least squares; each round is one aggregation."""
    k = tuning or {"huber": 1.345, "tukey": 4.685}[kind]
    fit, last = linear_regression(df, y, xs), None
    for _ in range(rounds):
        res = predict(df, fit, "__p").withColumn("__r", F.abs(F.col(y) - F.col("__p")))
        scale = max(quantiles(res, "__r", {"s": 0.5}).first()["s"] / 0.6745, 1e-12)
        u = F.col("__r") / (k * scale)
        w = F.when(u <= 1, 1.0).otherwise(1 / u) if kind == "huber" else F.when(u < 1, (1 - u * u) ** 2).otherwise(0.0)
        fit = linear_regression(res, y, xs, weight=w)
        now = [r["coefficient"] for r in fit.collect()]
        if last and max(abs(a - b) for a, b in zip(now, last, strict=True)) < 1e-8:
            break
        last = now
    return fit


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(actual) * F.count(actual))).alias("r2"))


# Scaling.


def scale(df: DataFrame, columns: list[str], how: str = "standard", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """standard ((x-mean)/s, s < 1e-10 counts as 1), minmax (to [low, high]) or robust ((x-median)/iqr); adds <column>_scaled."""
    for c, (a, b) in scaling(df, columns, how).items():
        z = (F.col(c) - a) / b
        df = df.withColumn(f"{c}_scaled", z * (high - low) + low if how == "minmax" else z)
    return df


def scaling(df: DataFrame, columns: list[str], how: str = "standard") -> dict[str, tuple[float, float]]:
    """Centre and width of each column; two numbers a column reach the driver."""
    if how == "robust":
        found = {c: quantiles(df, c, {"a": 0.5, "low": 0.25, "high": 0.75}).first() for c in columns}
        ends = {c: (r["a"], r["high"] - r["low"]) if r else (0.0, 1.0) for c, r in found.items()}
    else:
        v = {c: valid(F.col(c)) for c in columns}
        two = {"standard": lambda c: (F.avg(c), F.stddev_samp(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[how]
        row = df.agg(*[f.cast("double").alias(f"{x}_{c}") for c in columns for x, f in zip("ab", two(v[c]), strict=True)]).first()
        ends = {c: (row[f"a_{c}"], row[f"b_{c}"]) for c in columns}
    return {c: (float(a or 0.0), float(b) if b and b >= 1e-10 else 1.0) for c, (a, b) in ends.items()}


def unscale(df: DataFrame, fitted: dict[str, tuple[float, float]], how: str = "standard", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds <column>_restored from <column>_scaled, with what ``scaling`` gave."""
    for c, (a, b) in fitted.items():
        z = F.col(f"{c}_scaled")
        df = df.withColumn(f"{c}_restored", ((z - low) / (high - low) if how == "minmax" else z) * b + a)
    return df


def polynomial_features(df: DataFrame, columns: list[str], degree: int, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """Adds all monomials up to ``degree``, named like a^2*b."""
    from itertools import combinations, combinations_with_replacement

    out = df.withColumn("1", F.lit(1.0)) if bias else df
    for d in range(1, degree + 1):
        for combo in (combinations if interaction_only else combinations_with_replacement)(columns, d):
            if d == 1:
                continue
            name = "*".join(c if combo.count(c) == 1 else f"{c}^{combo.count(c)}" for c in dict.fromkeys(combo))
            product = F.lit(1.0)
            for c in combo:
                product = product * F.col(c)
            out = out.withColumn(name, product)
    return out


# Metrics.


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) from one confusion table; 0/0 is 0."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called")))))
    s = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("called").alias("called"))
    p, r = F.coalesce(F.col("tp") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    return s.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def _by_score(df: DataFrame, actual: str, score: str) -> DataFrame:
    """(score, p, n, p_low, n_low): positives and others at each distinct score and below it."""
    hit = F.col(actual) == 1
    g = df.where(F.col(score).isNotNull() & hit.isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(hit.cast("long")).alias("p"), F.sum((~hit).cast("long")).alias("n"))
    return running_before(written(g, "scores"), ["score"], {"p_low": F.col("p"), "n_low": F.col("n")})


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the ROC curve: how often a positive scores above another row, ties counting half."""
    g = _by_score(df, actual, score)
    above = F.sum(F.col("p").cast("double") * (F.col("n_low") + F.col("n") / 2))
    return g.agg((above / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def roc_curve(df: DataFrame, actual: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) of every distinct score."""
    g = written(_by_score(df, actual, score), "curve")
    whole = g.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return g.crossJoin(F.broadcast(whole)).select(F.col("score").alias("threshold"), ((F.col("tp") - F.col("p_low")) / F.col("tp")).alias("tpr"), ((F.col("tn") - F.col("n_low")) / F.col("tn")).alias("fpr"))  # one row


# Outliers.


def outliers(df: DataFrame, column: str, how: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Adds ``outlier`` by |z| > threshold, by threshold x IQR beyond the quartiles, or by 0.6745 |x - median| / MAD."""
    v = valid(F.col(column))
    if how == "zscore":
        s = df.agg(F.avg(v).alias("__a"), F.stddev_samp(v).alias("__b"))
        flag = (F.col("__b") >= 1e-10) & (F.abs(v - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0)) > threshold)
    elif how == "iqr":
        s = quantiles(df, column, {"__a": 0.25, "__b": 0.75})
        span = F.col("__b") - F.col("__a")
        flag = (v < F.col("__a") - threshold * span) | (v > F.col("__b") + threshold * span)
    else:
        s = median_absolute_deviation(df, column).select(F.col("centre").alias("__a"), F.col("value").alias("__b"))
        flag = (F.col("__b") > 0) & (0.6745 * F.abs(v - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0)) > threshold)
    return df.crossJoin(F.broadcast(s)).withColumn("outlier", F.coalesce(flag, F.lit(False))).drop("__a", "__b")  # one row


# Clustering and projection.


def kmeans(df: DataFrame, columns: list[str], centres: list[list[float]] | None = None, rounds: int = 20, tolerance: float = 1e-6, k: int | None = None, key: str | None = None, seed: int = 0, start: str = "parallel") -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's algorithm: each round is one map and one k-row aggregation. Returns df with ``cluster``, and the centres.

    Starts from given centres, or from ``k`` drawn by ``neighbours.start_centres``
    (``start``: parallel, plusplus or random), hashed from the rows' ``key``. The
    rows with all values are written once, and the rounds read these.
    """
    if centres is None:
        if k is None or key is None:
            raise ValueError("centres, or k and key, are needed")
        centres = start_centres(df, columns, k, key, seed, start)
        if not centres:
            raise ValueError("no row has all values")

    def assigned(c: list[list[float]], rows: DataFrame) -> DataFrame:
        d = F.array(*[sum((((F.col(x) - v) ** 2) for x, v in zip(columns, m, strict=True)), F.lit(0.0)) for m in c])
        return rows.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))

    points = written(spread(_complete(df, columns).select(*columns)), "points")
    for _ in range(rounds):
        rows = {r["cluster"]: [r[x] for x in columns] for r in assigned(centres, points).groupBy("cluster").agg(*[F.avg(x).alias(x) for x in columns]).collect()}
        new = [rows.get(i, m) for i, m in enumerate(centres)]
        moved = max(abs(a - b) for p, q in zip(new, centres, strict=True) for a, b in zip(p, q, strict=True))
        centres = new
        if moved <= tolerance:
            break
    forget(points)
    return assigned(centres, df), centres


def pca(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores pc1.., components (k x p, largest entry positive) and variances; only the p x p covariance is collected."""
    m, mean = _moments(df, columns)
    cov = m[1:, 1:] / (m[0, 0] - 1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:k]
    comp = vec[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    out = df
    for i, row in enumerate(comp):
        out = out.withColumn(f"pc{i + 1}", sum(((F.col(c) - float(mu)) * float(w) for c, mu, w in zip(columns, mean, row, strict=True)), F.lit(0.0)))
    return out, comp, val[order]


def lda(df: DataFrame, columns: list[str], label: str, most_classes: int = 1_000) -> DataFrame:
    """Linear discriminant scores: (label, term, coefficient) with the pooled covariance, from one grouped aggregation."""
    df = _complete(df, columns)
    means = F.broadcast(df.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(columns)]))  # one row
    x = [F.col(c).cast("double") - F.col(f"__m{i}") for i, c in enumerate(columns)]
    p = len(columns)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    found = df.crossJoin(means).groupBy(label).agg(F.count("*").alias("n"), *[F.max(f"__m{i}").alias(f"m{i}") for i in range(p)], *sums).limit(most_classes + 1).collect()
    if len(found) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    pooled, total = np.zeros((p, p)), float(sum(r["n"] for r in found))
    for r in found:
        off = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        pooled += q - r["n"] * np.outer(off, off)
    inverse = np.linalg.pinv(pooled / max(1.0, total - len(found)))
    rows = []
    for r in sorted(found, key=lambda r: str(r[label])):
        mean = np.array([r[f"m{i}"] + r[f"s{i}"] / r["n"] for i in range(p)])
        w = inverse @ mean
        rows += [(str(r[label]), "intercept", float(-0.5 * mean @ w + np.log(r["n"] / total)))] + [(str(r[label]), c, float(v)) for c, v in zip(columns, w, strict=True)]
    return df.sparkSession.createDataFrame(rows, "label string, term string, coefficient double")


def lda_predict(df: DataFrame, coefficients: DataFrame, name: str = "predicted") -> DataFrame:
    """Adds the class of highest discriminant score, and the probabilities of all classes as a map, <name>_proba."""
    scores: dict[str, Column] = {}
    for r in coefficients.collect():  # classes x features
        part = F.lit(r["coefficient"]) if r["term"] == "intercept" else F.lit(r["coefficient"]) * F.col(r["term"])
        scores[r["label"]] = scores[r["label"]] + part if r["label"] in scores else part
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    weights = {k: F.exp(v - F.col("__best")) for k, v in scores.items()}
    total = sum(weights.values(), F.lit(0.0))
    out = df.withColumn("__best", best)
    chosen = F.coalesce(*[F.when(v == F.col("__best"), F.lit(k)) for k, v in scores.items()])
    return out.withColumns({name: chosen, f"{name}_proba": F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), w / total)])}).drop("__best")


# Imputation.


def impute_simple(df: DataFrame, columns: list[str], strategy: str = "mean", fill: float = 0.0) -> DataFrame:
    """mean, median, most_frequent or constant; a column without values becomes 0."""
    if strategy in ("median", "most_frequent"):
        one = (lambda c: quantiles(df, c, {"x": 0.5})) if strategy == "median" else (lambda c: modes(df, c).select(F.col("mode").alias("x")))
        found = [one(c).first() for c in columns]
        values = [float(r["x"]) if r and r["x"] is not None else 0.0 for r in found]
    elif strategy == "mean":
        values = [x or 0.0 for x in df.agg(*[F.avg(valid(F.col(c))) for c in columns]).first()]
    else:
        values = [float(fill)] * len(columns)
    return df.withColumns({c: F.coalesce(valid(F.col(c)), F.lit(float(v))) for c, v in zip(columns, values, strict=True)})


def impute_knn(df: DataFrame, target: str, features: list[str], key: str, k: int = 5, metric: str = "euclidean", weighted: bool = False) -> DataFrame:
    """The mean target of the k nearest rows (euclidean or manhattan over ``features``) for rows that lack it.

    Neighbours are exact, see ``neighbours.nearest_rows``: equi-joins on pivots
    and rings, no row meets all donors. ``weighted`` divides by distance, an
    equal row then decides alone. Rows that lack a feature stay as they are.
    """
    donors = df.where(~missing(F.col(target)))
    met = nearest_rows(df.where(missing(F.col(target))), donors, features, key, k, metric, target).withColumnRenamed("__v", "__t")
    d = F.sqrt("__d") if metric == "euclidean" else F.col("__d")
    if weighted:
        mean = F.coalesce(F.avg(F.when(d == 0, F.col("__t"))), F.sum(F.when(d > 0, F.col("__t") / d)) / F.sum(F.when(d > 0, 1 / d)))
    else:
        mean = F.avg("__t")
    means = met.groupBy("__k", "__x").agg(mean.alias("__m"))
    own = F.col(key).eqNullSafe(F.col("__k")) & (vector(features) == F.col("__x")) & missing(F.col(target))
    return df.join(means, own, "left").withColumn(target, F.coalesce(valid(F.col(target)), F.col("__m"))).drop("__k", "__x", "__m")


def impute_chained(df: DataFrame, columns: list[str], rounds: int = 5, ridge: float = 1e-6) -> DataFrame:
    """Chained equations: each column with gaps is regressed in turn on the others, from mean-filled starts.

    The table is written after a round and the one before it deleted, so neither
    plans nor recomputation grow with the rounds.
    """
    gaps = {c: f"__gap_{c}" for c in columns}
    out = df.withColumns({g: missing(F.col(c)) for c, g in gaps.items()})
    out = before = written(impute_simple(out, columns), "chained")
    for _ in range(rounds):
        for c, g in gaps.items():
            fit = linear_regression(out.where(~F.col(g)), c, [x for x in columns if x != c], ridge)
            out = predict(out, fit, "__p").withColumn(c, F.when(F.col(g), F.col("__p")).otherwise(F.col(c))).drop("__p")
        out = written(out, "chained")
        forget(before)
        before = out
    return out.drop(*gaps.values())


# Resampling.


def _row_name(df: DataFrame, key: list[str] | None) -> Column:
    """What a row's draws are hashed from: its key as text (columns joined by |, null as nothing)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns])


def bootstrap_means(df: DataFrame, column: str, resamples: int, seed: int = 1, key: list[str] | None = None) -> DataFrame:
    """(resample, mean) by Poisson weights hashed from the row's ``key`` (default: all columns), resample and seed: one pass, no rows copied.

    Rows of equal keys get equal weights, so repeated rows need a key of their own.
    """
    steps = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    rows = df.select(_row_name(df, key).alias("__id"), F.col(column).cast("double").alias("__v")).where("__v is not null")
    weight = lambda u: sum(((u >= s).cast("int") for s in steps), F.lit(0))
    each = rows.select("__v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda i: F.struct(i.alias("resample"), draw_uniform(F.col("__id"), seed, i).alias("u")))).alias("x"))
    weighed = each.select("__v", "x.resample", weight(F.col("x.u")).alias("w"))
    return weighed.where("w > 0").groupBy("resample").agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("mean"))


def bootstrap_interval(df: DataFrame, column: str, resamples: int = 200, confidence: float = 0.95, seed: int = 1, key: list[str] | None = None) -> DataFrame:
    """One row (low, high): percentiles of the resamples' means."""
    a = (1 - confidence) / 2
    return bootstrap_means(df, column, resamples, seed, key).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))  # a value a resample


def time_series_split(df: DataFrame, splits: int, order: list[str]) -> DataFrame:
    """(split, fold, all columns): for each split, all rows before its test block are 'train' and the block is 'test'.

    Blocks are the last ``splits`` of splits + 1 equal parts in ``order``; what does not divide goes to the first.
    """
    n = df.count()
    size = n // (splits + 1)
    if not size:
        raise ValueError(f"{n} rows are too few for {splits} splits")
    block = F.greatest(F.lit(0), F.floor((F.col("__pos") - (n - size * splits)) / size) + 1)
    placed = running_before(df, order, {"__pos": F.lit(1).cast("long")}).withColumn("__block", block)
    each = placed.withColumn("split", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__block")), F.lit(splits)))).withColumn("split", F.col("split").cast("int"))
    return each.select("split", F.when(F.col("__block") == F.col("split"), "test").otherwise("train").alias("fold"), *df.columns)


def kfold(df: DataFrame, k: int, key: str, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1: by hash of ``key``, or by position in the order of the hash within each stratum.

    A position in a stratum is the position in the whole table less the rows of the strata before, so a hot stratum is split as any other rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    if stratify is None:
        return df.withColumn("fold", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % k).cast("int"))
    counts = written(df.groupBy(F.col(stratify).alias("__s")).agg(F.count("*").alias("__n")), "strata")
    starts = running_before(counts, ["__s"], {"__start": F.col("__n")}).select("__s", "__start")
    if counts.limit(STRATA_BROADCAST + 1).count() <= STRATA_BROADCAST:
        starts = F.broadcast(starts)
    placed = running_before(df.withColumn("__h", h), [stratify, "__h", key], {"__pos": F.lit(1).cast("long")})
    both = placed.join(starts, F.col(stratify).eqNullSafe(F.col("__s")))
    return both.withColumn("fold", ((F.col("__pos") - F.col("__start")) % k).cast("int")).select(*df.columns, "fold")


def cross_validate(folded: DataFrame, fit: Callable[[DataFrame], object], score: Callable[[DataFrame, object], float], fold: str = "fold") -> DataFrame:
    """(fold, score): ``fit`` on all rows outside a fold, ``score`` of that model on its rows; one pass of each per fold. ``folded`` comes from ``kfold``."""
    folds = sorted(r[0] for r in folded.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    scores = [(int(i), float(score(folded.where(F.col(fold) == i), fit(folded.where(F.col(fold) != i))))) for i in folds]
    return folded.sparkSession.createDataFrame(scores, "fold int, score double")


def permutation_test(df: DataFrame, column: str, first: Column, resamples: int = 200, seed: int = 1, key: list[str] | None = None) -> DataFrame:
    """One row (observed, p_value): mean of the rows where ``first`` holds less that of the others, against rows dealt anew by hash.

    Rows fall into the first group with its share as probability, so sizes vary a
    little between resamples; no resample is sorted or copied as a whole. The
    p-value is the share of differences at least as large. Rows with a missing
    value or a null ``first`` do not count; equal keys are dealt alike.
    """
    rows = df.select(_row_name(df, key).alias("__id"), F.col(column).cast("double").alias("v"), first.alias("g")).where(~missing(F.col("v")) & F.col("g").isNotNull())
    seen = rows.agg(F.avg(F.col("g").cast("double")).alias("share"), (F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("d")).first()
    dealt = rows.select("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda i: F.struct(i.alias("resample"), (draw_uniform(F.col("__id"), seed, i) < float(seen["share"] or 0.0)).alias("g")))).alias("x"))
    again = dealt.groupBy("x.resample").agg((F.avg(F.when(F.col("x.g"), F.col("v"))) - F.avg(F.when(~F.col("x.g"), F.col("v")))).alias("d"))
    observed = F.lit(seen["d"]).cast("double")
    return again.agg(observed.alias("observed"), F.avg((F.col("d") >= observed).cast("double")).alias("p_value"))
