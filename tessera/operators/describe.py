"""Descriptive statistics as aggregate columns; NaN counts as missing, results over nothing are null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import missing, valid
from tessera.operators.frame import _cuts, _part, running_before
from tessera.sources.scratch import written


def mean(c: Column) -> Column:
    return F.avg(valid(c))


def var(c: Column) -> Column:
    """Sample variance."""
    return F.var_samp(valid(c))


def std(c: Column) -> Column:
    return F.stddev_samp(valid(c))


def var_pop(c: Column) -> Column:
    return F.var_pop(valid(c))


def std_pop(c: Column) -> Column:
    return F.stddev_pop(valid(c))


def range_(c: Column) -> Column:
    return F.max(valid(c)) - F.min(valid(c))


def skewness(c: Column) -> Column:
    """Mean cube of standardised values, by the sample deviation."""
    n = F.count(valid(c))
    return F.skewness(valid(c)) * F.pow((n - 1) / n, F.lit(1.5))


def kurtosis(c: Column) -> Column:
    """Mean fourth power of standardised values (3 for a normal distribution), by the sample deviation."""
    n = F.count(valid(c))
    return (F.kurtosis(valid(c)) + 3) * F.pow((n - 1) / n, F.lit(2.0))


def excess_kurtosis(c: Column) -> Column:
    return kurtosis(c) - 3


def root_mean_square(c: Column) -> Column:
    return F.sqrt(F.avg(valid(c) * valid(c)))


def geometric_mean(c: Column) -> Column:
    """NaN if any value is not positive."""
    return F.when(F.min(valid(c)) <= 0, F.lit(float("nan"))).otherwise(F.exp(F.avg(F.log(valid(c)))))


def harmonic_mean(c: Column) -> Column:
    """0 if any value is 0."""
    return F.when(F.bool_or(valid(c) == 0), 0.0).otherwise(F.count(valid(c)) / F.sum(1 / F.nullif(valid(c), F.lit(0.0))))


def exact_sum(c: Column) -> Column:
    """Summed in decimals of 12 places, so the order of rows does not matter; for values below 10^26, null beyond."""
    return F.sum(valid(c).cast("decimal(38,12)")).cast("double")


def covariance(x: Column, y: Column) -> Column:
    return F.covar_samp(F.when(valid(y).isNotNull(), valid(x)), F.when(valid(x).isNotNull(), valid(y)))


def correlation(x: Column, y: Column) -> Column:
    """Null where a column is constant (F.corr divides by zero there)."""
    a, b = F.when(valid(y).isNotNull(), valid(x)).cast("double"), F.when(valid(x).isNotNull(), valid(y)).cast("double")
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


AGGREGATES = {f.__name__.rstrip("_"): f for f in (mean, var, std, var_pop, std_pop, range_, skewness, kurtosis, excess_kurtosis, root_mean_square, geometric_mean, harmonic_mean, exact_sum)}


def _same_keys(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def counted(df: DataFrame, column: str | Column, keys: list[str] | None = None) -> DataFrame:
    """A written table of (keys, __v, __n): how often each value occurs. Serves ``quantiles`` and ``modes`` alike."""
    c = F.col(column) if isinstance(column, str) else column
    return written(df.withColumn("__v", valid(c)).where("__v is not null").groupBy(*(keys or []), "__v").agg(F.count("*").alias("__n")), "counts")


def quantiles(df: DataFrame, column: str | Column, qs: dict[str, float], keys: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per key with values (without keys: one row at all): each named quantile, exact, linearly interpolated.

    Distinct values are counted (``counts``, if that was done before) and the
    counts summed by key and part of the value range. The sums tell which parts
    hold the wanted places; only the values of these parts are sorted.
    """
    keys = keys or []
    counts = counts if counts is not None else counted(df, column, keys)
    dealt = counts.withColumn("__part", _part(counts, ["__v"], _cuts(counts, ["__v"])))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row a part
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__s"))
    sums = sums.withColumns({"__base": F.sum("__s").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s"), "__t": F.sum("__s").over(whole)})
    at = {k: F.lit(float(q)) * (F.col("__t") - 1) for k, q in qs.items()}
    within = lambda place, low, n: (low <= place) & (place < low + n)
    wanted = F.lit(False)
    for p in at.values():
        wanted = wanted | within(F.floor(p), F.col("__base"), F.col("__s")) | within(F.ceil(p), F.col("__base"), F.col("__s"))
    open_ = sums.where(wanted).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), "__base", "__t")
    found = dealt.join(open_, _same_keys(keys, [f"__k_{k}" for k in keys]) & (F.col("__part") == F.col("__p")))
    inside = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("__low", F.col("__base") + F.sum("__n").over(inside) - F.col("__n"))
    pick = lambda place: F.max(F.when(within(place, F.col("__low"), F.col("__n")), F.col("__v")))
    found = found.groupBy(*keys).agg(*[f for k, p in at.items() for f in (pick(F.floor(p)).alias(f"__a_{k}"), pick(F.ceil(p)).alias(f"__b_{k}"), F.max(p - F.floor(p)).alias(f"__f_{k}"))])
    return found.select(*keys, *[(F.col(f"__a_{k}") + (F.col(f"__b_{k}") - F.col(f"__a_{k}")) * F.col(f"__f_{k}")).alias(k) for k in qs])


def modes(df: DataFrame, column: str, keys: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(keys, mode): the most frequent value, the smallest of ties."""
    counts = counts if counts is not None else counted(df, column, keys)
    return counts.groupBy(*(keys or [])).agg(F.min_by("__v", F.struct(-F.col("__n"), "__v")).alias("mode"))


def describe(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """count (NaN included), mean, std, min, quartiles and max."""
    keys, v = keys or [], valid(F.col(column))
    out = df.groupBy(*keys).agg(F.count(column).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    q = q.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "q25", "q50", "q75")
    return out.join(q, _same_keys(keys, [f"__k_{k}" for k in keys]), "left").select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def arg_extremes(df: DataFrame, column: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, argmin, argmax): the labels of the least and the largest value, the smallest label of ties; missing values do not count."""
    v = valid(F.col(column))
    present = F.when(v.isNotNull(), F.col(label))
    return df.groupBy(*(keys or [])).agg(F.min_by(present, F.when(v.isNotNull(), F.struct(v, label))).alias("argmin"), F.min_by(present, F.when(v.isNotNull(), F.struct(-v, label))).alias("argmax"))


def mean_absolute_deviation(df: DataFrame, column: str) -> DataFrame:
    one = F.broadcast(df.agg(mean(F.col(column)).alias("__c")))  # one row
    return df.crossJoin(one).agg(F.avg(F.abs(valid(F.col(column)) - F.col("__c"))).alias("value"))


def median_absolute_deviation(df: DataFrame, column: str) -> DataFrame:
    """One row (value, centre)."""
    one = written(quantiles(df, column, {"centre": 0.5}), "centre")
    off = df.select(valid(F.col(column)).alias("__x")).crossJoin(F.broadcast(one))  # one row
    return quantiles(off, F.abs(F.col("__x") - F.col("centre")), {"value": 0.5}).crossJoin(F.broadcast(one))


def correlation_matrix(df: DataFrame, columns: list[str], how: str = "correlation") -> DataFrame:
    """Long form (a, b, value) of all pairs, in one aggregation."""
    f = {"correlation": correlation, "covariance": covariance}[how]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), f(F.col(a), F.col(b)).alias("value")) for a, b in pairs]).alias("m"))
    half = row.select(F.inline("m"))
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def ranked(df: DataFrame, column: str, name: str, method: str = "average") -> DataFrame:
    """Adds ranks from 1. Ranks come from counts of distinct values, not from one sorted task."""
    counts = written(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")), "counts")
    low = running_before(counts, ["__v"], {"__low": F.col("__n")})
    rank = {"average": F.col("__low") + (F.col("__n") + 1) / 2, "min": F.col("__low") + 1, "max": F.col("__low") + F.col("__n")}[method]
    return df.join(low.select("__v", rank.cast("double").alias(name)), F.col(column) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties averaged."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    return ranked(ranked(both, "x", "rx"), "y", "ry").agg(correlation(F.col("rx"), F.col("ry")).alias("value"))


def histogram(df: DataFrame, column: str, bins: int, pad: float = 0.001) -> DataFrame:
    """(bin, low, high, count) of equal bins over the range widened by ``pad`` on each side; empty bins count 0."""
    v = valid(F.col(column))
    ends = df.agg((F.min(v) - pad * (F.max(v) - F.min(v))).alias("lo"), (F.max(v) + pad * (F.max(v) - F.min(v))).alias("hi"))
    placed = df.select(v.alias("v")).where("v is not null").crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))).cast("int")
    counts = placed.groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.col("lo") + i * width
    return all_bins.join(counts, "bin", "left").crossJoin(F.broadcast(ends)).select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def binning(c: Column, edges: list[float]) -> Column:
    """Bin number; -1 below the first edge and for missing values, the last bin above the last edge."""
    out = F.lit(-1)
    for i, e in enumerate(edges[:-1]):
        out = F.when(valid(c) >= e, F.lit(i)).otherwise(out)
    return out


def histogram2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """(by, bx, count) of the cells that have rows."""
    cells = df.select(binning(F.col(y), y_edges).alias("by"), binning(F.col(x), x_edges).alias("bx")).where("by >= 0 and bx >= 0")
    return cells.groupBy("by", "bx").agg(F.count("*").alias("count"))


def concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Concordant less discordant pairs of two arrays, ties of either counting 0: halves are merged level by level, n log^2 n."""
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    n, width, total = len(x), 1, 0
    at = np.arange(n)
    while width < n:
        block, right = at // (2 * width), (at // width) % 2
        by = np.lexsort((y, block))
        b, r, v = block[by], right[by], y[by]
        lefts = np.concatenate([[0], np.cumsum(1 - r)])
        first = np.searchsorted(b, b)  # where the block begins
        last = np.searchsorted(b, b, side="right")
        run = b * (n + 1) + v
        low, high = np.searchsorted(run, run), np.searchsorted(run, run, side="right")
        below, above = lefts[low] - lefts[first], lefts[last] - lefts[high]
        total += int((r * (below - above)).sum())
        width *= 2
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    same_x, at_x = np.unique(x, return_inverse=True)
    counts_x = np.bincount(at_x, minlength=len(same_x))
    counts_xy = np.unique(at_x * (n + 1) + y, return_counts=True)[1]
    return total - (pairs(counts_x) - pairs(counts_xy))  # equal x, different y were sorted by y and counted as concordant


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (value): tau-a over all pairs of rows with both values; null for fewer than two.

    Rows are cut into strips by x and by y, at most MOST_PARTS of each, with each
    bound a strip of its own. Pairs in different strips of both are settled by
    the counts of the cells; pairs in one strip of x, and then those in one strip
    of y only, are counted strip by strip. A strip of one x value has no such
    pairs, so a frequent value costs nothing.
    """
    rows = written(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~missing(F.col("x")) & ~missing(F.col("y"))), "pairs")
    dealt = rows.select("x", "y", _strip(rows, "x").alias("a"), _strip(rows, "y").alias("b"))
    cells = dealt.groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # bounded by the number of strips
    n = sum(r["n"] for r in cells)
    if n < 2:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    grid = np.zeros((max(r["a"] for r in cells) + 2, max(r["b"] for r in cells) + 2), dtype=object)
    for r in cells:
        grid[r["a"] + 1, r["b"] + 1] = r["n"]
    upto = grid.cumsum(axis=0).cumsum(axis=1)  # Python integers: products of counts do not overflow
    total = 0
    for r in cells:
        a, b = r["a"] + 1, r["b"] + 1
        total += r["n"] * (upto[a - 1, b - 1] - (upto[a - 1, -1] - upto[a - 1, b]))

    def inside(first: str, second: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [str(concordance(pdf[first].to_numpy(), pdf[second].to_numpy()))]})

        return run

    mixed = lambda strip, c: dealt.join(dealt.groupBy(strip).agg((F.min(c) < F.max(c)).alias("__m")).where("__m").select(F.col(strip).alias("__s")), F.col(strip) == F.col("__s"), "left_semi")
    for strip, varies, first, second in (("a", "x", "x", "y"), ("b", "y", "a", "y")):
        total += sum(int(r["s"]) for r in mixed(strip, varies).groupBy(strip).applyInPandas(inside(first, second), "s string").collect())
    return df.sparkSession.createDataFrame([(float(total / (n * (n - 1) / 2)),)], "value double")


def _strip(df: DataFrame, column: str) -> Column:
    """The strip of a value: 2i between bounds, 2i + 1 on bound i."""
    cuts = [c[0] for c in _cuts(df, [column])]
    part = _part(df, [column], [(c,) for c in cuts])
    on = F.col(column).isin(cuts) if cuts else F.lit(False)
    return 2 * part - F.when(on, 1).otherwise(0)
