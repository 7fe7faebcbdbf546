"""Time series: one table holds many series (``keys``), ordered by ``order`` (or a timestamp).

Everything that only looks at neighbouring rows is a window expression;
recursions over a whole series run once per key on its sorted rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from operator import and_
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import valid
from tessera.operators.frame import _cuts, _part, running_before


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def moving_average(df: DataFrame, column: str, window: int, order: list[str], keys: list[str], method: str = "forward", name: str = "sma") -> DataFrame:
    """Trailing ('forward') or centred mean; null where the window is cut off."""
    w = _w(keys, order)
    half = window // 2
    span, need = ((-(window - 1), 0), window) if method == "forward" else ((-half, half), 2 * half + 1)
    over = w.rowsBetween(*span)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(over) == need, F.avg(valid(F.col(column))).over(over)))


def weighted_average(df: DataFrame, column: str, weights: list[float], order: list[str], keys: list[str], name: str = "wma") -> DataFrame:
    """Weights from oldest to newest, renormalised over the values present."""
    w, v = _w(keys, order), valid(F.col(column))
    lags = [(F.lag(v, len(weights) - 1 - i).over(w), float(x)) for i, x in enumerate(weights)]
    top = sum((F.coalesce(l * x, F.lit(0.0)) for l, x in lags), F.lit(0.0))
    bottom = sum((F.when(l.isNotNull(), x).otherwise(0.0) for l, x in lags), F.lit(0.0))
    return df.withColumn(name, F.when(F.row_number().over(w) >= len(weights), top / F.nullif(bottom, F.lit(0.0))))


def kernel_smooth(df: DataFrame, column: str, bandwidth: float, order: list[str], keys: list[str], kernel: str = "gaussian", name: str = "smooth") -> DataFrame:
    """Kernel mean over row distance; the gaussian is cut at 4 bandwidths, where its weight is 3e-4."""
    w, v = _w(keys, order), valid(F.col(column))
    reach = int(math.ceil(4 * bandwidth if kernel == "gaussian" else bandwidth))
    weight = {"gaussian": lambda u: math.exp(-u * u / 2), "uniform": lambda u: float(abs(u) <= 1), "triangular": lambda u: max(0.0, 1 - abs(u))}[kernel]
    top, bottom = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        x = F.lag(v, -d).over(w) if d <= 0 else F.lead(v, d).over(w)
        k = weight(d / bandwidth)
        if k:
            top, bottom = top + F.coalesce(x * k, F.lit(0.0)), bottom + F.when(x.isNotNull(), k).otherwise(0.0)
    return df.withColumn(name, top / F.nullif(bottom, F.lit(0.0)))


def per_series(df: DataFrame, keys: list[str], order: list[str], column: str, names: list[str], f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Adds columns computed by ``f`` from each series' values in order; one task per series, series spread over the cluster."""
    schema = type(df.schema)(list(df.schema.fields))
    for n in names:
        schema = schema.add(n, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**f(pdf[column].to_numpy(dtype=float)))

    return df.groupBy(*keys).applyInPandas(run, schema)


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null and NaN equals NaN."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:], strict=False)], dtype=bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return ~same.to_numpy().astype(bool)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups and the rows where these begin, from sorted batches; only the last group so far is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        around = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch])
        fresh = np.zeros(len(around) - 1, dtype=bool)
        for k in keys:
            fresh |= _differs(around[k])
        at = np.flatnonzero(fresh) + (0 if held else 1)
        if len(at):
            before, last = sum(b.num_rows for b in held), int(at[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)]), [0, *(int(i) + before for i in at[:-1])]
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held), [0]


def linear_scan(df: DataFrame, column: str, step: list[list[float]], gain: list[float], order: list[str], keys: list[str], name: str, two: bool = False) -> DataFrame:
    """Adds ``name`` from a state z that each present value x moves to ``step`` z + ``gain`` x; missing values leave it.

    The first present value starts the state; with ``two`` it is (level, trend),
    the trend being the slope to the second one, the output their sum, and
    series of fewer than two values have none. Else the output is the state,
    null before the first value (with ``two``: the first value).

    The sorted table is cut into parts by sampled bounds, at most MOST_PARTS,
    and a task runs the series of its parts one after another. Only series that
    a bound cuts in two, one a bound at most, are looked at before: each of
    their parts is summed up by how many values it has, its first two and the
    state that the rest would reach from zero; since the step is linear, these
    few rows give every part its first state. So one endless series is no
    single task, and many short ones cost no group of their own.
    """
    a, c = np.array(step, dtype=float), np.array(gain, dtype=float)
    lines, size, columns = list(zip(a.tolist(), c.tolist(), strict=True)), len(c), df.columns
    begins, states = [f"__begin{i}" for i in range(size)], [f"__state{i}" for i in range(size)]  # no arrays, which are slow to hand to Python
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kinds += ", " if keys else ""
    cuts = _cuts(df, [*keys, *order])
    dealt = df.withColumn("__part", _part(df, [*keys, *order], cuts)).withColumn("__x", F.col(column).cast("double"))

    def reach(z: list[float], values: list[float]) -> list[float]:
        for v in values:
            z = [sum(p * q for p, q in zip(line, z, strict=True)) + g * v for line, g in lines]
        return z

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")["__x"].to_numpy(dtype=float)
        there = np.flatnonzero(~np.isnan(x))
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"__part": [pdf["__part"].iloc[0]], "n": [len(x)], "m": [len(there)], "at": [there[:2].tolist()], "first": [x[there[:2]].tolist()], "rest": [reach([0.0] * size, x[there[1:]].tolist())]}
        return pd.DataFrame(row)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        seen, before = [], 0
        rows = pdf.to_dict("records")
        for r in rows:
            seen += [(before + i, x) for i, x in zip(r["at"], r["first"], strict=True)]
            before += r["n"]
        out, z, begin = [], None, first_state(seen[:2])
        for r in rows:
            out.append({**{k: r[k] for k in keys}, "__part": r["__part"], "__begin": begin, "__state": z})
            if begin is not None and r["m"]:
                z = np.array(begin) if z is None else a @ np.array(z) + c * r["first"][0]
                z = (np.linalg.matrix_power(a, r["m"] - 1) @ z + np.array(r["rest"])).tolist()
        return pd.DataFrame(out)[[*keys, "__part", "__begin", "__state"]]

    def first_state(seen: list[tuple[int, float]]) -> list[float] | None:
        """Of the places and values of the first two present values."""
        if len(seen) <= two:
            return None
        return [seen[0][1], (seen[1][1] - seen[0][1]) / (seen[1][0] - seen[0][0])] if two else [seen[0][1]]

    if cuts:
        on, long = F.col("__part") == F.col("__p"), dealt.select(*keys, *order, "__part", "__x")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        if keys:
            split = dict.fromkeys(tuple(row[k] for k in keys) for row in cuts)
            split = [F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(f"__k_{k}") for k, v in zip(keys, row, strict=True)]) for row in split]
            split = df.sparkSession.range(1).select(F.inline(F.array(*split)))  # a row a bound at most
            long = long.join(F.broadcast(split), reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)), "left_semi")
        sums = long.groupBy(*keys, "__part").applyInPandas(sum_up, f"{kinds}__part int, n long, m long, at array<long>, first array<double>, rest array<double>")
        starts = sums.groupBy(*keys).applyInPandas(carry, f"{kinds}__part int, __begin array<double>, __state array<double>")  # two rows a bound at most
        starts = starts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), F.lit(True).alias("__split"), *[F.col(f"__{kind}")[i].alias(f"__{kind}{i}") for kind in ("begin", "state") for i in range(size)])
        dealt = dealt.join(F.broadcast(starts), on, "left")
    else:
        dealt = dealt.withColumns({"__split": F.lit(False)} | {c: F.lit(None).cast("double") for c in [*begins, *states]})
    ready = dealt.select(*df.columns, "__part", "__x", "__split", *begins, *states).repartition("__part").sortWithinPartitions("__part", *keys, *order)
    schema = type(df.schema)(list(df.schema.fields)).add(name, "double")

    def smooth(x: list[float], begin: list[float] | None, z: list[float] | None) -> list[float]:
        if begin is None:
            return [math.nan] * len(x)
        out = []
        for v in x:
            if v == v:
                fresh = z is None
                z = begin if fresh else reach(z, [v])
                out.append(begin[0] if fresh and two else sum(z) if two else z[0])
            elif z is not None:
                out.append(sum(z) if two else z[0])
            else:
                out.append(begin[0] if two else math.nan)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["__part", *keys]):
            x, out = table["__x"].to_numpy().tolist(), []
            known = table.select(["__split", *begins, *states]).take(at).to_pylist()
            for i, j, start in zip(at, [*at[1:], len(x)], known, strict=True):
                begin, z = (None if start[names[0]] is None else [start[n] for n in names] for names in (begins, states))
                if not start["__split"]:
                    begin = first_state(list(islice(((n, v) for n, v in enumerate(x[i:j]) if v == v), 2)))
                out += smooth(x[i:j], begin, z)
            made = np.array(out, dtype=float)
            yield from table.select(columns).append_column(name, pa.array(made, mask=np.isnan(made))).to_batches()

    return ready.mapInArrow(run, schema)


def exponential_average(df: DataFrame, column: str, alpha: float, order: list[str], keys: list[str]) -> DataFrame:
    """Adds ``ema``; missing values carry the last average on. Long series are run in parts, see ``linear_scan``."""
    return linear_scan(df, column, [[1 - alpha]], [alpha], order, keys, "ema")


def holt(df: DataFrame, column: str, alpha: float, beta: float, order: list[str], keys: list[str]) -> DataFrame:
    """Adds ``holt``, level plus trend of double exponential smoothing; missing values keep both, series of less than two values have none. Long series are run in parts."""
    return linear_scan(df, column, [[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]], [alpha, alpha * beta], order, keys, "holt", two=True)


def _holt_winters(x: np.ndarray, alpha: float, beta: float, gamma: float, m: int, multiplicative: bool) -> np.ndarray:
    first = x[:m][~np.isnan(x[:m])]
    if not len(first):
        return np.full(len(x), np.nan)
    season = np.full(m, float(multiplicative))
    level, trend, out = first.mean(), 0.0, np.empty(len(x))
    for t, v in enumerate(x):
        s = season[t % m]
        if t >= m and not math.isnan(v):
            before = level
            level = alpha * (v / s if multiplicative else v - s) + (1 - alpha) * (level + trend)
            trend += beta * (level - before - trend)
            s = season[t % m] = gamma * (v / (level + trend) if multiplicative else v - level - trend) + (1 - gamma) * s
        out[t] = (level + trend) * s if multiplicative else level + trend + s
    return out


def holt_winters(df: DataFrame, column: str, alpha: float, beta: float, gamma: float, period: int, order: list[str], keys: list[str], seasonal: str = "additive") -> DataFrame:
    """Adds ``holt_winters``: triple exponential smoothing from the first season's mean, no trend and neutral factors; missing values keep the state."""
    return per_series(df, keys, order, column, ["holt_winters"], lambda x: {"holt_winters": _holt_winters(x, alpha, beta, gamma, period, seasonal != "additive")})


def _lowess(x: np.ndarray, bandwidth: float, rounds: int) -> np.ndarray:
    n = len(x)
    k = max(2, min(n, int(math.ceil(bandwidth * n))))
    robust, out = np.ones(n), x.copy()
    for _ in range(rounds + 1):
        for i in range(n):
            lo = max(0, min(n - k, i - k // 2))
            at = np.arange(lo, lo + k)
            d = np.abs(at - i) / max(1, np.abs(at - i).max())
            w = (1 - d**3) ** 3 * robust[at]
            sw = w.sum()
            mx, my = (w * at).sum() / sw, (w * x[at]).sum() / sw
            var = (w * (at - mx) ** 2).sum()
            out[i] = my + ((w * (at - mx) * (x[at] - my)).sum() / var * (i - mx) if var > 0 else 0)
        s = np.median(np.abs(x - out)) * 6 or 1.0
        robust = np.maximum(0, 1 - ((x - out) / s) ** 2) ** 2 + 1e-12
    return out


def lowess(df: DataFrame, column: str, bandwidth: float, order: list[str], keys: list[str], iterations: int = 2) -> DataFrame:
    """Adds ``lowess``: robust local linear fits with tricube weights."""
    return per_series(df, keys, order, column, ["lowess"], lambda x: {"lowess": _lowess(x, bandwidth, iterations)})


def savitzky_golay(df: DataFrame, column: str, window: int, degree: int, order: list[str], keys: list[str], name: str = "savgol") -> DataFrame:
    """Least-squares polynomial smoothing: fixed weights over neighbouring rows; null at the edges."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    weights = np.linalg.pinv(basis)[0]
    w = _w(keys, order)
    out = F.lit(0.0)
    for d, k in zip(range(-half, half + 1), weights, strict=True):
        out = out + (F.lag(column, -d).over(w) if d <= 0 else F.lead(column, d).over(w)) * float(k)
    return df.withColumn(name, out)


def decompose(df: DataFrame, column: str, period: int, order: list[str], keys: list[str], model: str = "additive") -> DataFrame:
    """Adds trend (centred mean, 2 x m for even periods), seasonal (mean per phase, normalised) and residual."""
    w, half = _w(keys, order), period // 2
    c = F.col(column).cast("double")
    if period % 2:
        span = w.rowsBetween(-half, half)
        trend = F.when(F.count(F.lit(1)).over(span) == period, F.avg(c).over(span))
    else:
        full, span = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
        ends = F.lag(c, half).over(w) + F.lead(c, half).over(w)
        trend = F.when(F.count(F.lit(1)).over(full) == period + 1, (F.sum(c).over(span) + ends / 2) / period)
    rows = df.withColumns({"trend": trend, "__phase": (F.row_number().over(w) - 1) % period})
    off = c - F.col("trend") if model == "additive" else c / F.col("trend")
    phases = rows.groupBy(*keys, "__phase").agg(F.avg(off).alias("__s"))
    centre = F.avg("__s").over(Window.partitionBy(*keys))
    seasonal = phases.select(*keys, "__phase", (F.col("__s") - centre if model == "additive" else F.col("__s") / centre).alias("seasonal"))
    out = rows.join(seasonal, [*keys, "__phase"]).drop("__phase")
    return out.withColumn("residual", c - F.col("trend") - F.col("seasonal") if model == "additive" else c / (F.col("trend") * F.col("seasonal")))


def strengths(decomposed: DataFrame, keys: list[str]) -> DataFrame:
    """seasonal and trend strength, var/(var + residual var), and the RMSE without residual."""
    v = F.var_samp
    ok = F.col("residual").isNotNull()
    pick = lambda c: F.when(ok, F.col(c))
    return decomposed.groupBy(*keys).agg((v(pick("seasonal")) / (v(pick("seasonal")) + v("residual"))).alias("seasonal_strength"), (v(pick("trend")) / (v(pick("trend")) + v("residual"))).alias("trend_strength"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"))


def autocorrelation(df: DataFrame, column: str, lags: int, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, lag, acf) for lags 0..lags, biased: one window and one aggregation."""
    w = _w(keys, order)
    rows = df.withColumn("__d", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    rows = rows.select(*keys, "__d", *[F.lag("__d", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    base = F.sum(F.col("__d") ** 2)
    cells = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))] + [F.struct(F.lit(k).alias("lag"), (F.coalesce(F.sum(F.col("__d") * F.col(f"__l{k}")), F.lit(0.0)) / F.nullif(base, F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)]
    return rows.groupBy(*keys).agg(F.array(*cells).alias("m")).select(*keys, F.inline("m"))


def partial_autocorrelation(df: DataFrame, column: str, lags: int, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, lag, pacf) by Durbin-Levinson on the few autocorrelations of each series."""
    acf = autocorrelation(df, column, lags, order, keys)
    schema = ", ".join([f"`{k}` {acf.schema[k].dataType.simpleString()}" for k in keys] + ["lag int, pacf double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy()
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            top, bottom = r[k] - phi @ r[k - 1 : 0 : -1] if k > 1 else r[1], 1 - phi @ r[1:k] if k > 1 else 1.0
            p = top / bottom if bottom else 0.0
            phi = np.append(phi - p * phi[::-1], p)
            out.append(p)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": range(len(out)), "pacf": out})[[*keys, "lag", "pacf"]]

    return acf.groupBy(*keys).applyInPandas(run, schema)


def cross_correlation(df: DataFrame, x: str, y: str, lags: int, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, lag, ccf): mean product of standardised x_t and y_(t+lag) over the overlap."""
    w, all_ = _w(keys, order), Window.partitionBy(*keys)
    z = lambda c: (F.col(c) - F.avg(c).over(all_)) / F.nullif(F.stddev_samp(c).over(all_), F.lit(0.0))
    rows = df.select(*keys, *order, z(x).alias("__x"), z(y).alias("__y"))
    rows = rows.select(*keys, "__x", *[(F.lead("__y", k).over(w) if k >= 0 else F.lag("__y", -k).over(w)).alias(f"__y{k + lags}") for k in range(-lags, lags + 1)])
    cells = [F.struct(F.lit(k).alias("lag"), F.avg(F.col("__x") * F.col(f"__y{k + lags}")).alias("ccf")) for k in range(-lags, lags + 1)]
    return rows.groupBy(*keys).agg(F.array(*cells).alias("m")).select(*keys, F.inline("m"))


def portmanteau(df: DataFrame, column: str, lags: int, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, ljung_box, box_pierce, df)."""
    acf = autocorrelation(df, column, lags, order, keys)
    n = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(column).alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    j = acf.where("lag > 0").join(n, on)
    r2, m = F.col("acf") ** 2, F.max("n")
    return j.groupBy(*keys).agg((m * (m + 2) * F.sum(r2 / (F.col("n") - F.col("lag")))).alias("ljung_box"), (m * F.sum(r2)).alias("box_pierce"), F.lit(float(lags)).alias("df"))


def durbin_watson(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    d = F.col(column) - F.lag(column).over(_w(keys, order))
    return df.withColumn("__d", d).groupBy(*keys).agg((F.sum(F.col("__d") ** 2) / F.sum(F.col(column) ** 2)).alias("dw"))


def seasonal_period(df: DataFrame, column: str, lags: int, order: list[str], keys: list[str], threshold: float = 0.3) -> DataFrame:
    """(keys, period): the lag from 2 on of the highest autocorrelation above ``threshold``; null without one."""
    acf = autocorrelation(df, column, lags, order, keys)
    return acf.groupBy(*keys).agg(F.max_by(F.when((F.col("lag") >= 2) & (F.col("acf") > threshold), F.col("lag")), F.when((F.col("lag") >= 2) & (F.col("acf") > threshold), F.col("acf"))).alias("period"))


def seasonal_periods(df: DataFrame, column: str, order: list[str], keys: list[str], most: int = 3, longest: int = 50, threshold: float = 0.3) -> DataFrame:
    """(keys, place, period, score): up to ``most`` seasonal periods, the strongest first (place 1).

    Scores are absolute autocorrelations at the lags 2 to ``longest``, at most
    half the rows. Lags are taken by score, ties by the shorter, and left out
    within one step of a multiple (up to 6) of one taken before, or if one taken
    is such a multiple of theirs. Below ``threshold`` nothing is taken, but if
    nothing reaches it, the one best lag is. Series of fewer than 6 rows have none.
    """
    acf = autocorrelation(df, column, longest, order, keys)
    rows = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    scored = acf.join(rows, on).where((F.col("__n") >= 6) & (F.col("lag") >= 2) & (F.col("lag") <= F.floor(F.col("__n") / 2)) & F.col("acf").isNotNull())
    return _spread(scored.select(*keys, F.col("lag").cast("int").alias("period"), F.abs("acf").alias("score")), keys, most, threshold)


def _spread(scored: DataFrame, keys: list[str], most: int, threshold: float) -> DataFrame:
    """(keys, place, period, score) of the best (period, score) rows that are no harmonics of each other."""
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("period").alias("p"))))  # as many as there are lags
    ranked = scored.groupBy(*keys).agg(first.alias("all"))
    times = F.sequence(F.lit(1), F.lit(6))
    near = lambda p, q: F.exists(times, lambda k: (F.abs(p - k * q) <= 1) | (F.abs(q - k * p) <= 1))
    start = F.slice(F.col("all"), 1, 0)
    taken = F.aggregate(
        F.filter(F.col("all"), lambda x: -x["s"] >= threshold),
        start,
        lambda got, x: F.when((F.size(got) >= most) | F.exists(got, lambda y: near(x["p"], y["p"])), got).otherwise(F.concat(got, F.array(x))),
    )
    chosen = F.when(F.size(taken) > 0, taken).otherwise(F.slice(F.col("all"), 1, 1))
    return ranked.select(*keys, F.posexplode(chosen).alias("i", "x")).select(*keys, (F.col("i") + 1).alias("place"), F.col("x.p").alias("period"), (-F.col("x.s")).alias("score"))


def periodogram(df: DataFrame, column: str, periods: list[int], order: list[str], keys: list[str]) -> DataFrame:
    """(keys, period, power): the share of the variance that a sine of that period explains.

    One aggregation of products with sines and cosines of the row's position; a
    position comes from running sums, so one endless series is no single task.
    """
    spots = running_before(df.select(*keys, *order, F.col(column).cast("double").alias("__x")), [*keys, *order], {"__t": F.lit(1).cast("long")})
    ends = spots.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("__x").alias("__m"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    x, t = F.col("__x") - F.col("__m"), F.col("__t")
    turn = lambda p: 2 * math.pi * (t % p) / p  # noqa: E731  phases cancel, so any start will do
    sums = [F.struct(F.lit(p).alias("period"), (F.pow(F.sum(x * F.cos(turn(p))), F.lit(2)) + F.pow(F.sum(x * F.sin(turn(p))), F.lit(2))).alias("c")) for p in periods]
    found = spots.join(F.broadcast(ends) if not keys else ends, on).groupBy(*keys).agg(F.array(*sums).alias("m"), F.sum(x * x).alias("__v"), F.count("__x").alias("__n"))
    flat = found.select(*keys, "__v", "__n", F.inline("m"))
    scale = F.when(F.col("period") == 2, 1.0).otherwise(2.0)
    return flat.select(*keys, "period", (scale * F.col("c") / F.col("__n") / F.nullif(F.col("__v"), F.lit(0.0))).alias("power"))


def spectral_periods(df: DataFrame, column: str, order: list[str], keys: list[str], most: int = 3, longest: int = 50, threshold: float = 0.05) -> DataFrame:
    """(keys, place, period, score) as ``seasonal_periods``, by the share of variance in the periodogram."""
    power = periodogram(df, column, list(range(2, longest + 1)), order, keys).where("power is not null")
    return _spread(power.select(*keys, "period", F.col("power").alias("score")), keys, most, threshold)


def linear_trend(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    """Adds ``trend`` (least squares over row position) and ``detrended``; null keys are a series too."""
    t = (F.row_number().over(_w(keys, order)) - 1).cast("double")
    rows = df.withColumn("__t", t)
    fit = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.regr_slope(F.col(column).cast("double"), "__t").alias("__s"), F.regr_intercept(F.col(column).cast("double"), "__t").alias("__i"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(fit, on).withColumn("trend", F.col("__i") + F.col("__s") * F.col("__t")).withColumn("detrended", F.col(column) - F.col("trend")).drop("__t", "__s", "__i", *[f"__{k}" for k in keys])


def infer_frequency(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """(keys, frequency) from the first gap: H, D, W, M, Y or IRREGULAR."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    first = df.withColumns({"__n": F.row_number().over(w), "__g": gap}).where("__n = 1")
    g = F.col("__g")
    return first.select(*keys, F.when(g == 1, "H").when(g == 24, "D").when(g == 168, "W").when(g.between(672, 744), "M").when(g.between(8760, 8784), "Y").otherwise("IRREGULAR").alias("frequency"))


def _arima(x: np.ndarray, p: int, d: int, q: int) -> dict:
    """Of one series: differenced d times, AR coefficients by Yule-Walker, MA terms on past residuals."""
    lasts, y = [], x
    for _ in range(d):
        lasts.append(y[-1] if len(y) else 0.0)
        y = np.diff(y)
    mean = y.mean() if len(y) else 0.0
    z = y - mean
    c = np.array([(z[: len(z) - k] * z[k:]).sum() for k in range(p + 1)]) if len(z) > p else np.zeros(p + 1)
    phi = np.linalg.lstsq(np.array([[c[abs(i - j)] for j in range(p)] for i in range(p)]), c[1:], rcond=None)[0] if p and c[0] > 0 else np.zeros(p)
    theta = np.array([0.3 * 0.7**i for i in range(q)])
    e = np.zeros(len(z))
    for t in range(len(z)):
        ar = sum(phi[i] * z[t - 1 - i] for i in range(min(p, t)))
        e[t] = z[t] - ar - sum(theta[i] * e[t - 1 - i] for i in range(min(q, t)))
    return {"lasts": lasts, "mean": mean, "z": z, "phi": phi, "theta": theta, "e": e}


def arima_forecast(df: DataFrame, column: str, p: int, d: int, q: int, horizon: int, order: list[str], keys: list[str], confidence: float = 0.95) -> DataFrame:
    """(keys, step, forecast, low, high): point forecasts with bounds of the given confidence, which widen with the root of the step."""
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["step int, forecast double, low double, high double"])
    width = 1.96 if confidence == 0.95 else NormalDist().inv_cdf(0.5 + confidence / 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _arima(pdf.sort_values(order, kind="stable")[column].dropna().to_numpy(dtype=float), p, d, q)
        phi, theta, e = m["phi"], m["theta"], m["e"]
        s = e.std() if len(e) else 0.0
        zs, es, out = list(m["z"]), list(e), []
        for _ in range(horizon):
            v = sum(phi[i] * zs[-1 - i] for i in range(min(p, len(zs)))) + sum(theta[i] * es[-1 - i] for i in range(min(q, len(es))))
            zs.append(v)
            es.append(0.0)
            out.append(v + m["mean"])
        f = np.array(out)
        for last in reversed(m["lasts"]):
            f = last + np.cumsum(f)
        half = width * s * np.sqrt(np.arange(1, horizon + 1))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "step": np.arange(1, horizon + 1), "forecast": f, "low": f - half, "high": f + half})[[*keys, "step", "forecast", "low", "high"]]

    return df.select(*keys, *order, column).groupBy(*keys).applyInPandas(run, schema)


def arima_diagnostics(df: DataFrame, column: str, p: int, d: int, q: int, order: list[str], keys: list[str], lags: int = 5) -> DataFrame:
    """(keys, n, sigma2, log_likelihood, aic, bic, ljung_box, jarque_bera) of the residuals; null where they are constant or absent.

    The likelihood is the normal one of the residuals around 0; p + q + 1 parameters are counted.
    """
    names = ["n", "sigma2", "log_likelihood", "aic", "bic", "ljung_box", "jarque_bera"]
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["n long"] + [f"{c} double" for c in names[1:]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = _arima(pdf.sort_values(order, kind="stable")[column].dropna().to_numpy(dtype=float), p, d, q)["e"]
        n, out = len(e), dict.fromkeys(names)
        out["n"], c = n, e - e.mean() if n else e
        s2, v = float((e**2).mean()) if n else 0.0, float((c**2).mean()) if n else 0.0
        if s2 > 0 and v > 0:
            like = -0.5 * n * (math.log(2 * math.pi * s2) + 1)
            r = [float((c[: n - k] * c[k:]).sum() / (n * v)) for k in range(1, min(lags, n - 1) + 1)]
            skew, kurtosis = float((c**3).mean() / v**1.5), float((c**4).mean() / v**2)
            out |= {"sigma2": s2, "log_likelihood": like, "aic": 2 * (p + q + 1) - 2 * like, "bic": (p + q + 1) * math.log(n) - 2 * like}
            out |= {"ljung_box": n * (n + 2) * sum(x * x / (n - k) for k, x in enumerate(r, 1)), "jarque_bera": n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{c: [out[c]] for c in names}})[[*keys, *names]]

    return df.select(*keys, *order, column).groupBy(*keys).applyInPandas(run, schema)


def date_range(spark, start: str, end: str, every: str = "1 day") -> DataFrame:
    """(ts) from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {every}"))).alias("ts"))


def slice_by_time(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def period_of(c: Column, frequency: str) -> Column:
    return F.date_trunc({"D": "day", "W": "week", "M": "month", "Y": "year", "H": "hour"}[frequency], c)
