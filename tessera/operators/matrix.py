"""Matrices as long tables (i, j, v): products, norms and solvers as joins and aggregations.

Absent cells are zero, so dense and sparse matrices are the same thing. Vectors
are tables (i, v). Only results of a fixed small size reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_dir


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    cells = [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    return spark.createDataFrame(cells, "i long, j long, v double")


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diagonal(vector: DataFrame) -> DataFrame:
    return vector.select("i", F.col("i").alias("j"), "v")


def random_sparse(spark: SparkSession, rows: int, cols: int, density: float, seed: int = 0) -> DataFrame:
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("i"), (F.col("id") % cols).alias("j"), F.rand(seed).alias("__u"), F.rand(seed + 1).alias("v"))
    return cells.where(F.col("__u") < density).drop("__u")


def sum_duplicates(a: DataFrame) -> DataFrame:
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    return sum_duplicates(a.unionByName(b.withColumn("v", F.col("v") * sign))).where("v <> 0")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * by)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("__j"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("__j").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    right = x.select(F.col("i").alias("k"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.withColumnRenamed("v", "w"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0))).first()[0]


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))


def norm(a: DataFrame, kind: str = "fro") -> DataFrame:
    """fro, 1 (largest column sum), inf (largest row sum) or max."""
    v = F.abs("v")
    if kind == "fro":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("value"))
    if kind == "max":
        return a.agg(F.max(v).alias("value"))
    return a.groupBy("j" if kind == "1" else "i").agg(F.sum(v).alias("s")).agg(F.max("s").alias("value"))


def density(a: DataFrame, rows: int, cols: int) -> DataFrame:
    return a.where("v <> 0").agg(F.count("*").alias("nnz"), (F.count("*") / float(rows * cols)).alias("density"))


def _axpy(x: DataFrame, y: DataFrame, k: float) -> DataFrame:
    """x + k y."""
    return x.unionByName(y.withColumn("v", F.col("v") * k)).groupBy("i").agg(F.sum("v").alias("v"))


def conjugate_gradient(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, most: int = 50, jacobi: bool = False) -> DataFrame:
    """Solves a x = b for a symmetric positive definite matrix, to |b - a x| <= tolerance |b|.

    Raises ArithmeticError with the residual if ``most`` steps do not reach
    that; rounding makes ill-conditioned systems take more steps than rows.
    Vectors of up to 4,096 entries are kept on the driver, one job a step;
    longer ones are tables and checkpointed.
    """
    a = _kept(a)
    times, inner, axpy, smooth, b, table = _on_driver(a, b) or _as_tables(a, b)
    if not jacobi:
        smooth = lambda r: r
    r, x = b, axpy(b, b, -1.0)
    goal, true = tolerance**2 * max(inner(b, b), 1e-300), True
    z = smooth(r)
    p, rz = z, inner(r, z)
    for step in range(most + 1):
        left = inner(r, r)
        if left <= goal and not true:
            # The recurrence drifts from the residual of x, which is what counts; go on from that.
            r, true = axpy(b, times(x), -1.0), True
            left, z = inner(r, r), smooth(r)
            p, rz = z, inner(r, z)
        if left <= goal:
            return table(x)
        if step == most:
            break
        ap = times(p)
        curve = inner(p, ap)
        if not curve > 0:
            raise ArithmeticError("the matrix is not positive definite")
        alpha = rz / curve
        x, r, true = axpy(x, p, alpha), axpy(r, ap, -alpha), False
        z = smooth(r)
        new = inner(r, z)
        p = axpy(z, p, new / rz)
        rz = new
    raise ArithmeticError(f"relative residual {(left / max(inner(b, b), 1e-300)) ** 0.5:.3g} after {most} steps, not {tolerance:.3g}")


def _as_tables(a: DataFrame, b: DataFrame):
    """Product, inner product, x + k y, Jacobi's smoother, b and the way back, for vectors as tables."""
    inverse = a.where((F.col("i") == F.col("j")) & (F.col("v") != 0)).groupBy("i").agg((1 / F.sum("v")).alias("w"))
    smooth = lambda r: r.join(inverse, "i").select("i", (F.col("v") * F.col("w")).alias("v"))
    return lambda p: _kept(spmv(a, p)), dot, lambda x, y, k: _kept(_axpy(x, y, k)), smooth, b, lambda x: x


def _on_driver(a: DataFrame, b: DataFrame, most: int = 4096):
    """The same for numpy vectors over the indices of a and b; None if there are more than ``most``."""
    ids = sorted(r[0] for r in a.select("i").union(b.select("i")).distinct().limit(most + 1).collect())
    if len(ids) > most:
        return None
    at = {i: n for n, i in enumerate(ids)}

    def vector(rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(ids))
        for i, v in rows.select("i", "v").collect():
            out[at[i]] += v
        return out

    table = lambda x: a.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(ids, x, strict=True)], "i long, v double")
    main = vector(a.where("i = j"))
    inverse = np.divide(1.0, main, out=np.zeros(len(ids)), where=main != 0)
    return lambda p: vector(spmv(a, F.broadcast(table(p)))), lambda x, y: float(x @ y), lambda x, y, k: x + k * y, lambda r: r * inverse, vector(b), table


def _kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_dir(df.sparkSession)  # raises if a cluster names none
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bicgstab(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """Solves a x = b for any regular matrix by stabilised biconjugate gradients, to |b - a x| <= tolerance |b|.

    Raises ArithmeticError on breakdown or if ``most`` steps do not reach that. Vectors as in ``conjugate_gradient``.
    """
    a = _kept(a)
    times, inner, axpy, _, b, table = _on_driver(a, b) or _as_tables(a, b)
    goal = tolerance**2 * max(inner(b, b), 1e-300)
    r = shadow = p = b
    x, rho = axpy(b, b, -1.0), inner(b, b)
    for _ in range(most):
        if inner(r, r) <= goal:
            r = axpy(b, times(x), -1.0)
            if inner(r, r) <= goal:
                return table(x)
            shadow, p, rho = r, r, inner(r, r)  # the recurrence drifted; go on from the residual itself
        v = times(p)
        down = inner(shadow, v)
        if down == 0 or rho == 0:
            raise ArithmeticError("biconjugate gradients broke down")
        alpha = rho / down
        half = axpy(r, v, -alpha)
        t = times(half)
        size = inner(t, t)
        omega = inner(t, half) / size if size > 0 else 0.0
        x = axpy(axpy(x, p, alpha), half, omega)
        r = axpy(half, t, -omega)
        new = inner(shadow, r)
        p = axpy(r, axpy(p, v, -omega), new / rho * alpha / omega) if omega else r
        rho = new if omega else inner(shadow, r)
    r = axpy(b, times(x), -1.0)
    if inner(r, r) <= goal:
        return table(x)
    raise ArithmeticError(f"relative residual {(inner(r, r) / max(inner(b, b), 1e-300)) ** 0.5:.3g} after {most} steps, not {tolerance:.3g}")


def gmres(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, restart: int = 30, most: int = 10) -> DataFrame:
    """Solves a x = b for any regular matrix by restarted minimal residuals, to |b - a x| <= tolerance |b|.

    Each of ``most`` restarts keeps ``restart`` basis vectors; the small least squares problem is numpy's.
    Raises ArithmeticError with the residual if that is not enough. Vectors as in ``conjugate_gradient``.
    """
    a = _kept(a)
    times, inner, axpy, _, b, table = _on_driver(a, b) or _as_tables(a, b)
    size, x = inner(b, b) ** 0.5, axpy(b, b, -1.0)
    for _ in range(most + 1):
        r = axpy(b, times(x), -1.0)
        left = inner(r, r) ** 0.5
        if left <= tolerance * max(size, 1e-150):
            return table(x)
        basis, h = [axpy(axpy(r, r, -1.0), r, 1 / left)], np.zeros((restart + 1, restart))
        for k in range(restart):
            w = times(basis[k])
            for i, q in enumerate(basis):
                h[i, k] = inner(q, w)
                w = axpy(w, q, -h[i, k])
            h[k + 1, k] = inner(w, w) ** 0.5
            y = np.linalg.lstsq(h[: k + 2, : k + 1], np.eye(k + 2)[0] * left, rcond=None)[0]
            short = np.linalg.norm(h[: k + 2, : k + 1] @ y - np.eye(k + 2)[0] * left)
            if short <= 0.5 * tolerance * size or h[k + 1, k] <= 1e-14 * left:
                break
            basis.append(axpy(axpy(w, w, -1.0), w, 1 / h[k + 1, k]))
        for q, weight in zip(basis, y, strict=False):
            x = axpy(x, q, float(weight))
    raise ArithmeticError(f"relative residual {left / max(size, 1e-150):.3g} after {most} restarts, not {tolerance:.3g}")


def power_iteration(a: DataFrame, n: int, steps: int = 30) -> tuple[float, DataFrame]:
    """The eigenvalue of largest magnitude and its vector."""
    x = a.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n**0.5).alias("v"))
    value = 0.0
    for _ in range(steps):
        y = _kept(spmv(a, x))
        value = dot(x, y)
        size = dot(y, y) ** 0.5
        if size == 0:
            break
        x = scale(y, 1 / size)
    return value, x


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """X'X of the columns as (i, j, v): one aggregation however many rows there are."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cells = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias("v")) for i, j in pairs]
    half = df.agg(F.array(*cells).alias("m")).select(F.inline("m"))
    return half.unionByName(transpose(half.where("i <> j")))


def small(a: DataFrame, n: int, m: int, most: int = 4096) -> np.ndarray:
    """A matrix of at most ``most`` rows and columns as a numpy array, for factorisations of small results."""
    if max(n, m) > most:
        raise ValueError(f"at most {most} rows and columns can be factorised on the driver")
    out = np.zeros((n, m))
    for i, j, v in a.where((F.col("i") < n) & (F.col("j") < m)).collect():
        out[i, j] += v
    return out


def factorise(a: DataFrame, n: int, kind: str) -> dict[str, DataFrame]:
    """lu, qr, chol, svd or inverse of a small square matrix, as tables."""
    m, spark = small(a, n, n), a.sparkSession
    back = lambda x: from_rows(spark, np.atleast_2d(x).tolist())
    if kind == "qr":
        q, r = np.linalg.qr(m)
        return {"q": back(q), "r": back(r)}
    if kind == "chol":
        return {"l": back(np.linalg.cholesky(m))}
    if kind == "svd":
        u, s, v = np.linalg.svd(m)
        return {"u": back(u), "s": back(np.diag(s)), "vt": back(v)}
    if kind == "inverse":
        return {"inverse": back(np.linalg.inv(m))}
    p, low, up = np.arange(n), np.eye(n), m.copy()
    for k in range(n):
        top = k + int(np.abs(up[k:, k]).argmax())
        if top != k:
            up[[k, top]], p[[k, top]] = up[[top, k]], p[[top, k]]
            low[[k, top], :k] = low[[top, k], :k]
        for i in range(k + 1, n):
            low[i, k] = up[i, k] / up[k, k] if up[k, k] else 0.0
            up[i] -= low[i, k] * up[k]
    return {"p": back(np.eye(n)[p]), "l": back(low), "u": back(up)}


def invariants(a: DataFrame, n: int) -> DataFrame:
    """One row (determinant, log_abs_determinant, rank, condition) of a small square matrix; condition is infinite for a singular one."""
    m = small(a, n, n)
    size = np.linalg.svd(m, compute_uv=False)
    rank = int((size > (size[0] if n else 0.0) * n * np.finfo(float).eps).sum())
    condition = float(size[0] / size[-1]) if n and size[-1] > 0 else float("inf")
    row = (float(np.linalg.det(m)), float(np.linalg.slogdet(m)[1]), rank, condition)
    return a.sparkSession.createDataFrame([row], "determinant double, log_abs_determinant double, rank int, condition double")


def solve(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Small dense systems, least squares if singular."""
    m, rhs = small(a, n, n), np.zeros(n)  # small() checks the size
    for i, v in b.where((F.col("i") >= 0) & (F.col("i") < n)).groupBy("i").agg(F.sum("v")).collect():
        rhs[i] = v
    x = np.linalg.lstsq(m, rhs, rcond=None)[0]
    return a.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


def fft(df: DataFrame, order: str, value: str, keys: list[str], inverse: bool = False) -> DataFrame:
    """(keys, k, re, im) per series; forward unnormalised, inverse by 1/n. ``value`` is a double or struct<re, im>."""
    import pandas as pd

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + ["k long, re double, im double"])
    paired = df.schema[value].dataType.typeName() == "struct"
    rows = df.select(*keys, order, *([F.col(f"{value}.re").alias("re"), F.col(f"{value}.im").alias("im")] if paired else [F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im")]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "k": np.arange(len(y)), "re": y.real, "im": y.imag})[[*keys, "k", "re", "im"]]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def rfft(df: DataFrame, order: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, k, re, im) for k up to half the length: what determines the transform of a real series."""
    n = df.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.count("*").alias("__n"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    whole = fft(df, order, value, keys)
    joined = whole.join(n, on) if keys else whole.crossJoin(F.broadcast(n))  # one row
    return joined.where(2 * F.col("k") <= F.col("__n")).select(*keys, "k", "re", "im")


def fft2(a: DataFrame, inverse: bool = False) -> DataFrame:
    """(i, j, re, im) of a full matrix (i, j, v): transforms of the rows, then of the columns; a task holds one row or column."""
    rows = fft(a, "j", "v", ["i"], inverse).select("i", F.col("k").alias("j"), F.struct("re", "im").alias("v"))
    return fft(rows, "i", "v", ["j"], inverse).select(F.col("k").alias("i"), "j", "re", "im")


def monte_carlo(spark: SparkSession, f, bounds: list[tuple[float, float]], samples: int, seed: int = 0) -> DataFrame:
    """(value, std_error): the integral of a column function of the coordinates over a box."""
    volume = 1.0
    coords = []
    for d, (a, b) in enumerate(bounds):
        volume *= b - a
        coords.append(F.lit(a) + F.rand(seed + d) * (b - a))
    drawn = spark.range(samples).select(*[c.alias(f"x{d}") for d, c in enumerate(coords)])
    y = f(*[F.col(f"x{d}") for d in range(len(bounds))])
    return drawn.agg((F.avg(y) * volume).alias("value"), (F.stddev_samp(y) / F.sqrt(F.count("*")) * volume).alias("std_error"))
