"""Tall matrices: QR in a tree, and least squares, singular values and principal components from its R.

Rows are never multiplied with each other, so the condition number is not
squared as it is by normal equations. A task keeps one triangle of columns x
columns; triangles are merged FAN at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.math import missing
from tessera.sources.scratch import written

#: Rows reduced at a time, triangles merged at a time, and columns at most (a triangle of 32 MB).
ROWS, FAN, MOST_COLUMNS = 4_096, 16, 2_000


def _triangle(a: np.ndarray) -> np.ndarray:
    """R with a diagonal that is not negative, square also for few rows."""
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((max(0, a.shape[1] - len(r)), a.shape[1]))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_qr(df: DataFrame, columns: list[str], intercept: bool = False, less: list[float] | None = None) -> np.ndarray:
    """R of the rows that have all values (columns x columns, with ``intercept`` a column of ones first), less ``less`` if given."""
    width = len(columns) + intercept
    if not 1 <= width <= MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns are needed")
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~missing(F.col(c))
    read = df.where(ok).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    off = np.zeros(len(columns)) if less is None else np.array(less)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - off
            x = np.column_stack([np.ones(len(x)), x]) if intercept else x
            for i in range(0, len(x), ROWS):
                r = _triangle(np.vstack([r, x[i : i + ROWS]]))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["part", "r"])

    def merge(key, table):
        r = np.vstack([np.frombuffer(x).reshape(width, width) for x in table.column("r").to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_triangle(r).tobytes()])})

    parts, found = read.rdd.getNumPartitions(), read.mapInArrow(reduce, "part long, r binary")
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(merge, "part long, r binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            break
        found = written(found, "triangles")
    rows = found.collect()  # one triangle
    return np.frombuffer(rows[0]["r"]).reshape(width, width).copy() if rows else np.zeros((width, width))


def tall_regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient, std_error, t, r2) as ``linear_regression``, from a QR: right where columns nearly depend on each other. Columns that do, raise."""
    rows = df.where(~missing(F.col(y)))
    n = rows.where(~F.exists(F.array(*[missing(F.col(x)) for x in xs]), lambda m: m)).count() if xs else rows.count()
    r = tall_qr(rows, [*xs, y], intercept=True)
    a, b = r[:-1, :-1], r[:-1, -1]
    if not n or np.abs(np.diag(a)).min() <= np.abs(a).max() * np.finfo(float).eps:
        raise ValueError("the columns depend on each other")
    beta = np.linalg.solve(a, b)
    rss, tss = r[-1, -1] ** 2, (r[1:, -1] ** 2).sum()
    inverse = np.linalg.solve(a, np.eye(len(a)))
    se = np.sqrt((inverse**2).sum(axis=1) * rss / max(1.0, n - len(beta)))
    r2 = float(1 - rss / tss) if tss > 0 else float("nan")
    found = [(t, float(c), float(s), float(c / s) if s > 0 else None, r2) for t, c, s in zip(["intercept", *xs], beta, se, strict=True)]
    return df.sparkSession.createDataFrame(found, "term string, coefficient double, std_error double, t double, r2 double")


def singular_values(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Of the matrix of these columns, the largest first."""
    return np.linalg.svd(tall_qr(df, columns), compute_uv=False)


def orthonormal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds q1, q2, ...: the rows times the inverse of R, columns of length 1 at right angles."""
    r = tall_qr(df, columns)
    inverse = np.linalg.solve(r, np.eye(len(r)))
    return df.withColumns({f"q{j + 1}": sum((F.col(c) * float(inverse[i, j]) for i, c in enumerate(columns) if i <= j), F.lit(0.0)) for j in range(len(columns))})


class Components(NamedTuple):
    """A fitted PCA: means, components as rows (largest entry positive), variances and their shares."""

    columns: list[str]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    share: np.ndarray


def fit_components(df: DataFrame, columns: list[str], k: int | None = None) -> Components:
    """Of the rows that have all values, by the singular values of the centred columns' R."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~missing(F.col(c))
    row = df.where(ok).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if row["n"] < 2:
        raise ValueError("two rows are needed")
    mean = [row[f"m{i}"] for i in range(len(columns))]
    s, v = np.linalg.svd(tall_qr(df, columns, less=mean))[1:]
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    variance = s**2 / (row["n"] - 1)
    k = k or len(columns)
    return Components(columns, np.array(mean), v[:k], variance[:k], variance[:k] / max(variance.sum(), 1e-300))


def to_components(df: DataFrame, model: Components) -> DataFrame:
    """Adds pc1, pc2, ..."""
    off = [F.col(c) - float(m) for c, m in zip(model.columns, model.mean, strict=True)]
    return df.withColumns({f"pc{i + 1}": sum((x * float(w) for x, w in zip(off, row, strict=True)), F.lit(0.0)) for i, row in enumerate(model.components)})


def from_components(df: DataFrame, model: Components, suffix: str = "_back") -> DataFrame:
    """Adds <column>_back: what pc1, pc2, ... say of each column."""
    return df.withColumns({f"{c}{suffix}": sum((F.col(f"pc{j + 1}") * float(model.components[j, i]) for j in range(len(model.components))), F.lit(float(model.mean[i]))) for i, c in enumerate(model.columns)})
