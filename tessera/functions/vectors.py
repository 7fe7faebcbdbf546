"""Distances and small vector algebra on array<double> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(x: Column, y: Column) -> Column:
    """Both entries of each position, positions with a NaN or null left out."""
    both = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull() & ~F.isnan(p["a"]) & ~F.isnan(p["b"]))


def _sum(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, p: s + f(p))


def dot(x: Column, y: Column) -> Column:
    return _sum(_pairs(x, y), lambda p: p["a"] * p["b"])


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(_pairs(x, y), lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"])))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(_pairs(x, y), lambda p: F.abs(p["a"] - p["b"]))


def chebyshev(x: Column, y: Column) -> Column:
    return F.aggregate(_pairs(x, y), F.lit(0.0), lambda s, p: F.greatest(s, F.abs(p["a"] - p["b"])))


def minkowski(x: Column, y: Column, p: float) -> Column:
    return F.pow(_sum(_pairs(x, y), lambda q: F.pow(F.abs(q["a"] - q["b"]), F.lit(float(p)))), F.lit(1.0 / p))


def cosine_similarity(x: Column, y: Column) -> Column:
    return dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine_similarity(x, y)


def hamming(x: Column, y: Column) -> Column:
    """Positions that differ."""
    return _sum(_pairs(x, y), lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0))


def jaccard_similarity(x: Column, y: Column) -> Column:
    """Of the non-zero positions; 1 if both are all zero."""
    both = _sum(_pairs(x, y), lambda p: F.when((p["a"] != 0) & (p["b"] != 0), 1.0).otherwise(0.0))
    either = _sum(_pairs(x, y), lambda p: F.when((p["a"] != 0) | (p["b"] != 0), 1.0).otherwise(0.0))
    return F.when(either == 0, 1.0).otherwise(both / F.nullif(either, F.lit(0.0)))


def linspace(start: float, stop: float, n: int) -> Column:
    """Endpoint included."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * step)


def arange(start: float, stop: float, step: float = 1.0) -> Column:
    """Half-open."""
    n = max(0, -int(-(stop - start) // step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * step) if n else F.array().cast("array<double>")


def take(x: Column, places: list[int]) -> Column:
    """Entries at the given 0-based places, repeats allowed."""
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(x, i))


def put(x: Column, values: dict[int, float]) -> Column:
    """A copy with the entries at the given places replaced."""
    m = F.create_map(*[F.lit(v) for k, w in values.items() for v in (int(k), float(w))])
    return F.transform(x, lambda v, i: F.coalesce(F.element_at(m, i), v))
