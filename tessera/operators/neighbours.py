"""Centres and neighbours: starts of k-means by D2 sampling, and exact k nearest rows by pivots.

All random choices are hashed from the seed, the round and the row's key, so a
run can be repeated anywhere, in SQL too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import missing
from tessera.sources.scratch import written

#: Rounds of k-means||, and candidates a round and wanted centre.
ROUNDS, OVERSAMPLE = 5, 2
#: Pivots at most; their distances to a row are one array column.
MOST_PIVOTS = 256
#: Rings that the rows of a pivot are dealt into by their distance from it.
RINGS = 32


def uniform(key: str, seed: int, turn: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed:turn:key."""
    h = F.md5(F.concat(F.lit(f"{seed}:{turn}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def distance(a: Column, b: Column, metric: str = "squared") -> Column:
    """squared (euclidean, without the root), euclidean or manhattan distance of two arrays."""
    part = F.zip_with(a, b, lambda x, y: F.abs(x - y) if metric == "manhattan" else (x - y) * (x - y))
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total) if metric == "euclidean" else total


def distances(x: Column, centres: list[list[float]], metric: str = "squared") -> Column:
    """Array of the distances to every centre; the centres stand in the plan."""
    all_ = F.lit([float(v) for c in centres for v in c])
    width = len(centres[0])
    return F.transform(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda i: distance(x, F.slice(all_, i * width + 1, F.lit(width)), metric))


def nearest_centre(rows: DataFrame, centres: list[list[float]], *kept: str) -> DataFrame:
    """``kept`` columns, the vector's values as __x0, __x1, ..., and of the centre nearest to ``__x`` the squared distance as __d and the place as __i (the first of equal ones).

    In numpy by batch; values go to Python one a column, as arrays are slow to hand over.
    """
    c = np.array(centres, dtype=float)
    values = [f"__x{j}" for j in range(c.shape[1])]
    flat = rows.select(*kept, *[F.col("__x")[j].alias(v) for j, v in enumerate(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(v).to_numpy(zero_copy_only=False) for v in values]
            best, place = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, dtype=np.int32)
            for low in range(0, len(c), 64):  # a block of 64 centres at a time
                d = np.zeros((batch.num_rows, len(c[low : low + 64])))
                for j, v in enumerate(x):
                    off = v[:, None] - c[None, low : low + 64, j]
                    d += off * off
                at = d.argmin(axis=1)
                least = d[np.arange(len(d)), at]
                closer = least < best
                best, place = np.where(closer, least, best), np.where(closer, at + low, place).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(place)], names=[*batch.schema.names, "__d", "__i"])

    return flat.mapInArrow(run, type(flat.schema)(list(flat.schema.fields)).add("__d", "double").add("__i", "integer"))


def spread(df: DataFrame) -> DataFrame:
    """A part a core at least: a table of few files would keep few cores busy in every round over it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _complete(df: DataFrame, columns: list[str], key: str, *more: Column) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~missing(F.col(c))
    return df.where(ok).select(F.col(key), vector(columns).alias("__x"), *more)


def _gathered(rows: DataFrame) -> Column:
    """The vector of rows from ``nearest_centre``."""
    return F.array(*[F.col(f"__x{j}") for j in range(sum(c.startswith("__x") for c in rows.columns))]).alias("__x")


def start_centres(df: DataFrame, columns: list[str], k: int, key: str, seed: int = 0, method: str = "parallel") -> list[list[float]]:
    """``k`` start centres of k-means among the rows with all values; fewer if there are fewer different rows.

    ``parallel``: k-means||, five rounds that each take about 2 k rows with
    probability in proportion to their squared distance from the candidates so
    far; the candidates, weighted by the rows nearest to them, are clustered on
    the driver (about 10 k rows whatever the input). ``plusplus``: k-means++,
    one exact D2 draw a pass. ``random``: the ``k`` rows of least hash.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = written(spread(_complete(df, columns, key)), "points")
    if method == "random":
        return [r["__x"] for r in rows.dropDuplicates(["__x"]).orderBy(uniform(key, seed, 0), key).limit(k).collect()]
    if method == "plusplus":
        return [r["__x"] for r in d2_draws(rows, k, key, seed)]
    if method != "parallel":
        raise ValueError("method must be parallel, plusplus or random")
    candidates = d2_candidates(rows, k, key, seed)
    if not candidates:
        return []
    weights = nearest_centre(rows, candidates).groupBy(F.col("__i").alias("i")).agg(F.count("*").alias("n"))
    n = np.zeros(len(candidates))
    for r in weights.collect():  # a row a candidate at most
        n[r["i"]] = r["n"]
    return _reduced(np.array(candidates), n, k, seed).tolist()


def d2_draws(rows: DataFrame, k: int, key: str, seed: int) -> list:
    """Rows (key, __x) drawn one after another in proportion to their squared distance from those before: the least -ln(u) / d2 wins."""
    first = rows.orderBy(uniform(key, seed, 0), key).limit(1).collect()
    chosen = list(first)
    while first and len(chosen) < k:
        away = nearest_centre(rows, [r["__x"] for r in chosen], key)
        race = away.where("__d > 0").select(key, _gathered(away), (-F.log(uniform(key, seed, len(chosen))) / F.col("__d")).alias("__race"))
        best = race.agg(F.min(F.struct("__race", key, "__x")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
    return chosen


def d2_candidates(rows: DataFrame, k: int, key: str, seed: int, rounds: int = ROUNDS) -> list[list[float]]:
    """The candidates of k-means||: the row of least hash, then all rows with u < 2 k d2 / sum of d2, round by round."""
    found = [r["__x"] for r in rows.orderBy(uniform(key, seed, 0), key).limit(1).collect()]
    for turn in range(1, rounds + 1 if found else 1):
        away = nearest_centre(rows, found, key)
        cost = away.agg(F.sum("__d")).first()[0]
        if not cost:
            break
        drawn = away.where(uniform(key, seed, turn) < float(OVERSAMPLE * k) * F.col("__d") / float(cost)).select(_gathered(away)).distinct()
        found += [r["__x"] for r in drawn.orderBy("__x").collect()]  # 2 k expected
    return found


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted greedy k-means++ and Lloyd over the few candidates."""
    rng = np.random.default_rng(seed)
    tries = 2 + int(math.log(k))
    chosen = [int(np.argmax(weights))]
    d = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(points)) and (weights * d).sum() > 0:
        p = weights * d / (weights * d).sum()
        asked = rng.choice(len(points), size=tries, p=p)
        after = [np.minimum(d, ((points - points[i]) ** 2).sum(axis=1)) for i in asked]
        best = int(np.argmin([(weights * a).sum() for a in after]))
        chosen.append(int(asked[best]))
        d = after[best]
    centres = points[chosen].astype(float)
    for _ in range(50):
        near = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(points[near == i], axis=0, weights=weights[near == i]) if weights[near == i].sum() > 0 else c for i, c in enumerate(centres)])
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = new
    return centres


def within_cost(df: DataFrame, columns: list[str], centres: list[list[float]]) -> float:
    """Sum of squared distances of all complete rows to their nearest centre."""
    rows = df.where(~F.array_contains(F.transform(vector(columns), lambda x: missing(x)), True))
    return float(rows.agg(F.sum(F.array_min(distances(vector(columns), centres)))).first()[0] or 0.0)


def nearest_rows(asked: DataFrame, donors: DataFrame, features: list[str], key: str, k: int, metric: str = "euclidean", value: str | None = None, pivots: int | None = None) -> DataFrame:
    """(asked key as __k, its features as __x, donor key as __dk, the donor's ``value`` as __v, __d, __r): the ``k`` donors nearest to each asked row, exactly, ties by donor key, then value.

    Donors go to their nearest pivot and into rings by their distance from it.
    First an asked row meets the donors of its own pivot's ring, which bounds
    how far its k-th donor can be; then only those rings that the triangle
    inequality leaves open. Both are equi-joins on (pivot, ring). Equal donors
    beyond k and equal asked rows are settled once. Rows that lack a feature
    neither ask nor give. Squared distances are returned for ``euclidean``.
    """
    exact = "squared" if metric == "euclidean" else metric
    width = RINGS
    ask = written(_complete(asked, features, key).withColumnRenamed(key, "__k").distinct(), "asked")
    held = F.col(value).cast("double") if value else F.lit(None).cast("double")
    give = _complete(donors, features, key, held.alias("__v")).withColumnRenamed(key, "__dk")
    same = Window.partitionBy("__x").orderBy("__dk", "__v")
    give = written(give.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k).drop("__n"), "donors")
    n = give.count()
    if not n:
        return ask.select("__k", "__x", F.lit(None).cast(give.schema["__dk"].dataType).alias("__dk"), F.lit(None).cast("double").alias("__v"), F.lit(None).cast("double").alias("__d"), F.lit(1).alias("__r")).limit(0)
    pivots = pivots or max(1, min(MOST_PIVOTS, math.isqrt(n) // 2))
    centres = [r["__x"] for r in give.select("__x").distinct().orderBy(F.md5(F.to_json("__x").cast("binary"))).limit(pivots).collect()]
    placed = give.withColumn("__a", distances(F.col("__x"), centres, metric))
    placed = placed.select("__dk", "__v", "__x", F.array_min("__a").alias("__p"), (F.array_position("__a", F.array_min("__a")) - 1).cast("int").alias("__cell"))
    placed = written(placed, "cells")
    stats = {r["__cell"]: (r["n"], r["low"], r["high"]) for r in placed.groupBy("__cell").agg(F.count("*").alias("n"), F.min("__p").alias("low"), F.max("__p").alias("high")).collect()}  # a row a pivot
    count, low, high = ([float(stats.get(i, (0, 0.0, 0.0))[j]) for i in range(len(centres))] for j in range(3))
    ring = lambda p, cell: F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor((p - F.get(F.lit(low), cell)) / F.nullif(F.get(F.lit(high), cell) - F.get(F.lit(low), cell), F.lit(0.0)) * width)))
    placed = placed.withColumn("__ring", F.coalesce(ring(F.col("__p"), F.col("__cell")), F.lit(0)).cast("int"))

    # A first bound from the pivots alone: cells in order of their farthest possible donor, until k donors are in.
    questions = ask.select("__x").distinct().withColumn("__a", distances(F.col("__x"), centres, metric))
    reach = F.array_sort(F.transform(F.col("__a"), lambda a, i: F.struct((a + F.get(F.lit(high), i)).alias("far"), F.get(F.lit(count), i).alias("n"))))
    bound = F.aggregate(
        reach,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("far")),
        lambda s, x: F.when((s["n"] >= k) | (x["n"] == 0), s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), x["far"].alias("far"))),
        lambda s: F.when(s["n"] >= k, s["far"]).otherwise(F.lit(float("inf"))),
    )
    questions = written(questions.withColumn("__bound", bound), "questions")
    give_side = placed.select(F.col("__cell"), F.col("__ring"), F.col("__x").alias("__y"), "__dk", "__v")
    worst = lambda c: c * (1 + 1e-9) + 1e-12  # noqa: E731  rounding of sums of squares

    # Second bound: the k-th donor met in the rings around the asked row within its own cell.
    own = (F.array_position("__a", F.array_min("__a")) - 1).cast("int")
    home = questions.withColumns({"__cell": own}).withColumn("__at", F.coalesce(ring(F.array_min("__a"), F.col("__cell")), F.lit(0)).cast("int"))
    home = home.withColumn("__ring", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__at") - 1), F.least(F.lit(width - 1), F.col("__at") + 1))))
    met = home.join(give_side, ["__cell", "__ring"]).select("__x", distance(F.col("__x"), F.col("__y"), metric).alias("__e"), "__dk")
    closest = Window.partitionBy("__x").orderBy("__e", "__dk")
    kth = met.withColumn("__n", F.row_number().over(closest)).where(F.col("__n") <= k).groupBy("__x").agg(F.max("__e").alias("__kth"), F.count("*").alias("__met"))
    kth = kth.where(F.col("__met") >= k).select(F.col("__x").alias("__kx"), "__kth")
    bounded = questions.join(kth, F.col("__x") == F.col("__kx"), "left").withColumn("__bound", worst(F.least("__bound", F.coalesce("__kth", "__bound")))).drop("__kx", "__kth")
    bounded = written(bounded, "bounded")

    # All rings that can hold one of the k nearest.
    cells = F.filter(
        F.transform(F.col("__a"), lambda a, i: F.struct(i.alias("cell"), a.alias("a"))),
        lambda c: (F.get(F.lit(count), c["cell"]) > 0) & (c["a"] - F.get(F.lit(high), c["cell"]) <= F.col("__bound")) & (F.get(F.lit(low), c["cell"]) - c["a"] <= F.col("__bound")),
    )
    open_ = bounded.select("__x", "__bound", F.explode(cells).alias("c")).select("__x", "__bound", F.col("c.cell").alias("__cell"), F.col("c.a").alias("__a"))
    edge = lambda p: F.coalesce(ring(F.greatest(F.get(F.lit(low), F.col("__cell")), F.least(F.get(F.lit(high), F.col("__cell")), p)), F.col("__cell")), F.lit(0)).cast("int")
    rings = F.sequence(F.greatest(F.lit(0), edge(F.col("__a") - F.col("__bound")) - 1), F.least(F.lit(width - 1), edge(F.col("__a") + F.col("__bound")) + 1))
    open_ = open_.select("__x", "__bound", "__cell", F.explode(rings).alias("__ring"))
    pairs = open_.join(give_side, ["__cell", "__ring"]).select("__x", "__dk", "__v", distance(F.col("__x"), F.col("__y"), exact).alias("__d"))
    best = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("__x").orderBy("__d", "__dk", "__v"))).where(F.col("__r") <= k)
    return ask.join(best, "__x").select("__k", "__x", "__dk", "__v", "__d", "__r")
