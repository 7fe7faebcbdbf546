"""Monte Carlo integration over a table of boxes: hashed, antithetic and low-discrepancy points as columns, errors by sample size.

Each row of the table is an integral of its own. Points are made in chunks that
are dealt over the cluster, so one box with many points is no single task, and
no point leaves its task: only sums by box, repeat and checkpoint are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.generate import draw_uniform

#: Points that one row of a chunk makes.
CHUNK = 10_000
_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def radical_inverse(i: Column, base: int, most: int) -> Column:
    """The digits of ``i`` (below ``most``) in ``base`` mirrored at the point: the Halton sequence of that base."""
    out, power = F.lit(0.0), 1
    while power < most:
        out = out + (F.floor(i / F.lit(power)) % base).cast("double") / float(power * base)
        power *= base
    return out


def integrate(boxes: DataFrame, key: str, bounds: list[tuple[str, str]], f: Callable[..., Column], samples: int = 10_000, method: str = "halton", repeats: int = 8, seed: int = 0, sizes: list[int] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """(key, samples, value, std_error, low, high) for each box and sample size: the integral of ``f`` of the coordinates.

    ``bounds`` names the columns of the lower and upper end of each dimension.
    Methods: ``plain`` (hashed points, the error of a mean), ``antithetic`` (each
    hashed point with its mirror image, the error of pair means), ``halton``
    (``repeats`` randomly shifted copies of a low-discrepancy sequence of
    samples / repeats points, the error between their means; one repeat is the
    sequence itself, without an error). ``sizes`` are smaller numbers of samples
    to report as well, of the same points, to see how it converges. Points with
    a value that is null, NaN or infinite do not count. Boxes that lack an end or
    are empty have null results; repeated keys are one box each row's points of
    which are pooled, so keys should be distinct.
    """
    if method not in ("plain", "antithetic", "halton"):
        raise ValueError("method must be plain, antithetic or halton")
    if not 1 <= len(bounds) <= len(_PRIMES):
        raise ValueError(f"1 to {len(_PRIMES)} dimensions are possible")
    per = repeats if method == "halton" else 2 if method == "antithetic" else 1
    steps = max(1, samples // per)
    sizes = sorted({max(1, n // per) for n in [*(sizes or []), samples] if n <= samples})
    ends = [(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in bounds]
    flat = [F.array(*[a for a, _ in ends]).alias("lows"), F.array(*[b - a for a, b in ends]).alias("widths")]
    rows = boxes.select(F.col(key), *flat)
    good = F.forall("widths", lambda w: w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))) & F.forall("lows", lambda a: a.isNotNull())
    chunks = -(-steps // CHUNK)
    dealt = rows.where(good).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    dealt = dealt.repartition(key, "__chunk") if chunks > 1 else dealt
    first = F.col("__chunk").cast("long") * CHUNK
    points = dealt.withColumn("__i", F.explode(F.sequence(first + 1, F.least(first + CHUNK, F.lit(steps).cast("long")))))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if method == "halton":
        points = points.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        shift = lambda d: draw_uniform(name, seed, F.col("__r") * len(bounds) + d)
        spot = lambda d: radical_inverse(F.col("__i"), _PRIMES[d], steps + 1)
        u = [spot(d) if repeats == 1 else (spot(d) + shift(d)) % 1.0 for d in range(len(bounds))]
    else:
        points = points.withColumn("__r", F.lit(0))
        u = [draw_uniform(F.concat(name, F.lit(":"), F.col("__i").cast("string")), seed, d) for d in range(len(bounds))]
    at = lambda v: f(*[F.get("lows", F.lit(d)) + v[d] * F.get("widths", F.lit(d)) for d in range(len(bounds))]).cast("double")
    finite = lambda y: F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)
    volume = F.aggregate("widths", F.lit(1.0), lambda s, w: s * w)
    points = points.withColumns({f"__u{d}": x for d, x in enumerate(u)})
    u = [F.col(f"__u{d}") for d in range(len(bounds))]
    value = finite(at(u)) if method != "antithetic" else (finite(at(u)) + finite(at([1 - x for x in u]))) / 2
    points = points.select(key, "__r", "__i", (value * volume).alias("__y"))
    part = lambda n: F.when(F.col("__i") <= n, F.col("__y"))
    sums = points.groupBy(key, "__r").agg(F.array(*[F.struct(F.lit(n * per).alias("samples"), F.count(part(n)).alias("n"), F.avg(part(n)).alias("m"), F.var_samp(part(n)).alias("v")) for n in sizes]).alias("all"))
    each = sums.select(key, "__r", F.inline("all"))
    if method == "halton":
        found = each.groupBy(key, "samples").agg(F.avg("m").alias("value"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("std_error"))
    else:
        found = each.select(key, "samples", F.col("m").alias("value"), F.sqrt(F.col("v") / F.col("n")).alias("std_error"))
    bad = rows.where(~F.coalesce(good, F.lit(False))).select(key, F.explode(F.array(*[F.lit(n * per) for n in sizes])).alias("samples"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("std_error"))
    out = found.unionByName(bad)
    return out.select(key, "samples", "value", "std_error", (F.col("value") - z * F.col("std_error")).alias("low"), (F.col("value") + z * F.col("std_error")).alias("high"))


def converged(integrals: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """(key, converged): whether the last two sample sizes of ``integrate`` differ by at most ``tolerance`` of the last value."""
    last = F.array_sort(F.collect_list(F.struct("samples", "value")))  # a row a sample size
    two = integrals.groupBy(key).agg(last.alias("all"))
    a, b = F.element_at("all", -1)["value"], F.try_element_at("all", F.lit(-2))["value"]
    return two.select(key, F.coalesce(F.abs(a - b) <= tolerance * F.abs(a), F.lit(False)).alias("converged"))
