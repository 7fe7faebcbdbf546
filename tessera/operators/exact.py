"""Error-free sums: a superaccumulator of whole numbers, one slot an exponent.

A double is a whole number below 2^53 times a power of two. Its three pieces of
18 bits are summed as longs, by exponent: exact, in any order, for up to 2^45
rows. The few slots (2,098 at most) are put together as Python integers, so a
result is the true one, rounded once. Products are split into a double and its
error first, which are both exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.math import valid

_PIECE = 18
_SPLIT = float((1 << 27) + 1)


def _slots(rows: DataFrame, kept: list[str], x: str) -> DataFrame:
    """``kept`` columns, the exponent of the last bit (__slot) and the signed pieces of the 53-bit whole number (__s0 to __s2); 4000 and 4001 stand for +-infinity.

    Every step is a projection of its own, so nothing is worked out twice.
    """
    a, guess, scaled, whole = F.abs(F.col(x)), F.col("__guess"), F.col("__scaled"), F.col("__whole")
    infinite, zero = a == float("inf"), F.col(x) == 0
    rows = rows.withColumn("__guess", F.least(F.floor(F.log2(F.when(~zero & ~infinite, a).otherwise(1.0))).cast("int"), F.lit(1023)))
    rows = rows.withColumn("__scaled", F.when(infinite, 0.0).otherwise(a) / F.pow(F.lit(2.0), guess))  # 1 to 2 but for a rounded logarithm
    rows = rows.withColumn("__off", F.when(scaled >= 2, 1).when((scaled < 1) & (scaled > 0), -1).otherwise(0))
    mantissa = F.when(F.col("__off") == 0, scaled).when(F.col("__off") == 1, scaled / 2).otherwise(scaled * 2) * float(1 << 52)
    sign = F.when(F.col(x) < 0, -1).otherwise(1)
    rows = rows.select(
        *kept,
        F.when(infinite, F.when(F.col(x) > 0, 4000).otherwise(4001)).when(zero, 0).otherwise(guess + F.col("__off") - 52).cast("int").alias("__slot"),
        F.when(infinite, F.lit(1).cast("long")).otherwise(mantissa.cast("long")).alias("__whole"),
        sign.alias("__sign"),
    )
    piece = lambda i: F.col("__sign") * F.shiftright(whole, _PIECE * i).bitwiseAND(F.lit((1 << _PIECE) - 1 if i < 2 else (1 << 17) - 1))
    return rows.select(*kept, "__slot", *[piece(i).cast("long").alias(f"__s{i}") for i in range(3)])


def _products(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name the product of its columns as a double and its rounding error (name_e), which add up to the product exactly unless it is beyond 1e300 or its error below 1e-300."""
    factors = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    df = df.withColumns({f"{c}_t": F.col(c) * _SPLIT for c in factors})
    df = df.withColumns({f"{c}_h": F.col(f"{c}_t") - (F.col(f"{c}_t") - F.col(c)) for c in factors})
    df = df.withColumns({f"{c}_l": F.col(c) - F.col(f"{c}_h") for c in factors} | {n: F.col(a) * F.col(b) for n, (a, b) in pairs.items()})
    part = lambda c, which: F.col(f"{c}_{which}")
    return df.withColumns({f"{n}_e": part(a, "l") * part(b, "l") - (((F.col(n) - part(a, "h") * part(b, "h")) - part(a, "l") * part(b, "h")) - part(a, "h") * part(b, "l")) for n, (a, b) in pairs.items()})


def exact_aggregates(df: DataFrame, wanted: dict[str, tuple], keys: list[str] | None = None) -> DataFrame:
    """One row per key (without keys: one row) with the wanted columns, each the exact result rounded once.

    ``wanted`` maps names to ("sum", x), ("mean", x), ("var", x), ("std", x),
    ("var_pop", x), ("norm", x) or ("dot", x, y), with names of columns. Null and
    NaN do not count (a row of a dot product needs both); sums over nothing are
    null. Infinities give infinity, or NaN where they cancel.
    """
    keys = keys or []
    terms: dict[tuple, list[str]] = {}
    used = list(dict.fromkeys(c for _, *columns in wanted.values() for c in columns))
    of, pairs = {c: f"__c{i}" for i, c in enumerate(used)}, {}
    for how, *columns in wanted.values():
        if how in ("sum", "mean", "var", "std", "var_pop"):
            terms["sum", columns[0]] = [of[columns[0]]]
        if how in ("var", "std", "var_pop", "norm", "dot"):
            both = ("dot", columns[0], columns[-1])
            if both not in terms:
                name = f"__p{len(pairs)}"
                pairs[name], terms[both] = (of[columns[0]], of[columns[-1]]), [name, f"{name}_e"]
    names = list(terms)
    rows = _products(df.select(*keys, *[valid(F.col(c).cast("double")).alias(of[c]) for c in used]), pairs)
    each = [F.struct(F.lit(i).alias("__t"), F.lit(int(j == 0)).alias("__first"), F.col(x).alias("__x")) for i, n in enumerate(names) for j, x in enumerate(terms[n])]
    rows = rows.select(*keys, F.inline(F.array(*each))).where("__x is not null and not isnan(__x)")
    sums = _slots(rows, [*keys, "__t", "__first"], "__x")
    sums = sums.groupBy(*keys, F.col("__t").alias("t"), F.col("__slot").alias("slot")).agg(F.sum("__first").alias("n"), *[F.sum(f"__s{i}").alias(f"s{i}") for i in range(3)])
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct("t", "slot", "n", "s0", "s1", "s2")).alias("all"))  # slots of one key
    if not keys:
        packed = packed.select(F.coalesce("all", F.array()).alias("all"))
    asked = [(how, [names.index(t) if t in terms else None for t in (("sum", c[0]), ("dot", c[0], c[-1]))]) for how, *c in wanted.values()]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_result(how, at, _totals(slots)) for how, at in asked] for slots in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(asked))]
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *wanted])

    schema = ", ".join([*(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys), *(f"`{w}` double" for w in wanted)])
    return packed.mapInArrow(finish, schema)


def _totals(slots: list[dict]) -> dict[int, tuple[Fraction | float, int]]:
    """By term: the exact sum, or an infinity or NaN, and the number of rows."""
    whole: dict[int, int] = {}
    odd: dict[int, float] = {}
    rows: dict[int, int] = {}
    for s in slots:
        t = s["t"]
        rows[t] = rows.get(t, 0) + s["n"]
        if s["slot"] >= 4000:
            odd[t] = odd.get(t, 0.0) + (math.inf if s["slot"] == 4000 else -math.inf)
        else:
            number = s["s0"] + (s["s1"] << _PIECE) + (s["s2"] << 2 * _PIECE)
            whole[t] = whole.get(t, 0) + (number << s["slot"] + 1200)
    return {t: (odd[t] if t in odd else Fraction(whole.get(t, 0), 1 << 1200), n) for t, n in rows.items()}


def _double(x: Fraction | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _root(x: Fraction | float) -> float:
    """The root to the last bit, of numbers whose root is a double though they are none."""
    if isinstance(x, float) or x <= 0:
        return math.sqrt(max(x, 0)) if isinstance(x, Fraction) or x == x else x
    shift = 2 * max(0, 64 - (x.numerator.bit_length() - x.denominator.bit_length()) // 2 + 64)
    return _double(Fraction(math.isqrt((x.numerator << shift) // x.denominator), 1 << shift // 2))


def _result(how: str, at: list[int | None], totals: dict) -> float | None:
    nothing = (None, 0)
    (s, n), (q, m) = (totals.get(i, nothing) for i in at)
    if how == "sum":
        return None if s is None else _double(s)
    if how == "mean":
        return None if s is None else _double(s / n)
    if how in ("dot", "norm"):
        return None if q is None else _double(q) if how == "dot" else _root(q)
    free = n - (how != "var_pop")
    if s is None or free <= 0:
        return None
    if isinstance(s, float) or isinstance(q, float):
        return math.nan
    v = max((q - s * s / n) / free, Fraction(0))
    return _root(v) if how == "std" else _double(v)
