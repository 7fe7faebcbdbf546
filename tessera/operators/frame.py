"""Relational operators on DataFrames: selection, joins, grouping, reshaping, sets.

Rows have no order of their own. Operators that need positions take ``order``,
the columns that define it; positions are then materialised as ``__pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.math import missing, valid

POS = "__pos"
#: Rows of a part that one task numbers, and how many parts there are at most.
PART_ROWS, MOST_PARTS = 100_000, 512
AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def numeric(df: DataFrame, columns: list[str]) -> list[str]:
    bad = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    if bad:
        raise TypeError(f"not numeric: {', '.join(bad)}")
    return columns


def _cuts(df: DataFrame, order: list[str]) -> list:
    """Bounds between parts of about PART_ROWS rows, at most MOST_PARTS - 1 of them, from a sample taken once."""
    n = df.count()
    parts = min(MOST_PARTS, -(-n // PART_ROWS))
    if parts < 2:
        return []
    sample = df.select(*order).sample(min(1.0, 40.0 * parts / n), seed=1).limit(80 * parts)  # bounded by MOST_PARTS
    rows = sample.orderBy(*order).collect()
    return list(dict.fromkeys(rows[len(rows) * i // parts] for i in range(1, parts)))


def _part(df: DataFrame, order: list[str], cuts: list) -> Column:
    """The number of the part that a row lies in, by bisection over literal bounds."""
    key = F.struct(*[F.col(c) for c in order])
    bound = lambda row: F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row, strict=True)])

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bound(cuts[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(cuts))


def running_before(df: DataFrame, order: list[str], weights: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its weight over all rows before a row in ``order``.

    Bounds are taken once, as literals, so every use of the plan deals the rows
    alike. A part is numbered by itself and offset by the parts before; no task
    sees all rows, and the table of part sums has MOST_PARTS rows at most. Rows
    that are equal in ``order`` lie in one part, in no fixed order.
    """
    dealt = df.withColumn("__part", _part(df, order, _cuts(df, order))).withColumns({f"__w_{k}": w for k, w in weights.items()})
    sums = dealt.groupBy("__part").agg(*[F.sum(f"__w_{k}").alias(f"__s_{k}") for k in weights])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in weights]))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"__i_{k}": F.sum(f"__w_{k}").over(inside) - F.col(f"__w_{k}") for k in weights})
    return placed.join(offsets, F.col("__part") == F.col("__p")).select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__i_{k}")).alias(k) for k in weights])


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds 0-based ``__pos`` in ``order``, gapless."""
    return running_before(df, order, {POS: F.lit(1).cast("long")})


#: Rows of a block of an unkeyed window, besides the neighbours that it copies.
BLOCK_ROWS = 100_000


def by_blocks(df: DataFrame, order: list[str], before: int, after: int, f: Callable[[DataFrame, list[str], list[str]], DataFrame]) -> DataFrame:
    """``f(rows, order, keys)`` over one endless ordered table, for results that look at ``before`` rows back and ``after`` ahead.

    Rows are numbered, cut into blocks by position, and each block gets a copy of
    its neighbours; ``f`` then works block by block (the key) and the copies go.
    So no window sees the whole table. Copies are ``before + after`` rows a block.
    """
    placed = with_position(df, order)
    size = max(BLOCK_ROWS, before + after)
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col(POS) - after) / size)), F.floor((F.col(POS) + before) / size)
    dealt = placed.withColumn("__block", F.explode(F.sequence(first, last)))
    return f(dealt, [POS], ["__block"]).where(F.col("__block") == F.floor(F.col(POS) / size)).drop(POS, "__block")


def carried(df: DataFrame, value: Column, order: list[str], forward: bool = True) -> DataFrame:
    """Adds ``__near``: the last (or next) value that is not null up to each row of one endless ordered table, the row included.

    Each part settles its own rows; what reaches over its edge is one value a
    part, carried on over the few parts.
    """
    dealt = df.withColumns({"__part": _part(df, order, _cuts(df, order)), "__value": value})
    pick, span = (F.last, (Window.unboundedPreceding, 0)) if forward else (F.first, (0, Window.unboundedFollowing))
    inside = pick("__value", ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(*span))
    there = F.when(F.col("__value").isNotNull(), F.struct(*order))
    ends = dealt.groupBy("__part").agg((F.max_by if forward else F.min_by)("__value", there).alias("__end"))
    outside = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    edge = ends.select(F.col("__part").alias("__p"), pick("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(*outside)).alias("__edge"))  # a row a part
    near = dealt.withColumn("__near", inside).join(F.broadcast(edge), F.col("__part") == F.col("__p"))
    return near.withColumn("__near", F.coalesce("__near", "__edge")).drop("__part", "__value", "__p", "__edge")


def slice_rows(df: DataFrame, start: int, end: int, order: list[str]) -> DataFrame:
    """Rows [start, end) in ``order``, clamped."""
    start, end = max(0, start), max(0, end)
    return df.orderBy(*order).offset(start).limit(max(0, end - start))


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def iloc(df: DataFrame, places: list[int], order: list[str]) -> DataFrame:
    """Rows at the given positions, repeated and in the order asked for (column ``__ask``)."""
    wanted = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(places)], "__ask int, __place long")
    return with_position(df, order).join(F.broadcast(wanted), F.col(POS) == F.col("__place")).drop(POS, "__place")


def loc(df: DataFrame, label: str, values: list) -> DataFrame:
    """Rows whose label is in the list; absent labels are dropped silently."""
    return df.where(F.col(label).isin(values))


def loc_slice(df: DataFrame, label: str, start, end, order: list[str] | None = None) -> DataFrame:
    """Rows between two labels, both included, swapped if reversed; of sorted labels unless ``order`` says otherwise."""
    if order is None:
        low, high = sorted((start, end))
        return df.where(F.col(label).between(F.lit(low), F.lit(high)))
    placed = with_position(df, order)
    ends = placed.where(F.col(label).isin([start, end])).groupBy().agg(F.min(POS).alias("__a"), F.max(POS).alias("__b"))
    return placed.crossJoin(F.broadcast(ends)).where(F.col(POS).between(F.col("__a"), F.col("__b"))).drop(POS, "__a", "__b")  # one row


def where(df: DataFrame, column: str, condition: Column, other) -> DataFrame:
    """``other`` wherever the condition does not hold."""
    return df.withColumn(column, F.when(condition, F.col(column)).otherwise(F.lit(other)))


def query(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)


def is_null(df: DataFrame, column: str, name: str = "is_null") -> DataFrame:
    return df.withColumn(name, missing(F.col(column)))


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join; all left columns, then the right ones but its keys.

    The left key stays null for unmatched right rows of right and outer joins.
    ``null_safe`` lets null keys meet each other. Right columns with a name of
    the left get the suffix _right.
    """
    right_on = right_on or left_on
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("as many left as right keys are needed, one at least")
    for df, keys in ((left, left_on), (right, right_on)):
        if unknown := set(keys) - set(df.columns):
            raise KeyError(f"no such column: {', '.join(sorted(unknown))}")
    renamed = right.toDF(*[f"__r_{c}" for c in right.columns])
    pairs = [(left[a], renamed[f"__r_{b}"]) for a, b in zip(left_on, right_on, strict=True)]
    on = None
    for a, b in pairs:
        one = a.eqNullSafe(b) if null_safe else a == b
        on = one if on is None else on & one
    rest = [renamed[f"__r_{c}"].alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c not in right_on]
    return left.join(renamed, on, how).select(*[left[c] for c in left.columns], *rest)


def group_aggregate(df: DataFrame, keys: list[str], how: str, columns: list[str] | None = None) -> DataFrame:
    """sum, mean, count, min or max of the other columns by typed keys; null is a group of its own.

    Only numbers can be aggregated but for count, which counts what is not null.
    """
    if not keys:
        raise ValueError("no keys")
    columns = columns or [c for c in df.columns if c not in keys]
    if how != "count":
        numeric(df, columns)
    return df.groupBy(*keys).agg(*[AGGREGATES[how](c).alias(c) for c in columns])


def group_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def get_group(df: DataFrame, keys: dict) -> DataFrame:
    for k, v in keys.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df


def unique(df: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """Distinct values; with ``order``, also the position-defining columns of the first occurrence."""
    if order is None:
        return df.select(column).distinct()
    return df.groupBy(column).agg(F.min(F.struct(*order)).alias("first_seen"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def pivot_table(df: DataFrame, row: str, col: str, value: str, how: str = "sum") -> DataFrame:
    """One row per row key, one column per column key, both as sorted strings; null keys are dropped.

    A cell without rows is null; a cell of nulls only sums to 0.
    """
    rows = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).cast("string").alias(row), F.col(col).cast("string").alias("__c"), F.col(value).alias("__v"))
    names = sorted(r[0] for r in rows.select("__c").distinct().collect())  # column names of the result
    f = AGGREGATES[how](F.col("__v"))
    if how == "sum":
        f = F.when(F.count(F.lit(1)) > 0, F.coalesce(f, F.lit(0.0)))
    return rows.groupBy(row).pivot("__c", names).agg(f)


def stack(df: DataFrame, columns: list[str], var: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; numbers of different types become doubles, everything else mixed becomes strings."""
    kinds = {df.schema[c].dataType.simpleString() for c in columns}
    to = kinds.pop() if len(kinds) == 1 else "double" if all(isinstance(df.schema[c].dataType, T.NumericType) for c in columns) else "string"
    ids = [c for c in df.columns if c not in columns]
    return df.select(*ids, *[F.col(c).cast(to).alias(c) for c in columns]).unpivot(ids, columns, var, value)


def unstack(df: DataFrame, index: str, column: str, value: str, order: list[str]) -> DataFrame:
    """Long to wide; of duplicates the last in ``order`` wins."""
    names = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().collect())
    return df.withColumn("__c", F.col(column).cast("string")).groupBy(index).pivot("__c", names).agg(F.max_by(F.col(value), F.struct(*order)))


def transpose(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Columns become rows, rows become columns row_0, row_1, ...; for small tables."""
    placed = with_position(df, order)
    long = stack(placed.select(POS, *columns), columns, "column", "value")
    n = df.count()
    return long.groupBy("column").pivot(POS, list(range(n))).agg(F.first("value")).toDF("column", *[f"row_{i}" for i in range(n)])


def concat_rows(frames: list[DataFrame]) -> DataFrame:
    """Append along rows; same columns required."""
    out = frames[0]
    for f in frames[1:]:
        if set(f.columns) != set(out.columns):
            raise ValueError("columns differ")
        out = out.unionByName(f)
    return out


def split_rows(df: DataFrame, sections: int, order: list[str]) -> DataFrame:
    """Adds ``section``: equal consecutive parts; it is an error if they cannot be equal."""
    n = df.count()
    if n % sections:
        raise ValueError(f"{n} rows do not make {sections} equal sections")
    return with_position(df, order).withColumn("section", F.floor(F.col(POS) / max(1, n // sections)).cast("int")).drop(POS)


def sort(df: DataFrame, columns: list[str], ascending: bool = True) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c in columns])


def align(left: DataFrame, right: DataFrame, index: str, left_value: str = "value", right_value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Rows (index, a, b) of the union of both labels; of repeated right labels the last value in ``order`` counts, the largest without one."""
    b = right.groupBy(F.col(index).alias("__i")).agg(F.max_by(F.col(right_value), F.struct(*(order or [right_value]))).alias("b"))
    return left.select(F.col(index), F.col(left_value).cast("double").alias("a")).join(b, F.col(index) == F.col("__i"), "full").select(F.coalesce(index, "__i").alias(index), "a", F.col("b").cast("double").alias("b"))


def arithmetic(left: DataFrame, right: DataFrame, index: str, op: str, value: str = "value") -> DataFrame:
    """Label-aligned + - * / ** %; null where a side lacks the label; x/0 is Infinity, x mod 0 NaN."""
    from tessera.functions import math as M

    both = align(left, right, index, value, value)
    a, b = F.col("a"), F.col("b")
    made = {"add": a + b, "sub": a - b, "mul": a * b, "div": M.divide(a, b), "pow": F.pow(a, b), "mod": M.mod(a, b)}[op]
    return both.select(index, F.when(a.isNotNull() & b.isNotNull(), made).alias("value"))


def compare(left: DataFrame, right: DataFrame, index: str, op: str, value: str = "value") -> DataFrame:
    """Label-aligned comparison; false where a side lacks the label, for ne too."""
    both = align(left, right, index, value, value)
    a, b = F.col("a"), F.col("b")
    made = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    return both.select(index, F.coalesce(made, F.lit(False)).alias("value"))


# Missing values.


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(~missing(F.col(c)))
    return df


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(missing(F.col(column)), F.lit(value)).otherwise(F.col(column)))


def fill_direction(df: DataFrame, column: str, order: list[str], keys: list[str] | None = None, forward: bool = True, limit: int | None = None) -> DataFrame:
    """The last (or next) value present, by key in ``order``, over at most ``limit`` missing rows. Without keys, by parts of the one series."""
    value = F.when(~missing(F.col(column)), F.col(column))
    if not keys and limit is None:
        return carried(df, value, order, forward).withColumn(column, F.col("__near")).select(*df.columns)
    if not keys:
        return by_blocks(df, order, limit if forward else 0, 0 if forward else limit, lambda d, o, k: fill_direction(d, column, o, k, forward, limit)).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    span = ((Window.unboundedPreceding if limit is None else -limit), 0) if forward else (0, (Window.unboundedFollowing if limit is None else limit))
    pick = F.last(value, ignorenulls=True) if forward else F.first(value, ignorenulls=True)
    return df.withColumn(column, F.coalesce(value, pick.over(w.rowsBetween(*span))))


def interpolate(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    """Linear in row position between the values present, by key; edges take the nearest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    value = F.when(~missing(F.col(column)), F.col(column).cast("double"))
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("__v", value)
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col("__n").alias("n"), F.col("__v").alias("v")))
    rows = rows.withColumns({"__a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("__n") - a["n"]) / F.nullif(b["n"] - a["n"], F.lit(0))
    return rows.withColumn(column, F.coalesce("__v", between, a["v"], b["v"])).drop("__n", "__v", "__a", "__b")


def fill_from(df: DataFrame, other: DataFrame, index: str, column: str, order: list[str] | None = None) -> DataFrame:
    """Missing values from another table's rows of the same label; of repeated labels the last value in ``order``, the largest without one."""
    b = other.groupBy(F.col(index).alias("__i")).agg(F.max_by(F.col(column), F.struct(*(order or [column]))).alias("__o"))
    return df.join(b, F.col(index) == F.col("__i"), "left").withColumn(column, F.when(missing(F.col(column)), F.col("__o")).otherwise(F.col(column))).drop("__i", "__o")


def replace_with_missing(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumn(column, F.when(~F.col(column).isin(values), F.col(column)))


def count_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(missing(F.col(c)).cast("long")), F.lit(0)).alias(c) for c in columns])


# Windows.


def _rows(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(df: DataFrame, column: str, window: int, how: str, order: list[str], keys: list[str], name: str | None = None, minimum: int | None = None) -> DataFrame:
    """sum, mean, min, max, std or var of the last ``window`` rows; null before ``minimum`` (default: ``window``) rows are there.

    Missing values inside a window are skipped. Without keys, the one series is cut into blocks with neighbours.
    """
    if not keys:
        return by_blocks(df, order, max(window, minimum or 0) - 1, 0, lambda d, o, k: rolling(d, column, window, how, o, k, name, minimum))
    w = _rows(keys, order)
    value = F.when(~missing(F.col(column)), F.col(column).cast("double"))
    f = (AGGREGATES | {"std": F.stddev_samp, "var": F.var_samp})[how](value).over(w.rowsBetween(-(window - 1), 0))
    return df.withColumn(name or f"{column}_{how}", F.when(F.row_number().over(w) >= (minimum or window), f))


def shift(df: DataFrame, column: str, periods: int, order: list[str], keys: list[str], name: str | None = None) -> DataFrame:
    if not keys:
        return by_blocks(df, order, max(periods, 0), max(-periods, 0), lambda d, o, k: shift(d, column, periods, o, k, name))
    return df.withColumn(name or f"{column}_shift", F.lag(column, periods).over(_rows(keys, order)))


def difference(df: DataFrame, column: str, period: int, order: list[str], keys: list[str], name: str | None = None) -> DataFrame:
    """x_t - x_(t-period); rows without a predecessor are dropped."""
    name = name or f"{column}_diff"
    if not keys:
        return by_blocks(df, order, max(period, 0), max(-period, 0), lambda d, o, k: difference(d, column, period, o, k, name))
    return df.withColumn(name, F.col(column) - F.lag(column, period).over(_rows(keys, order))).where(F.col(name).isNotNull())


def cumulative(df: DataFrame, column: str, how: str, order: list[str], keys: list[str], name: str | None = None) -> DataFrame:
    """Running sum or product; missing values add nothing. Without keys, from running sums by parts."""
    c = valid(F.col(column))
    parts = {"sum": c} if how == "sum" else {"log": F.log(F.nullif(F.abs(c), F.lit(0.0))), "odd": (c < 0).cast("long"), "zero": (c == 0).cast("long")}
    name = name or f"{column}_cum{how}"
    if keys:
        w = _rows(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        upto, n = {k: F.sum(x).over(w) for k, x in parts.items()}, F.count(c).over(w)
        rows = df
    else:
        weights = {f"__{k}": F.coalesce(x, F.lit(0).cast("double" if k in ("sum", "log") else "long")) for k, x in parts.items()}
        rows = running_before(df, order, weights | {"__n": c.isNotNull().cast("long")})
        upto, n = {k: F.col(f"__{k}") + weights[f"__{k}"] for k in parts}, F.col("__n") + c.isNotNull().cast("long")
    f = upto["sum"] if how == "sum" else F.when(upto["zero"] > 0, 0.0).otherwise(F.exp(F.coalesce(upto["log"], F.lit(0.0))) * (1 - 2 * (upto["odd"] % 2)))
    return rows.withColumn(name, F.when(n > 0, f)).select(*[x for x in df.columns if x != name], name)


def resample(df: DataFrame, ts: str, column: str, every: str, how: str, keys: list[str] | None = None) -> DataFrame:
    """Tumbling buckets of a calendar unit ('day', 'week', 'month', ...); buckets between without rows hold 0 for sum and count, null else."""
    keys = keys or []
    bucket = F.date_trunc(every, F.col(ts).cast("timestamp_ntz")).cast("timestamp_ntz").alias("bucket")
    got = df.groupBy(*keys, bucket).agg(AGGREGATES[how](column).alias("value"))
    span = got.groupBy(*keys).agg(F.min("bucket").alias("__a"), F.max("bucket").alias("__b"))
    spine = span.select(*keys, F.explode(F.sequence(F.col("__a"), F.col("__b"), F.expr(f"INTERVAL 1 {every}"))).alias("bucket"))
    out = spine.join(got, [*keys, "bucket"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0).cast(got.schema["value"].dataType))) if how in ("sum", "count") else out
