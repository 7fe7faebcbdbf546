"""Registered queries of the toolkit, each beside its SQL.

Doubles are rounded on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as P
from tessera.functions import math as M
from tessera.functions import strings as S
from tessera.functions import vectors as V
from tessera.operators import describe as D
from tessera.operators import frame as FR
from tessera.operators import inference as I
from tessera.operators import matrix as X
from tessera.operators import ndarray as N
from tessera.operators import series as TS
from tessera.sources import excel as E
from tessera.sources import files as IO
from tessera.sources import generate as G
from tessera.sources.scratch import scratch_path
from tessera.streaming import streams as ST

Table = Callable[[str], DataFrame]
_FOUND: dict[str, tuple[Callable[[Table, SparkSession], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def add_query(name: str, f: Callable[[Table, SparkSession], DataFrame], sql: str | None) -> None:
    _FOUND[name] = (f, sql)


def r(c: Column | str, n: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), n) + F.lit(0.0)


def rounded(df: DataFrame, n: int = 4, only: list[str] | None = None) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[r(c, n).alias(c) if k == "double" and (only is None or c in only) else F.col(c) for c, k in df.dtypes])


def gappy(t: Table) -> DataFrame:
    """events with missing values."""
    return t("events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


_GAPPY = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"

# Selection and filters.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def select_slice(t, s):
    return FR.slice_rows(t("orders").select("o_orderkey", "o_totalprice"), 10, 30, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def select_head(t, s):
    return FR.head(t("customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 5")
def select_tail(t, s):
    return FR.tail(t("customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT CAST(a.k AS INTEGER) AS ask, p_partkey, p_name FROM (VALUES (0, 5), (1, 0), (2, 5), (3, 11)) a(k, place) JOIN p ON p.pos = a.place")
def select_iloc(t, s):
    return FR.iloc(t("part").select("p_partkey", "p_name"), [5, 0, 5, 11], ["p_partkey"]).withColumnRenamed("__ask", "ask")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"WITH p AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1 AS pos FROM lineitem) SELECT CAST(a.k AS INTEGER) AS ask, {', '.join(_LINE)} FROM (VALUES (0, 5), (1, 0), (2, 5), (3, 4999)) a(k, place) JOIN p ON p.pos = a.place")
def select_iloc_lines(t, s):
    return FR.iloc(t("lineitem").select(*_LINE), [5, 0, 5, 4999], _LINE).withColumnRenamed("__ask", "ask")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events")
def select_position(t, s):
    return FR.with_position(t("events").select("event_id", "value"), ["value", "event_id"]).withColumnRenamed("__pos", "pos")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 99)")
def select_loc_list(t, s):
    return FR.loc(t("nation").select("n_nationkey", "n_name"), "n_nationkey", [1, 3, 99])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 12")
def select_loc_slice(t, s):
    return FR.loc_slice(t("nation").select("n_nationkey", "n_name"), "n_nationkey", 12, 5)


@query("SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def select_time_slice(t, s):
    return TS.slice_by_time(t("events"), "ts", "2024-01-05", "2024-01-06").select("event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def filter_query(t, s):
    return FR.query(t("lineitem"), "l_quantity > 45 and l_discount < 0.03").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END AS l_quantity FROM lineitem")
def filter_where(t, s):
    return FR.where(t("lineitem"), "l_quantity", F.col("l_discount") > 0.05, 0.0).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT event_id, value IS NULL AS is_null FROM {_GAPPY}")
def filter_is_null(t, s):
    return FR.is_null(gappy(t), "value").select("event_id", "is_null")


@query("SELECT coalesce(bool_and(abs(l_extendedprice - l_extendedprice * 1.000001) <= 1e-8 + 1e-5 * abs(l_extendedprice * 1.000001)), true) AS same FROM lineitem")
def filter_all_close(t, s):
    return t("lineitem").agg(M.all_close(F.col("l_extendedprice"), F.col("l_extendedprice") * 1.000001).alias("same"))


@query("SELECT coalesce(a.o_custkey, b.c_custkey) AS k, coalesce(a.a > b.b, false) AS value FROM (SELECT o_custkey, max(o_totalprice) AS a FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey, c_acctbal AS b FROM customer) b ON a.o_custkey = b.c_custkey")
def filter_compare_aligned(t, s):
    a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value"))
    return FR.compare(a, t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value")), "k", "gt")


# Joins.

_ORD = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"
_CUS = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"


def _join(how: str):
    def f(t, s):
        return FR.join(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), t("customer").select("c_custkey", "c_name", "c_acctbal"), ["o_custkey"], ["c_custkey"], how)

    return f


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _FOUND[f"join_{_how}"] = (_join(_how), f"SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_acctbal FROM {_ORD} o {_sql} {_CUS} c ON o_custkey = c_custkey")


@query("SELECT l.l_orderkey, l.l_suppkey, l.l_partkey, x.n FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) x ON l.l_partkey = x.l_partkey AND l.l_suppkey = x.l_suppkey")
def join_multiple_keys(t, s):
    x = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return FR.join(t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), x, ["l_partkey", "l_suppkey"])


@query(f"SELECT a.event_id, a.value, b.n FROM {_GAPPY} a JOIN (SELECT value, count(*) AS n FROM {_GAPPY} GROUP BY value) b ON a.value IS NOT DISTINCT FROM b.value")
def join_null_safe(t, s):
    g = gappy(t)
    return FR.join(g.select("event_id", "value"), g.groupBy("value").agg(F.count("*").alias("n")), ["value"], null_safe=True)


# Grouping.


def _grouped(how: str):
    def f(t, s):
        df = FR.group_aggregate(gappy(t).select("event_type", "user_id", "value"), ["event_type"], how)
        return df.select("event_type", r("user_id", 3).alias("user_id"), r("value", 3).alias("value"))

    return f


for _how, _sql in (("sum", "sum"), ("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):
    _FOUND[f"group_{_how}"] = (_grouped(_how), f"SELECT event_type, round(CAST({_sql}(user_id) AS DOUBLE), 3) AS user_id, round(CAST({_sql}(value) AS DOUBLE), 3) AS value FROM {_GAPPY} GROUP BY 1")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 1) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def group_multiple_sum(t, s):
    df = FR.group_aggregate(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "sum")
    return df.select("l_returnflag", "l_linestatus", r("l_quantity", 2).alias("l_quantity"), r("l_extendedprice", 1).alias("l_extendedprice"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def group_value_counts(t, s):
    return FR.value_counts(t("events"), "event_type")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def group_unique(t, s):
    return FR.unique(t("customer"), "c_mktsegment")


@query("SELECT event_id, value FROM events WHERE event_type IS NOT DISTINCT FROM 'click'")
def group_get(t, s):
    return FR.get_group(t("events"), {"event_type": "click"}).select("event_id", "value")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_keys(t, s):
    return FR.group_keys(t("lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1")
def group_pricing_summary(t, s):
    f = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return f.groupBy("l_returnflag").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), r(F.avg("l_quantity")).alias("avg_qty"), F.count("*").alias("n"))


# Reshaping.

_STATUS = "SELECT o_orderpriority, {} FROM orders GROUP BY 1"


@query(_STATUS.format(", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{x}'), 1) AS \"{x}\"" for x in "FOP")))
def reshape_pivot(t, s):
    return rounded(FR.pivot_table(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice"), 1)


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))")
def reshape_stack(t, s):
    return FR.stack(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])


@query(_STATUS.format(", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP")))
def reshape_unstack(t, s):
    return FR.unstack(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["o_orderkey"])


@query("SELECT x.column, max(v) FILTER (WHERE r_regionkey = 0) AS row_0, max(v) FILTER (WHERE r_regionkey = 1) AS row_1, max(v) FILTER (WHERE r_regionkey = 2) AS row_2, max(v) FILTER (WHERE r_regionkey = 3) AS row_3, max(v) FILTER (WHERE r_regionkey = 4) AS row_4 FROM (SELECT r_regionkey, 'r_regionkey' AS column, CAST(r_regionkey AS VARCHAR) AS v FROM region UNION ALL SELECT r_regionkey, 'r_name', r_name FROM region) x GROUP BY 1")
def reshape_transpose(t, s):
    return FR.transpose(t("region"), ["r_regionkey"], ["r_regionkey", "r_name"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def reshape_concat(t, s):
    return FR.concat_rows([t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@query("SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 5 AS INTEGER) AS section FROM nation")
def reshape_split(t, s):
    return FR.split_rows(t("nation").select("n_nationkey"), 5, ["n_nationkey"])


@query(f"SELECT {', '.join(_LINE)}, CAST((row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1) // ((SELECT count(*) FROM lineitem) // 4) AS INTEGER) AS section FROM lineitem")
def reshape_split_lines(t, s):
    return FR.split_rows(t("lineitem").select(*_LINE), 4, _LINE)


# Index-aligned arithmetic.

for _op, _sql in (("add", "a + b"), ("sub", "a - b"), ("mul", "a * b"), ("div", "CASE WHEN b = 0 THEN CAST('Infinity' AS DOUBLE) ELSE a / b END")):

    def _aligned(t, s, op=_op):
        a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value"))
        b = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
        return rounded(FR.arithmetic(a, b, "k", op))

    _FOUND[f"align_{_op}"] = (_aligned, f"SELECT k, round({_sql}, 4) AS value FROM (SELECT coalesce(x.k, y.k) AS k, x.v AS a, y.v AS b FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) x FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer) y ON x.k = y.k)")

# Missing values.


@query(f"SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS value FROM {_GAPPY}")
def missing_ffill(t, s):
    return FR.fill_direction(gappy(t), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query(f"SELECT event_id, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {_GAPPY}")
def missing_bfill(t, s):
    return FR.fill_direction(gappy(t), "value", ["ts", "event_id"], ["user_id"], forward=False).select("event_id", "value")


@query(f"SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING)) AS value FROM {_GAPPY}")
def missing_fill_limit(t, s):
    return FR.fill_direction(gappy(t), "value", ["ts", "event_id"], ["user_id"], limit=1).select("event_id", "value")


@query(f"SELECT event_id, coalesce(value, -1.0) AS value FROM {_GAPPY}")
def missing_fill_constant(t, s):
    return FR.fill_constant(gappy(t), "value", -1.0).select("event_id", "value")


@query(f"SELECT event_id, value FROM {_GAPPY} WHERE value IS NOT NULL")
def missing_drop(t, s):
    return FR.drop_missing(gappy(t), ["value"]).select("event_id", "value")


@query(f"SELECT count(*) FILTER (WHERE value IS NULL) AS value, 0::BIGINT AS user_id FROM {_GAPPY}")
def missing_count(t, s):
    return FR.count_missing(gappy(t), ["value", "user_id"])


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_GAPPY}),
k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS na, min(CASE WHEN value IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM n)
SELECT k.event_id, round(coalesce(k.value, a.value + (b.value - a.value) * (k.n - k.na) / (k.nb - k.na), a.value, b.value), 4) AS value FROM k LEFT JOIN n a ON a.user_id = k.user_id AND a.n = k.na LEFT JOIN n b ON b.user_id = k.user_id AND b.n = k.nb""")
def missing_interpolate(t, s):
    return rounded(FR.interpolate(gappy(t), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS event_type FROM events")
def missing_replace(t, s):
    return FR.replace_with_missing(t("events"), "event_type", ["click", "view"]).select("event_id", "event_type")


for _how, _sql in (("mean", "avg(value)"), ("median", "median(value)"), ("constant", "max(7.5::DOUBLE)")):

    def _imputed(t, s, how=_how):
        return rounded(I.impute_simple(gappy(t).select("event_id", "value"), ["value"], how, 7.5))

    _FOUND[f"impute_{_how}"] = (_imputed, f"SELECT event_id, round(coalesce(value, (SELECT {_sql} FROM {_GAPPY})), 4) AS value FROM {_GAPPY}")


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS f, CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice END AS v FROM part),
d AS (SELECT q.p_partkey, o.v, row_number() OVER (PARTITION BY q.p_partkey ORDER BY (o.f - q.f) ** 2, o.p_partkey) AS r FROM p q JOIN p o ON o.v IS NOT NULL WHERE q.v IS NULL)
SELECT p.p_partkey, round(coalesce(p.v, m.v), 4) AS v FROM p LEFT JOIN (SELECT p_partkey, avg(v) AS v FROM d WHERE r <= 5 GROUP BY 1) m USING (p_partkey)""")
def impute_knn(t, s):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("f"), F.when(F.col("p_partkey") % 19 != 0, F.col("p_retailprice")).alias("v"))
    return rounded(I.impute_knn(p, "v", ["f"], "p_partkey", 5).select("p_partkey", "v"))


# Windows and time series.

_W = "PARTITION BY user_id ORDER BY ts, event_id"
for _how, _sql in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")):

    def _rolled(t, s, how=_how):
        return rounded(FR.rolling(gappy(t), "value", 5, how, ["ts", "event_id"], ["user_id"], "rolled").select("event_id", "rolled"))

    _FOUND[f"window_rolling_{_how}"] = (_rolled, f"SELECT event_id, round(CASE WHEN row_number() OVER ({_W}) >= 5 THEN {_sql}(value) OVER ({_W} ROWS 4 PRECEDING) END, 4) AS rolled FROM {_GAPPY}")


@query(f"SELECT event_id, lag(value, 2) OVER ({_W}) AS shifted FROM events")
def window_shift(t, s):
    return FR.shift(t("events"), "value", 2, ["ts", "event_id"], ["user_id"], "shifted").select("event_id", "shifted")


@query(f"SELECT event_id, d FROM (SELECT event_id, round(value - lag(value) OVER ({_W}), 6) AS d FROM events) WHERE d IS NOT NULL")
def window_difference(t, s):
    return rounded(FR.difference(t("events"), "value", 1, ["ts", "event_id"], ["user_id"], "d").select("event_id", "d"), 6)


@query(f"SELECT event_id, round(sum(value) OVER ({_W} ROWS UNBOUNDED PRECEDING), 3) AS c FROM events")
def window_cumsum(t, s):
    return rounded(FR.cumulative(t("events"), "value", "sum", ["ts", "event_id"], ["user_id"], "c").select("event_id", "c"), 3)


@query("""WITH g AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, sum(value) AS v FROM events GROUP BY 1, 2),
sp AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM g GROUP BY 1)
SELECT sp.event_type, sp.bucket, round(coalesce(g.v, 0), 3) AS value FROM sp LEFT JOIN g ON g.event_type = sp.event_type AND g.bucket = sp.bucket""")
def window_resample_day(t, s):
    return rounded(FR.resample(t("events"), "ts", "value", "day", "sum", ["event_type"]), 3)


@query(f"SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 4) AS sma FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def series_centred_average(t, s):
    return rounded(TS.moving_average(t("events"), "value", 5, ["ts", "event_id"], ["user_id"], "centered").select("event_id", "sma"))


@query(f"SELECT event_id, round(CASE WHEN row_number() OVER ({_W}) >= 3 THEN (1.0 * lag(value, 2) OVER ({_W}) + 2.0 * lag(value, 1) OVER ({_W}) + 3.0 * value) / 6.0 END, 4) AS wma FROM events")
def series_weighted_average(t, s):
    return rounded(TS.weighted_average(t("events"), "value", [1, 2, 3], ["ts", "event_id"], ["user_id"]).select("event_id", "wma"))


@query(f"""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER ({_W}) AS n FROM events),
e AS (SELECT event_id, user_id, n, value AS ema FROM n WHERE n = 1 UNION ALL SELECT n.event_id, n.user_id, n.n, 0.3 * n.value + 0.7 * e.ema FROM e JOIN n ON n.user_id = e.user_id AND n.n = e.n + 1)
SELECT event_id, round(ema, 4) AS ema FROM e""")
def series_exponential_average(t, s):
    return rounded(TS.exponential_average(t("events").select("event_id", "ts", "user_id", "value"), "value", 0.3, ["ts", "event_id"], ["user_id"]).select("event_id", "ema"))


@query(f"""WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events),
l AS (SELECT user_id, d, lag(d, 1) OVER ({_W}) AS l1, lag(d, 2) OVER ({_W}) AS l2, lag(d, 3) OVER ({_W}) AS l3 FROM d),
g AS (SELECT user_id, sum(d * d) AS b, coalesce(sum(d * l1), 0) AS s1, coalesce(sum(d * l2), 0) AS s2, coalesce(sum(d * l3), 0) AS s3 FROM l GROUP BY 1)
SELECT user_id, CAST(lag AS INTEGER) AS lag, round(acf, 4) AS acf FROM (SELECT user_id, 0 AS lag, 1.0::DOUBLE AS acf FROM g UNION ALL SELECT user_id, 1, s1 / nullif(b, 0) FROM g UNION ALL SELECT user_id, 2, s2 / nullif(b, 0) FROM g UNION ALL SELECT user_id, 3, s3 / nullif(b, 0) FROM g)""")
def series_autocorrelation(t, s):
    return rounded(TS.autocorrelation(t("events"), "value", 3, ["ts", "event_id"], ["user_id"]))


_DAILY = "(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS v FROM events GROUP BY 1, 2)"


def daily(t: Table) -> DataFrame:
    return t("events").groupBy("event_type", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).agg(F.sum("value").alias("v"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS n FROM {_DAILY}),
tr AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend FROM n WINDOW w AS (PARTITION BY event_type ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
ph AS (SELECT event_type, n % 7 AS ph, avg(v - trend) AS s FROM tr GROUP BY 1, 2),
se AS (SELECT event_type, ph, s - avg(s) OVER (PARTITION BY event_type) AS seasonal FROM ph)
SELECT tr.event_type, tr.day, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS residual FROM tr JOIN se ON se.event_type = tr.event_type AND se.ph = tr.n % 7""")
def series_decompose(t, s):
    return rounded(TS.decompose(daily(t), "v", 7, ["day"], ["event_type"]).select("event_type", "day", "trend", "seasonal", "residual"), 3)


@query(f"""WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS DOUBLE) AS n FROM {_DAILY}),
f AS (SELECT event_type, regr_slope(v, n) AS s, regr_intercept(v, n) AS i FROM n GROUP BY 1)
SELECT n.event_type, n.day, round(i + s * n, 3) AS trend, round(v - (i + s * n), 3) AS detrended FROM n JOIN f USING (event_type)""")
def series_linear_trend(t, s):
    return rounded(TS.linear_trend(daily(t), "v", ["day"], ["event_type"]).select("event_type", "day", "trend", "detrended"), 3)


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS ts")
def series_date_range(t, s):
    return TS.date_range(s, "2024-01-01", "2024-02-01")


@query(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS n FROM {_DAILY}),
f AS (SELECT event_type, avg(v) AS l FROM n WHERE n < 7 GROUP BY 1),
e AS (SELECT n.event_type, n.day, n.n, f.l, CAST(0 AS DOUBLE) AS b, CAST([0, 0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS s, f.l AS y FROM n JOIN f USING (event_type) WHERE n = 0
UNION ALL SELECT event_type, day, n, l2, b2, CASE WHEN n < 7 THEN s ELSE list_concat(list_concat(s[1:n % 7], [c]), s[n % 7 + 2:7]) END, l2 + b2 + c FROM (
SELECT *, CASE WHEN n < 7 THEN s[n % 7 + 1] ELSE 0.3 * (v - l2 - b2) + 0.7 * s[n % 7 + 1] END AS c FROM (
SELECT *, CASE WHEN n < 7 THEN b ELSE 0.2 * (l2 - l) + 0.8 * b END AS b2 FROM (
SELECT n.event_type, n.day, n.n, n.v, e.l, e.b, e.s, CASE WHEN n.n < 7 THEN e.l ELSE 0.4 * (n.v - e.s[n.n % 7 + 1]) + 0.6 * (e.l + e.b) END AS l2 FROM e JOIN n ON n.event_type = e.event_type AND n.n = e.n + 1))))
SELECT event_type, day, round(y, 3) AS holt_winters FROM e""")
def series_holt_winters(t, s):
    return rounded(TS.holt_winters(daily(t), "v", 0.4, 0.2, 0.3, 7, ["day"], ["event_type"]).select("event_type", "day", "holt_winters"), 3)


@query(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM {_DAILY}),
e AS (SELECT a.event_type, a.day, a.n, a.v AS l, b.v - a.v AS b, a.v AS y FROM n a JOIN n b ON a.event_type = b.event_type AND a.n = 1 AND b.n = 2
UNION ALL SELECT event_type, day, n, l2, 0.2 * (l2 - l) + 0.8 * b, l2 + 0.2 * (l2 - l) + 0.8 * b FROM (SELECT n.event_type, n.day, n.n, e.l, e.b, 0.4 * n.v + 0.6 * (e.l + e.b) AS l2 FROM e JOIN n ON n.event_type = e.event_type AND n.n = e.n + 1))
SELECT event_type, day, round(y, 3) AS holt FROM e""")
def series_holt(t, s):
    return rounded(TS.holt(daily(t), "v", 0.4, 0.2, ["day"], ["event_type"]).select("event_type", "day", "holt"), 3)


_LAGGED = f"""n AS (SELECT event_type, day, v - avg(v) OVER (PARTITION BY event_type) AS d FROM {_DAILY}),
l AS (SELECT event_type, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3, lag(d, 4) OVER w AS l4, lag(d, 5) OVER w AS l5 FROM n WINDOW w AS (PARTITION BY event_type ORDER BY day)),
r AS (SELECT event_type, count(*) AS n, [sum(d * l1) / sum(d * d), sum(d * l2) / sum(d * d), sum(d * l3) / sum(d * d), sum(d * l4) / sum(d * d), sum(d * l5) / sum(d * d)] AS r FROM l GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_LAGGED}, p AS (SELECT event_type, r, 1 AS k, [r[1]] AS phi FROM r UNION ALL
SELECT event_type, r, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda q: q[1] - a * q[2]), a) FROM (SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / (1 - list_dot_product(phi, r[1:k])) AS a FROM p WHERE k < 5))
SELECT event_type, 0 AS lag, 1.0::DOUBLE AS pacf FROM r UNION ALL SELECT event_type, k, round(phi[k], 4) FROM p""")
def series_partial_autocorrelation(t, s):
    return rounded(TS.partial_autocorrelation(daily(t), "v", 5, ["day"], ["event_type"]))


_ARIMA = f"""d AS (SELECT event_type, day, v, v - lag(v) OVER (PARTITION BY event_type ORDER BY day) AS d FROM {_DAILY}),
m AS (SELECT event_type, avg(d) AS mean, max_by(v, day) AS last FROM d GROUP BY 1),
z AS (SELECT d.event_type, row_number() OVER w AS n, d - mean AS z, coalesce(lag(d - mean, 1) OVER w, 0) AS z1, coalesce(lag(d - mean, 2) OVER w, 0) AS z2 FROM d JOIN m USING (event_type) WHERE d IS NOT NULL WINDOW w AS (PARTITION BY d.event_type ORDER BY day)),
c AS (SELECT event_type, sum(z * z) AS c0, sum(z * z1) AS c1, sum(z * z2) AS c2 FROM z GROUP BY 1),
f AS (SELECT event_type, (c1 * c0 - c1 * c2) / (c0 * c0 - c1 * c1) AS p1, (c0 * c2 - c1 * c1) / (c0 * c0 - c1 * c1) AS p2 FROM c),
e AS (SELECT event_type, n, z, z1, z AS e FROM z WHERE n = 1 UNION ALL SELECT z.event_type, z.n, z.z, z.z1, z.z - p1 * z.z1 - p2 * z.z2 - 0.3 * e.e FROM e JOIN z ON z.event_type = e.event_type AND z.n = e.n + 1 JOIN f ON f.event_type = e.event_type)"""


@query(f"""WITH RECURSIVE {_ARIMA}, s AS (SELECT event_type, stddev_pop(e) AS s, max_by(z, n) AS z, max_by(z1, n) AS z1, max_by(e, n) AS e FROM e GROUP BY 1),
h AS (SELECT event_type, 0 AS step, z, z1, e, last AS y FROM s JOIN m USING (event_type) UNION ALL SELECT event_type, step + 1, v, z, CAST(0 AS DOUBLE), y + v + mean FROM (SELECT h.*, m.mean, p1 * z + p2 * z1 + 0.3 * e AS v FROM h JOIN f USING (event_type) JOIN m USING (event_type) WHERE step < 7))
SELECT event_type, CAST(step AS INTEGER) AS step, round(y, 3) AS forecast, round(y - 1.96 * s * sqrt(step), 3) AS low, round(y + 1.96 * s * sqrt(step), 3) AS high FROM h JOIN s USING (event_type) WHERE step > 0""")
def series_arima_forecast(t, s):
    return rounded(TS.arima_forecast(daily(t), "v", 2, 1, 1, 7, ["day"], ["event_type"]), 3)


@query(f"""WITH RECURSIVE {_ARIMA}, g AS (SELECT event_type, n, e, e - avg(e) OVER (PARTITION BY event_type) AS d FROM e),
l AS (SELECT event_type, e, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3, lag(d, 4) OVER w AS l4, lag(d, 5) OVER w AS l5 FROM g WINDOW w AS (PARTITION BY event_type ORDER BY n)),
k AS (SELECT event_type, count(*) AS n, avg(e * e) AS s2, avg(d * d) AS v, avg(d * d * d) AS d3, avg(d * d * d * d) AS d4, [sum(d * l1), sum(d * l2), sum(d * l3), sum(d * l4), sum(d * l5)] AS c FROM l GROUP BY 1),
o AS (SELECT *, -0.5 * n * (ln(2 * pi() * s2) + 1) AS ll FROM k)
SELECT event_type, n, round(s2, 3) AS sigma2, round(ll, 4) AS log_likelihood, round(8 - 2 * ll, 4) AS aic, round(4 * ln(n) - 2 * ll, 4) AS bic,
round(n * (n + 2) * list_sum(list_transform(c, lambda x, i: (x / (n * v)) * (x / (n * v)) / (n - i))), 4) AS ljung_box, round(n / 6 * (d3 * d3 / (v * v * v) + (d4 / (v * v) - 3) * (d4 / (v * v) - 3) / 4), 4) AS jarque_bera FROM o""")
def series_arima_diagnostics(t, s):
    d = rounded(TS.arima_diagnostics(daily(t), "v", 2, 1, 1, ["day"], ["event_type"]))
    return d.withColumn("sigma2", r("sigma2", 3))


@query(f"""WITH {_LAGGED} SELECT event_type, round(n * (n + 2) * list_sum(list_transform(r, lambda x, i: x * x / (n - i))), 4) AS ljung_box, round(n * list_dot_product(r, r), 4) AS box_pierce, 5.0::DOUBLE AS df FROM r""")
def series_portmanteau(t, s):
    return rounded(TS.portmanteau(daily(t), "v", 5, ["day"], ["event_type"]))


# Descriptive statistics.

_DESC = {
    "mean": "avg(x)", "var": "var_samp(x)", "std": "stddev_samp(x)", "var_pop": "var_pop(x)", "std_pop": "stddev_pop(x)", "median": "median(x)",
    "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "range": "max(x) - min(x)", "root_mean_square": "sqrt(avg(x * x))", "geometric_mean": "exp(avg(ln(x)))", "harmonic_mean": "count(x) / sum(1 / x)",
    "exact_sum": "CAST(sum(CAST(x AS DECIMAL(18, 4))) AS DOUBLE)",
}


@query("SELECT l_returnflag, " + ", ".join(f"round({v}, 4) AS {k}" for k, v in _DESC.items()) + ", (SELECT x FROM (SELECT l_extendedprice AS x, count(*) AS n FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1) ORDER BY n DESC, x LIMIT 1) AS mode FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) o GROUP BY 1")
def stats_aggregates(t, s):
    x = t("lineitem").select("l_returnflag", "l_extendedprice")
    counts = D.counted(x, "l_extendedprice", ["l_returnflag"])
    q = D.quantiles(x, "l_extendedprice", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["l_returnflag"], counts)
    q = q.select("l_returnflag", r("median").alias("median"), r(F.col("q75") - F.col("q25")).alias("iqr"))
    m = D.modes(x, "l_extendedprice", ["l_returnflag"], counts)
    plain = x.groupBy("l_returnflag").agg(*[r(D.AGGREGATES[k](F.col("l_extendedprice"))).alias(k) for k in _DESC if k in D.AGGREGATES])
    return plain.join(q, "l_returnflag").join(m, "l_returnflag")


@query("""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg(((l_quantity - m) / s) ** 3), 5) AS skewness, round(avg(((l_quantity - m) / s) ** 4), 5) AS kurtosis FROM lineitem l JOIN m ON m.l_returnflag = l.l_returnflag GROUP BY 1""")
def stats_shape(t, s):
    q = F.col("l_quantity")
    return t("lineitem").groupBy("l_returnflag").agg(r(D.skewness(q), 5).alias("skewness"), r(D.kurtosis(q), 5).alias("kurtosis"))


@query(f"SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM {_GAPPY} GROUP BY 1")
def stats_describe(t, s):
    return rounded(D.describe(gappy(t), "value", ["event_type"]))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(f: str, n: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({f}({a}, {b}), {n}) + 0.0 AS value FROM lineitem" for a in _COLS for b in _COLS)


@query(_pairs("corr", 5))
def stats_correlation_matrix(t, s):
    return rounded(D.correlation_matrix(t("lineitem"), _COLS), 5)


@query(_pairs("covar_samp", 3))
def stats_covariance_matrix(t, s):
    return rounded(D.correlation_matrix(t("lineitem"), _COLS, "covariance"), 3)


@query("""WITH q AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM q)
SELECT round(corr(rx, ry), 9) AS value FROM k""")
def stats_spearman(t, s):
    return rounded(D.spearman(t("lineitem"), "l_quantity", "l_extendedprice"), 9)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rank FROM lineitem")
def stats_ranked(t, s):
    return D.ranked(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "rank")


@query(f"SELECT event_type, arg_min(event_id, (value, event_id)) AS argmin, arg_min(event_id, (-value, event_id)) AS argmax FROM {_GAPPY} WHERE value IS NOT NULL GROUP BY 1")
def stats_arg_extremes(t, s):
    return D.arg_extremes(gappy(t), "value", "event_id", ["event_type"])


@query("SELECT round(avg(sign(b.s_acctbal - a.s_acctbal) * sign(b.s_nationkey - a.s_nationkey)), 5) AS value FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def stats_kendall(t, s):
    return rounded(D.kendall_tau(t("supplier"), "s_acctbal", "s_nationkey"), 5)


@query("SELECT round(avg(abs(l_quantity - m)), 5) AS value FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def stats_mean_absolute_deviation(t, s):
    return rounded(D.mean_absolute_deviation(t("lineitem"), "l_quantity"), 5)


@query("SELECT median(abs(l_quantity - m)) AS value FROM lineitem, (SELECT median(l_quantity) AS m FROM lineitem)")
def stats_median_absolute_deviation(t, s):
    return D.median_absolute_deviation(t("lineitem"), "l_quantity").select("value")


@query("""WITH e AS (SELECT min(c_acctbal) - 0.001 * (max(c_acctbal) - min(c_acctbal)) AS lo, max(c_acctbal) + 0.001 * (max(c_acctbal) - min(c_acctbal)) AS hi FROM customer),
b AS (SELECT least(9, CAST(floor((c_acctbal - lo) / ((hi - lo) / 10)) AS INTEGER)) AS bin FROM customer, e)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 10, 3) AS low, round(lo + (i + 1) * (hi - lo) / 10, 3) AS high, (SELECT count(*) FROM b WHERE bin = i) AS count FROM range(10) t(i), e""")
def stats_histogram(t, s):
    return rounded(D.histogram(t("customer"), "c_acctbal", 10), 3)


@query("SELECT CAST(CASE WHEN l_discount >= 0.08 THEN 2 WHEN l_discount >= 0.04 THEN 1 ELSE 0 END AS INTEGER) AS by, CAST(CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 20 THEN 1 ELSE 0 END AS INTEGER) AS bx, count(*) AS count FROM lineitem GROUP BY 1, 2")
def stats_histogram2d(t, s):
    return D.histogram2d(t("lineitem"), "l_quantity", "l_discount", [0, 20, 40, 60], [0, 0.04, 0.08, 0.2])


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 0 THEN 1 WHEN c_acctbal >= -500 THEN 0 ELSE -1 END AS INTEGER) AS bin FROM customer")
def stats_binning(t, s):
    return t("customer").select("c_custkey", D.binning(F.col("c_acctbal"), [-500, 0, 5000, 10000]).alias("bin"))


# Tests and models.


@query("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 4) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem")
def test_one_sample_t(t, s):
    return rounded(I.one_sample_t(t("lineitem"), "l_quantity", 25.0))


@query("""WITH m AS (SELECT avg(x) FILTER (WHERE f) AS ma, avg(x) FILTER (WHERE NOT f) AS mb, var_samp(x) FILTER (WHERE f) / count(*) FILTER (WHERE f) AS va, var_samp(x) FILTER (WHERE NOT f) / count(*) FILTER (WHERE NOT f) AS vb, count(*) FILTER (WHERE f) AS na, count(*) FILTER (WHERE NOT f) AS nb FROM (SELECT l_extendedprice AS x, l_returnflag = 'R' AS f FROM lineitem))
SELECT round((ma - mb) / sqrt(va + vb), 4) AS t, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 2) AS df FROM m""")
def test_two_sample_t(t, s):
    return I.two_sample_t(t("lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").select(r("t").alias("t"), r("df", 2).alias("df"))


@query("SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def test_paired_t(t, s):
    return rounded(I.paired_t(t("lineitem"), "l_discount", "l_tax"))


@query("""WITH o AS (SELECT event_type, count(*)::DOUBLE AS o FROM events GROUP BY 1), e AS (SELECT sum(o) / count(*) AS e FROM o)
SELECT round(sum((o - e) ** 2 / e), 4) AS chi2, CAST(count(*) - 1 AS DOUBLE) AS df FROM o, e""")
def test_chi_square(t, s):
    o = t("events").groupBy("event_type").agg(F.count("*").cast("double").alias("o"))
    return rounded(I.chi_square(o.crossJoin(o.agg(F.avg("o").alias("e"))), "o", "e"))


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
p AS (SELECT sum(n * (m - gm) ** 2) AS ss_between, sum(n * v) AS ss_within, CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2 FROM g, a)
SELECT round(ss_between, 3) AS ss_between, round(ss_within, 1) AS ss_within, df1, df2, round((ss_between / df1) / (ss_within / df2), 4) AS f FROM p""")
def test_anova(t, s):
    return I.anova_oneway(t("lineitem"), "l_quantity", "l_returnflag").select(r("ss_between", 3).alias("ss_between"), r("ss_within", 1).alias("ss_within"), "df1", "df2", r("f").alias("f"))


@query("""WITH k AS (SELECT l_returnflag, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(r) AS s FROM k GROUP BY 1)
SELECT round(12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1), 3) AS h, CAST(count(*) - 1 AS DOUBLE) AS df FROM g""")
def test_kruskal_wallis(t, s):
    return rounded(I.kruskal_wallis(t("lineitem"), "l_quantity", "l_returnflag"), 3)


@query("SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coefficient, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2), round(regr_r2(l_extendedprice, l_quantity), 5) FROM lineitem")
def model_linear_regression(t, s):
    return I.linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"]).select("term", r("coefficient", 2).alias("coefficient"), r("r2", 5).alias("r2"))


@query("SELECT round(avg((x - y) ** 2), 5) AS mse, round(avg(abs(x - y)), 5) AS mae, round(1 - sum((x - y) ** 2) / (var_pop(x) * count(x)), 5) AS r2 FROM (SELECT l_discount AS x, l_tax AS y FROM lineitem)")
def model_regression_metrics(t, s):
    return rounded(I.regression_metrics(t("lineitem"), "l_discount", "l_tax").select("mse", "mae", "r2"), 5)


@query("SELECT c_custkey, round((c_acctbal - m) / s, 5) AS c_acctbal_scaled FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def model_standard_scaler(t, s):
    return rounded(I.scale(t("customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal_scaled"), 5)


@query("SELECT c_custkey, round((c_acctbal - a) / (b - a), 5) AS c_acctbal_scaled FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def model_minmax_scaler(t, s):
    return rounded(I.scale(t("customer"), ["c_acctbal"], "minmax").select("c_custkey", "c_acctbal_scaled"), 5)


@query("SELECT c_custkey, round((c_acctbal - a) / b, 5) AS c_acctbal_scaled FROM customer, (SELECT median(c_acctbal) AS a, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS b FROM customer)")
def model_robust_scaler(t, s):
    return rounded(I.scale(t("customer"), ["c_acctbal"], "robust").select("c_custkey", "c_acctbal_scaled"), 5)


@query("SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal_restored FROM customer")
def model_scaler_inverse(t, s):
    fitted = I.scaling(t("customer"), ["c_acctbal"], "robust")
    return rounded(I.unscale(I.scale(t("customer"), ["c_acctbal"], "robust"), fitted, "robust").select("c_custkey", "c_acctbal_restored"))


@query("SELECT i AS split, CASE WHEN b = i THEN 'test' ELSE 'train' END AS fold, o_orderkey FROM (SELECT o_orderkey, greatest(0, (row_number() OVER (ORDER BY o_orderkey) - 1 - (n - n // 4 * 3)) // (n // 4) + CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 < n - n // 4 * 3 THEN -1 ELSE 1 END) AS b FROM orders, (SELECT count(*) AS n FROM orders)), (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS i) WHERE i >= greatest(b, 1)")
def resample_time_series_split(t, s):
    return I.time_series_split(t("orders").select("o_orderkey"), 3, ["o_orderkey"])


@query('SELECT l_orderkey, l_linenumber, round(l_discount * l_discount, 6) AS "l_discount^2", round(l_discount * l_tax, 6) AS "l_discount*l_tax", round(l_tax * l_tax, 6) AS "l_tax^2" FROM lineitem')
def model_polynomial_features(t, s):
    df = I.polynomial_features(t("lineitem"), ["l_discount", "l_tax"], 2, bias=False)
    return rounded(df.select("l_orderkey", "l_linenumber", "l_discount^2", "l_discount*l_tax", "l_tax^2"), 6)


_PRED = "(SELECT o_orderkey, CAST(o_totalprice > 150000 AS INTEGER) AS a, CAST(o_custkey % 2 AS INTEGER) AS p, o_totalprice + 100000 * (o_orderkey % 5) AS score FROM orders)"


def predicted(t: Table) -> DataFrame:
    return t("orders").select("o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias("a"), (F.col("o_custkey") % 2).cast("int").alias("p"), (F.col("o_totalprice") + 100000 * (F.col("o_orderkey") % 5)).alias("score"))


@query(f"SELECT a AS actual, p AS predicted, count(*) AS count FROM {_PRED} GROUP BY 1, 2")
def metric_confusion(t, s):
    return I.confusion_matrix(predicted(t), "a", "p")


@query(f"SELECT round(avg(CAST(a = p AS DOUBLE)), 5) AS accuracy FROM {_PRED}")
def metric_accuracy(t, s):
    return rounded(I.accuracy(predicted(t), "a", "p"), 5)


@query(f"""WITH l AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS label), c AS (SELECT label, count(*) FILTER (WHERE a = label AND p = label)::DOUBLE AS tp, count(*) FILTER (WHERE a = label) AS support, count(*) FILTER (WHERE p = label) AS called FROM {_PRED}, l GROUP BY 1)
SELECT label, round(coalesce(tp / nullif(called, 0), 0), 5) AS precision, round(coalesce(tp / nullif(support, 0), 0), 5) AS recall, round(coalesce(2 * tp / nullif(called + support, 0), 0), 5) AS f1, support FROM c WHERE called + support > 0""")
def metric_classification_report(t, s):
    return rounded(I.classification_report(predicted(t), "a", "p"), 5)


@query(f"""WITH k AS (SELECT a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {_PRED}), c AS (SELECT sum(r) FILTER (WHERE a = 1) AS s, count(*) FILTER (WHERE a = 1)::DOUBLE AS p, count(*) FILTER (WHERE a <> 1)::DOUBLE AS n FROM k)
SELECT round((s - p * (p + 1) / 2) / (p * n), 9) AS auc FROM c""")
def metric_roc_auc(t, s):
    return rounded(I.roc_auc(predicted(t), "a", "score"), 9)


@query(f"""WITH g AS (SELECT score, sum(a) AS p, count(*) - sum(a) AS n FROM {_PRED} GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, round(cp / (SELECT sum(p) FROM g), 6) AS tpr, round(cn / (SELECT sum(n) FROM g), 6) AS fpr FROM c""")
def metric_roc_curve(t, s):
    return rounded(I.roc_curve(predicted(t), "a", "score"), 6, ["tpr", "fpr"])


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - m) / s > 2.0 AS outlier FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)")
def outlier_zscore(t, s):
    return I.outliers(t("lineitem"), "l_extendedprice", "zscore", 2.0).select("l_orderkey", "l_linenumber", "outlier")


@query("SELECT o_orderkey, o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a) AS outlier FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def outlier_iqr(t, s):
    return I.outliers(t("orders"), "o_totalprice", "iqr", 0.5).select("o_orderkey", "outlier")


@query("SELECT o_orderkey, 0.6745 * abs(o_totalprice - m) / d > 1.5 AS outlier FROM orders, (SELECT m, median(abs(o_totalprice - m)) AS d FROM orders, (SELECT median(o_totalprice) AS m FROM orders) GROUP BY m)")
def outlier_modified_zscore(t, s):
    return I.outliers(t("orders"), "o_totalprice", "mad", 1.5).select("o_orderkey", "outlier")


_KM = "(x - a{0}) * (x - a{0}) + (y - b{0}) * (y - b{0})"
_NEAR = f"CASE WHEN {_KM.format(1)} <= {_KM.format(2)} AND {_KM.format(1)} <= {_KM.format(3)} THEN 0 WHEN {_KM.format(2)} <= {_KM.format(3)} THEN 1 ELSE 2 END"


@query(f"""WITH RECURSIVE s AS (SELECT 0 AS n, 10.0::DOUBLE AS a1, 1000.0::DOUBLE AS b1, 25.0::DOUBLE AS a2, 1400.0::DOUBLE AS b2, 40.0::DOUBLE AS a3, 1800.0::DOUBLE AS b3
UNION ALL SELECT n + 1, """ + ", ".join(f"coalesce(avg({c}) FILTER (c = {i - 1}), max({m}{i}))" for i in (1, 2, 3) for c, m in (("x", "a"), ("y", "b"))) + f""" FROM (SELECT *, {_NEAR} AS c FROM s, (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) WHERE n < 20) GROUP BY n)
SELECT p_partkey, p_size, p_retailprice, {_NEAR} AS cluster FROM (SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), (SELECT * FROM s WHERE n = 20)""")
def model_kmeans(t, s):
    return I.kmeans(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], [[10.0, 1000.0], [25.0, 1400.0], [40.0, 1800.0]])[0]


@query(None)
def model_pca(t, s):
    return rounded(I.pca(t("lineitem").select("l_orderkey", "l_linenumber", *_COLS), _COLS, 2)[0].select("l_orderkey", "l_linenumber", "pc1", "pc2"), 3)


_S = {(i, j): f"s{i}{j}" for i in range(3) for j in range(i, 3)} | {(j, i): f"s{i}{j}" for i in range(3) for j in range(i, 3)}
_COF = {(i, j): f"({_S[(i + 1) % 3, (j + 1) % 3]} * {_S[(i + 2) % 3, (j + 2) % 3]} - {_S[(i + 1) % 3, (j + 2) % 3]} * {_S[(i + 2) % 3, (j + 1) % 3]})" for i in range(3) for j in range(3)}


@query("WITH x AS (SELECT l_returnflag AS label, l_quantity AS x0, l_discount AS x1, l_tax AS x2 FROM lineitem), m AS (SELECT label, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM x GROUP BY 1), s AS (SELECT "
       + ", ".join(f"sum((x{i} - m{i}) * (x{j} - m{j})) / (count(*) - (SELECT count(*) FROM m)) AS s{i}{j}" for i in range(3) for j in range(i, 3))
       + f" FROM x JOIN m USING (label)), v AS (SELECT *, s00 * {_COF[0, 0]} + s01 * {_COF[0, 1]} + s02 * {_COF[0, 2]} AS det FROM s), w AS (SELECT label, n, m0, m1, m2, "
       + ", ".join(f"({' + '.join(f'{_COF[i, j]} * m{j}' for j in range(3))}) / det AS w{i}" for i in range(3))
       + " FROM m, v) SELECT label, 'intercept' AS term, round(-0.5 * (m0 * w0 + m1 * w1 + m2 * w2) + ln(n / (SELECT sum(n) FROM m)), 4) AS coefficient FROM w "
       + " ".join(f"UNION ALL SELECT label, '{c}', round(w{i}, 4) FROM w" for i, c in enumerate(("l_quantity", "l_discount", "l_tax"))))
def model_lda(t, s):
    return rounded(I.lda(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"))


@query("""WITH RECURSIVE p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), s AS (SELECT 0 AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p
UNION ALL SELECT n + 1, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)), (sum(w * y) - (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) * sum(w * x)) / sum(w)
FROM (SELECT n, x, y, CASE WHEN r <= k THEN 1.0 ELSE k / r END AS w FROM (SELECT n, x, y, r, 1.345 * greatest(median(r) OVER () / 0.6745, 1e-12) AS k FROM (SELECT n, x, y, abs(y - a - b * x) AS r FROM s, p WHERE n < 20))) GROUP BY n)
SELECT 'intercept' AS term, round(a, 3) AS coefficient FROM s WHERE n = 20 UNION ALL SELECT 'p_size', round(b, 3) FROM s WHERE n = 20""")
def model_huber(t, s):
    return rounded(I.robust_regression(t("part"), "p_retailprice", ["p_size"]).select("term", "coefficient"), 3)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS y FROM part),
t0 AS (SELECT p_partkey, x IS NULL AS gx, y IS NULL AS gy, coalesce(x, avg(x) OVER ()) AS x, coalesce(y, avg(y) OVER ()) AS y FROM p),
t1 AS (SELECT p_partkey, gx, gy, CASE WHEN gx THEN mx + b * (y - my) ELSE x END AS x, y FROM t0, (SELECT covar_pop(x, y) * count(*) / (var_pop(y) * count(*) + 1e-6) AS b, avg(x) AS mx, avg(y) AS my FROM t0 WHERE NOT gx)),
t2 AS (SELECT p_partkey, gx, gy, x, CASE WHEN gy THEN my + b * (x - mx) ELSE y END AS y FROM t1, (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-6) AS b, avg(x) AS mx, avg(y) AS my FROM t1 WHERE NOT gy)),
t3 AS (SELECT p_partkey, gx, gy, CASE WHEN gx THEN mx + b * (y - my) ELSE x END AS x, y FROM t2, (SELECT covar_pop(x, y) * count(*) / (var_pop(y) * count(*) + 1e-6) AS b, avg(x) AS mx, avg(y) AS my FROM t2 WHERE NOT gx)),
t4 AS (SELECT p_partkey, gx, gy, x, CASE WHEN gy THEN my + b * (x - mx) ELSE y END AS y FROM t3, (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-6) AS b, avg(x) AS mx, avg(y) AS my FROM t3 WHERE NOT gy))
SELECT p_partkey, round(x, 3) AS x, round(y, 3) AS y FROM t4""")
def impute_chained(t, s):
    p = t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).cast("double").alias("x"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("y"))
    return rounded(I.impute_chained(p, ["x", "y"], 2), 3)


_STEPS = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
_DRAW = "((CAST(('0x' || substr(md5('1:' || i || ':' || {0}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query(f"""WITH u AS (SELECT c_acctbal AS v, i, {_DRAW.format('c_custkey')} AS u FROM customer, range(100) r(i)),
w AS (SELECT v, i, {' + '.join(f'CAST(u >= {x!r}::DOUBLE AS INTEGER)' for x in _STEPS)} AS w FROM u),
m AS (SELECT sum(w * v) / sum(w) AS m FROM w GROUP BY i)
SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def resample_bootstrap(t, s):
    return rounded(I.bootstrap_interval(t("customer"), "c_acctbal", 100, key=["c_custkey"]))


@query("SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def resample_kfold(t, s):
    return I.kfold(t("orders").select("o_orderkey", "o_orderstatus"), 5, "o_orderkey", stratify="o_orderstatus")


@query("""WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(CAST(('0x' || md5('0:' || p_partkey)[1:8]) AS BIGINT) % 4 AS INTEGER) AS fold FROM part), k AS (SELECT DISTINCT fold AS k FROM p),
f AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p, k WHERE fold <> k GROUP BY 1)
SELECT fold, round(avg((y - a - b * x) * (y - a - b * x)), 2) AS score FROM p JOIN f ON fold = k GROUP BY 1""")
def resample_cross_validate(t, s):
    fit = lambda df: I.linear_regression(df, "p_retailprice", ["p_size"])
    score = lambda df, model: I.regression_metrics(I.predict(df, model), "p_retailprice", "prediction").first()["mse"]
    return rounded(I.cross_validate(I.kfold(t("part"), 4, "p_partkey"), fit, score), 2)


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus = 'F' AS g FROM orders), s AS (SELECT avg(g::INT) AS share, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS d FROM o),
x AS (SELECT v, i, {_DRAW.format('o_orderkey')} < share AS g FROM o, s, range(50) r(i)), a AS (SELECT avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS d FROM x GROUP BY i)
SELECT round(any_value(s.d), 4) AS observed, round(avg((a.d >= s.d)::INT), 4) AS p_value FROM a, s""")
def test_permutation(t, s):
    return rounded(I.permutation_test(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", F.col("o_orderstatus") == "F", 50, key=["o_orderkey"]))


_RM = "(SELECT o_custkey % 10 AS s, o_orderkey % 4 AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


@query(f"""WITH r AS (SELECT *, avg(v) OVER () AS m, avg(v) OVER (PARTITION BY s) AS ms, avg(v) OVER (PARTITION BY t) AS mt FROM {_RM}),
q AS (SELECT sum((mt - m) * (mt - m)) AS a, sum((ms - m) * (ms - m)) AS b, sum((v - ms - mt + m) * (v - ms - mt + m)) AS e, count(DISTINCT t) - 1 AS d1, (count(DISTINCT t) - 1) * (count(DISTINCT s) - 1) AS d2 FROM r)
SELECT round((a / d1) / (e / d2), 6) AS f, CAST(d1 AS DOUBLE) AS df1, CAST(d2 AS DOUBLE) AS df2 FROM q""")
def test_repeated_measures(t, s):
    rows = t("orders").groupBy((F.col("o_custkey") % 10).alias("s"), (F.col("o_orderkey") % 4).alias("t")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(I.repeated_measures_anova(rows, "s", "t", "v").select("f", "df1", "df2"), 6)


@query("""WITH x AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y FROM lineitem), t AS (SELECT count(*) AS n, sum((x - mx) * (x - mx)) AS t11, sum((x - mx) * (y - my)) AS t12, sum((y - my) * (y - my)) AS t22 FROM x, (SELECT avg(x) AS mx, avg(y) AS my FROM x)),
e AS (SELECT sum((x - mx) * (x - mx)) AS e11, sum((x - mx) * (y - my)) AS e12, sum((y - my) * (y - my)) AS e22 FROM x JOIN (SELECT g, avg(x) AS mx, avg(y) AS my FROM x GROUP BY 1) USING (g)),
w AS (SELECT *, (e11 * e22 - e12 * e12) / (t11 * t22 - t12 * t12) AS w FROM t, e)
SELECT round(w, 8) AS wilks, round(((t11 - e11) * t22 - 2 * (t12 - e12) * t12 + (t22 - e22) * t11) / (t11 * t22 - t12 * t12), 8) AS pillai, round((1 - sqrt(w)) / sqrt(w) * (2 * (n - 3.5) - 1) / 4, 5) AS f, 4.0::DOUBLE AS df1, CAST(2 * (n - 3.5) - 1 AS DOUBLE) AS df2 FROM w""")
def test_manova(t, s):
    m = I.manova(t("lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return m.select(r("wilks", 8).alias("wilks"), r("pillai", 8).alias("pillai"), r("f", 5).alias("f"), "df1", "df2")


def _sql_poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_TAIL = f"{_sql_poly(P._C, 'q')} / {_sql_poly(P._D, 'q')}"


@query(f"""WITH p AS (SELECT o_totalprice AS v, (row_number() OVER (ORDER BY o_totalprice) - 0.375::DOUBLE) / (count(*) OVER () + 0.25::DOUBLE) AS p FROM orders),
q AS (SELECT v, p, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS q, (p - 0.5) * (p - 0.5) AS u FROM p),
z AS (SELECT v, CASE WHEN p < 0.02425 THEN {_TAIL} WHEN p > 1 - 0.02425 THEN -({_TAIL}) ELSE (p - 0.5) * {_sql_poly(P._A, 'u')} / {_sql_poly(P._B, 'u')} END AS z FROM q)
SELECT round(w, 6) AS w, n, round((1 - w) * (1 - w), 6) AS p_rough FROM (SELECT corr(v, z) * corr(v, z) AS w, count(*) AS n FROM z)""")
def test_shapiro_wilk(t, s):
    return rounded(I.shapiro_wilk(t("orders"), "o_totalprice").drop("p_value"), 6)


# Elementwise functions.

_MATH = {
    "log": "ln(x)", "log2": "log2(x)", "log10": "log10(x)", "log1p": "ln(1 + x)", "exp2": "pow(2, x / 10000)", "expm1": "exp(x / 10000) - 1", "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "square": "x * x / 1000", "reciprocal": "1 / x",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x / 10000)", "atan": "atan(x)", "sinh": "sinh(x / 10000)", "cosh": "cosh(x / 10000)", "tanh": "tanh(x / 1000)", "radians": "radians(x)", "degrees": "degrees(x)", "floor": "floor(x)", "ceil": "ceil(x)", "trunc": "trunc(x)", "sign": "CAST(sign(x) AS DOUBLE)",
}
_SCALED = {"exp2": 10000, "expm1": 10000, "tan": 10000, "sinh": 10000, "cosh": 10000, "tanh": 1000}


@query("SELECT p_partkey, " + ", ".join(f"round({v}, 4) + 0.0 AS f_{k}" for k, v in _MATH.items()) + " FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def math_elementwise(t, s):
    x = F.col("p_retailprice")
    return t("part").select("p_partkey", *[r(M.ELEMENTWISE[k](x / _SCALED[k] if k in _SCALED else x) / (1000 if k == "square" else 1)).alias(f"f_{k}") for k in _MATH])


@query("SELECT o_orderkey, round(fmod(o_totalprice, 777), 4) AS f_mod, round(atan2(o_totalprice, 1000), 5) AS f_atan2, round(sqrt(o_totalprice * o_totalprice + 9), 4) AS f_hypot, CASE WHEN o_totalprice < 50000 THEN 50000.0 WHEN o_totalprice > 200000 THEN 200000.0 ELSE o_totalprice END AS f_clip, greatest(o_totalprice, 100000.0) AS f_max, least(o_totalprice, 100000.0) AS f_min, round(o_totalprice / 7.0, 2) AS f_div FROM orders")
def math_binary(t, s):
    x = F.col("o_totalprice")
    return t("orders").select("o_orderkey", r(M.mod(x, 777)).alias("f_mod"), r(M.atan2(x, F.lit(1000.0)), 5).alias("f_atan2"), r(M.hypot(x, F.lit(3.0))).alias("f_hypot"), M.clip(x, 50000, 200000).alias("f_clip"), M.maximum(x, F.lit(100000.0)).alias("f_max"), M.minimum(x, F.lit(100000.0)).alias("f_min"), r(M.divide(x, 7.0), 2).alias("f_div"))


@query("SELECT l_orderkey, l_linenumber, round(1 + 2 * l_tax - 3 * l_tax * l_tax, 6) AS value FROM lineitem")
def math_polynomial(t, s):
    return t("lineitem").select("l_orderkey", "l_linenumber", r(M.horner(F.col("l_tax"), [1, 2, -3]), 6).alias("value"))


@query("""SELECT p_partkey, lower(p_name) AS s_lower, upper(p_name) AS s_upper, upper(p_name[1:1]) || lower(p_name[2:]) AS s_capitalize, replace(p_name, 'a', '#') AS s_replace, p_name[3:6] AS s_slice, lpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), '*') AS s_rjust, rpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), '.') AS s_ljust, contains(p_type, 'A') AS s_contains, starts_with(p_brand, 'Brand') AS s_startswith, ends_with(p_brand, '1') AS s_endswith, length(p_name) AS s_len, instr(p_name, 'e') - 1 AS s_find, length(p_name) - length(replace(p_name, 'e', '')) AS s_count, regexp_full_match(p_brand, '[A-Za-z]+') AS s_isalpha FROM part""")
def string_functions(t, s):
    n, b = F.col("p_name"), F.col("p_brand")
    return t("part").select("p_partkey", S.lower(n).alias("s_lower"), S.upper(n).alias("s_upper"), S.capitalize(n).alias("s_capitalize"), S.replace(n, "a", "#").alias("s_replace"), S.slice_(n, 2, 6).alias("s_slice"), S.rjust(b, 12, "*").alias("s_rjust"), S.ljust(b, 12, ".").alias("s_ljust"), S.contains(F.col("p_type"), "A").alias("s_contains"), S.startswith(b, "Brand").alias("s_startswith"), S.endswith(b, "1").alias("s_endswith"), S.len_(n).cast("long").alias("s_len"), S.find(n, "e").cast("long").alias("s_find"), S.count(n, "e").cast("long").alias("s_count"), S.isalpha(b).alias("s_isalpha"))


@query("SELECT event_id, string_split(event_type, 'i') AS parts, regexp_extract(props, '[0-9]+') AS digits FROM events")
def string_split(t, s):
    return t("events").select("event_id", S.split(F.col("event_type"), "i").alias("parts"), F.get(S.extract(F.col("props"), "([0-9]+)", 1), F.lit(0)).alias("digits"))


@query("""WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS y FROM a WHERE vec_id = 0)
SELECT vec_id, round(list_distance(x, y), 3) AS euclidean, round(list_cosine_similarity(x, y), 4) AS cosine, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 3) AS manhattan, round(list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 4) AS chebyshev FROM a, q""")
def vector_distances(t, s):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    both = e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("x").alias("y"))))  # one query vector
    x, y = F.col("x"), F.col("y")
    return both.select("vec_id", r(V.euclidean(x, y), 3).alias("euclidean"), r(V.cosine_similarity(x, y)).alias("cosine"), r(V.manhattan(x, y), 3).alias("manhattan"), r(V.chebyshev(x, y)).alias("chebyshev"))


# Matrices.

_MAT = "(SELECT o_custkey % 50 AS i, o_orderkey % 40 AS j, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2)"


def cells(t: Table) -> DataFrame:
    return t("orders").groupBy((F.col("o_custkey") % 50).alias("i"), (F.col("o_orderkey") % 40).alias("j")).agg((F.sum("o_totalprice") / 1000).alias("v"))


@query(f"SELECT a.i, b.i AS j, round(sum(a.v * b.v), 1) AS v FROM {_MAT} a JOIN {_MAT} b ON a.j = b.j GROUP BY 1, 2")
def matrix_product(t, s):
    m = cells(t)
    return rounded(X.matmul(m, X.transpose(m)), 1)


@query(f"SELECT round(sqrt(sum(v * v)), 3) AS fro, (SELECT round(max(c), 3) FROM (SELECT sum(abs(v)) AS c FROM {_MAT} GROUP BY j)) AS one, (SELECT round(max(c), 3) FROM (SELECT sum(abs(v)) AS c FROM {_MAT} GROUP BY i)) AS inf, (SELECT round(sum(v), 3) FROM {_MAT} WHERE i = j) AS trace FROM {_MAT}")
def matrix_norms(t, s):
    m = cells(t)
    parts = [X.norm(m, k).select(r("value", 3).alias(n)) for k, n in (("fro", "fro"), ("1", "one"), ("inf", "inf"))] + [X.trace(m).select(r("value", 3).alias("trace"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query(f"SELECT i, round(sum(v * (j + 1)), 2) AS v FROM {_MAT} GROUP BY 1")
def matrix_vector(t, s):
    x = s.range(40).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    return rounded(X.spmv(cells(t), x), 2)


@query(f"SELECT i, j, round(sum(v), 3) AS v FROM (SELECT i, j, v FROM {_MAT} UNION ALL SELECT j, i, v * 2 FROM {_MAT}) GROUP BY 1, 2")
def matrix_add_transpose(t, s):
    m = cells(t)
    return rounded(X.add(m, X.scale(X.transpose(m), 2.0)), 3)


@query("SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, v FROM (" + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, round(sum({p} * {q}), 2) AS v FROM lineitem" for i, p in enumerate(_COLS[::2]) for j, q in enumerate(_COLS[::2])) + ")")
def matrix_gram(t, s):
    return rounded(X.gram(t("lineitem"), _COLS[::2]), 2)


@query(None)
def matrix_conjugate_gradient(t, s):
    m = cells(t)
    a = X.add(X.matmul(m, X.transpose(m)), X.scale(X.identity(s, 50), 1e4))
    b = s.range(50).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    return rounded(X.conjugate_gradient(a, b, 1e-6, 500, jacobi=True), 14)


_WAVE = f"SELECT x.event_type, y.n AS k, round(sum(x.v * cos(2 * pi() * ((x.n * y.n) % x.m) / x.m)), 3) + 0.0 AS re, round(-sum(x.v * sin(2 * pi() * ((x.n * y.n) % x.m) / x.m)), 3) + 0.0 AS im FROM n x JOIN n y ON x.event_type = y.event_type"
_PLACED = f"WITH n AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS m FROM {_DAILY})"


@query(f"{_PLACED} {_WAVE} GROUP BY 1, 2")
def transform_fft(t, s):
    return rounded(X.fft(daily(t), "day", "v", ["event_type"]), 3)


@query(f"{_PLACED} {_WAVE} WHERE 2 * y.n <= y.m GROUP BY 1, 2")
def transform_real_fft(t, s):
    return rounded(X.rfft(daily(t), "day", "v", ["event_type"]), 3)


_GRID = "(SELECT o_custkey % 6 AS i, o_orderkey % 5 AS j, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2)"


@query(f"SELECT k.i, k.j, round(sum(c.v * cos(2 * pi() * (c.i * k.i / 6.0::DOUBLE + c.j * k.j / 5.0::DOUBLE))), 3) + 0.0 AS re, round(-sum(c.v * sin(2 * pi() * (c.i * k.i / 6.0::DOUBLE + c.j * k.j / 5.0::DOUBLE))), 3) + 0.0 AS im FROM {_GRID} c, {_GRID} k GROUP BY 1, 2")
def transform_fft2(t, s):
    g = t("orders").groupBy((F.col("o_custkey") % 6).alias("i"), (F.col("o_orderkey") % 5).alias("j")).agg((F.sum("o_totalprice") / 1000).alias("v"))
    return rounded(X.fft2(g), 3)


@query("WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_quantity * l_tax) AS c, sum(l_discount * l_discount) AS d, sum(l_discount * l_tax) AS e, sum(l_tax * l_tax) AS f FROM lineitem) SELECT round(ln(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)), 6) AS log_abs_determinant, 3 AS rank FROM g")
def matrix_invariants(t, s):
    return rounded(X.invariants(X.gram(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]), 3).select("log_abs_determinant", "rank"), 6)


# Twice the identity and the share of each column in its row: regular and not symmetric. The SQL iterates by Jacobi.
_SHARES = "(SELECT i, j, n / sum(n) OVER (PARTITION BY i) + CASE WHEN i = j THEN 2 ELSE 0 END AS v FROM (SELECT o_custkey % 7 AS i, o_orderkey % 7 AS j, count(*) AS n FROM orders GROUP BY 1, 2))"
_JACOBI = f"""WITH RECURSIVE a AS (SELECT list(q ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS q FROM {_SHARES} GROUP BY 1)),
x AS (SELECT 0 AS n, CAST([0, 0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS x UNION ALL SELECT n + 1, list_transform(a, lambda q, k: (k - list_dot_product(q, x) + q[k] * x[k]) / q[k]) FROM x, a WHERE n < 80)
SELECT k AS i, round(x[k + 1], 6) AS v FROM x, range(7) t(k) WHERE n = 80"""


def shares(t: Table) -> DataFrame:
    n = t("orders").groupBy((F.col("o_custkey") % 7).alias("i"), (F.col("o_orderkey") % 7).alias("j")).agg(F.count("*").alias("n"))
    rows = n.groupBy(F.col("i").alias("k")).agg(F.sum("n").alias("s"))
    return n.join(rows, n["i"] == rows["k"]).select("i", "j", (F.col("n") / F.col("s") + F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.0)).alias("v"))


@query(_JACOBI)
def matrix_bicgstab(t, s):
    return rounded(X.bicgstab(shares(t), s.range(7).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v")), 1e-12), 6)


@query(_JACOBI)
def matrix_gmres(t, s):
    return rounded(X.gmres(shares(t), s.range(7).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v")), 1e-12), 6)


@query(f"SELECT (i * 40 + j) // 100 AS i0, (i * 40 + j) // 20 % 5 AS i1, (i * 40 + j) % 20 AS i2, round(v, 7) AS v FROM {_MAT}")
def array_reshape(t, s):
    return rounded(N.reshape(cells(t).toDF("i0", "i1", "v"), [50, 40], [20, 5, -1]), 7)


@query(f"SELECT i AS i0, j AS i1, round(v - avg(v) OVER (PARTITION BY j), 4) + 0.0 AS v FROM {_MAT}")
def array_broadcast(t, s):
    a = cells(t).toDF("i0", "i1", "v")
    return rounded(N.combine(a, [50, 40], N.reduce(a, 2, [0], F.avg), [40], lambda x, y: x - y)[0])


@query(f"SELECT j AS i0, round(max(v), 7) AS v FROM {_MAT} GROUP BY 1")
def array_reduce(t, s):
    turned = N.permute(cells(t).toDF("i0", "i1", "v"), [1, 0])
    return rounded(N.reduce(turned, 2, [1], F.max), 7)


# Generated tables.


@query("SELECT i AS pos, CAST(1 + i * 0.5 AS DOUBLE) AS value FROM range(8) t(i)")
def generate_arange(t, s):
    return G.arange(s, 1.0, 5.0, 0.5)


@query("SELECT i AS pos, round(i / 9.0, 6) AS value FROM range(10) t(i)")
def generate_linspace(t, s):
    return rounded(G.linspace(s, 0.0, 1.0, 10), 6)


def _sql_uniform(k: int) -> str:
    return f"((CAST(('0x' || md5('3:{k}:' || i)[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)"


@query(f"SELECT i AS pos, round(sqrt(-2 * ln({_sql_uniform(0)})) * cos(2 * pi() * {_sql_uniform(1)}), 6) + 0.0 AS value FROM range(1000) t(i)")
def generate_normal(t, s):
    return rounded(G.sample(s, "normal", 1000, 3), 6)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 25")
def generate_choice(t, s):
    return G.choice(t("orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey", 5)


# Files, databases and streams: each table is written whole to the shared folder and read back.


@query("SELECT * FROM part")
def source_csv(t, s):
    path = scratch_path(s, "csv")
    IO.write_csv(t("part"), path)
    return IO.read_csv(s, path, schema=t("part").schema)


@query("SELECT c_custkey, c_acctbal FROM customer")
def source_csv_inferred(t, s):
    path = scratch_path(s, "csv")
    IO.write_csv(t("customer").select("c_custkey", "c_acctbal"), path, sep="|", header=False)
    return IO.read_csv(s, path, sep="|", header=False).select(F.col("col_0").cast("long").alias("c_custkey"), F.col("col_1").alias("c_acctbal"))


@query("SELECT event_id, event_type, user_id, value, props FROM events")
def source_json(t, s):
    path = scratch_path(s, "json")
    e = t("events").select("event_id", "event_type", "user_id", "value", "props")
    IO.write_json(e, path)
    return IO.read_json(s, path, e.schema)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def source_parquet(t, s):
    path = scratch_path(s, "parquet")
    IO.write_parquet(t("orders"), path, partition_by=["o_orderstatus"])
    return rounded(IO.read_parquet(s, path, ["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT count(*) AS rows, true AS sized FROM lineitem")
def source_parquet_metadata(t, s):
    path = scratch_path(s, "parquet")
    IO.write_parquet(t("lineitem"), path)
    return IO.parquet_metadata(s, path).agg(F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("sized"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_xlsx(t, s):
    path = scratch_path(s, "xlsx").removeprefix("file:").replace("//", "/")  # a workbook is one local or mounted file
    E.write_xlsx(path, {"nation": t("nation").select("n_nationkey", "n_name", "n_regionkey"), "region": t("region")})
    s.dataSource.register(E.XlsxSource)
    return s.read.format("xlsx").option("path", path).option("sheet", "nation").load().select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def source_sql(t, s):
    t("supplier").createOrReplaceTempView("tessera_supplier")
    return rounded(IO.read_sql(s, "SELECT s_nationkey, count(*) AS n, sum(s_acctbal) AS total FROM tessera_supplier WHERE s_acctbal > 0 GROUP BY s_nationkey"), 2)


@query(f"SELECT user_id, CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS pos, value FROM events")
def source_series_json(t, s):
    return IO.from_series_json(IO.series_json(t("events"), "value", ["ts", "event_id"], ["user_id"]), "json")


@query("SELECT vec_id, [CAST(k // 8 AS INTEGER), CAST(k % 8 AS INTEGER)] AS index, CAST(embedding[k + 1] AS DOUBLE) AS value FROM embeddings, range(len(embedding)) t(k)")
def source_array_json(t, s):
    e = t("embeddings")
    width = len(e.select("embedding").first()[0])
    kept = e.select("vec_id", IO.array_json(F.col("embedding").cast("array<double>"), [width // 8, 8]).alias("json"))
    return IO.from_array_json(kept, "json")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t, s):
    found = streamed(t, s, lambda e: ST.windowed(e, "ts", "1 day", {"n": F.count("*"), "total": F.sum("value")}, ["event_type"]))
    return rounded(found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"), 3)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS session_end, count(*) AS n FROM k GROUP BY user_id, k""")
def stream_sessions(t, s):
    found = streamed(t, s, lambda e: ST.sessions(e, "ts", "6 hours", "user_id"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def streamed(t: Table, s: SparkSession, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``f`` over events as a stream of files and reads its complete result."""
    inbox, out = scratch_path(s, "inbox"), scratch_path(s, "stream")
    t("events").write.parquet(inbox)
    found = f(ST.read_stream(s, inbox, t("events").schema))
    ST.each_batch(found, lambda batch, _: batch.write.mode("overwrite").parquet(out), scratch_path(s, "state"), "complete").awaitTermination()
    return s.read.schema(found.schema).parquet(out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

    return {name: bind(f) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


from tessera.plans import numeric_queries  # noqa: E402, F401  (registers its queries)
