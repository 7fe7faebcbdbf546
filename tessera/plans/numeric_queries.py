"""More registered queries: starts of k-means, exact sums, random draws, periods, scans and factorisations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import exact as EX
from tessera.operators import factor as FA
from tessera.operators import frame as FR
from tessera.operators import inference as I
from tessera.operators import matrix as X
from tessera.operators import montecarlo as MC
from tessera.operators import neighbours as NB
from tessera.operators import series as TS
from tessera.operators import spectrum as SP
from tessera.plans.queries import add_query, gappy, query, rounded
from tessera.sources import generate as G

_U = "((CAST(('0x' || substr(md5('{0}:' || {1} || ':' || p_partkey), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"
_POINTS = "part_x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part)"


def _points(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))


def _d2(names: list[str]) -> str:
    return "least(" + ", ".join(f"(x - {n}.cx) * (x - {n}.cx) + (y - {n}.cy) * (y - {n}.cy)" for n in names) + ")"


_DRAWS = ", ".join(
    [f"c0 AS (SELECT p_partkey AS ck, x AS cx, y AS cy FROM part_x ORDER BY {_U.format(5, 0)}, p_partkey LIMIT 1)"]
    + [
        f"c{i} AS (SELECT p_partkey AS ck, x AS cx, y AS cy FROM (SELECT p_partkey, x, y, {_d2([f'c{j}' for j in range(i)])} AS d FROM part_x, {', '.join(f'c{j}' for j in range(i))}) WHERE d > 0 ORDER BY -ln({_U.format(5, i)}) / d, p_partkey LIMIT 1)"
        for i in range(1, 5)
    ]
)


@query(f"WITH {_POINTS}, {_DRAWS} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS place, round(cx, 6) AS x, round(cy, 6) AS y FROM c{i}" for i in range(5)))
def model_kmeans_start(t, s):
    centres = NB.start_centres(_points(t), ["x", "y"], 5, "p_partkey", 5, "plusplus")
    return rounded(s.createDataFrame([(i, *c) for i, c in enumerate(centres)], "place int, x double, y double"), 6)


_ROUND = "(SELECT min((x - g.x) * (x - g.x) + (y - g.y) * (y - g.y)) FROM {0} g)"
_FAR = "f{0} AS (SELECT p_partkey, p.x, p.y, min((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS d FROM part_x p, g{0} g GROUP BY 1, 2, 3)"


@query(
    f"WITH {_POINTS}, g0 AS (SELECT x, y FROM part_x ORDER BY {_U.format(7, 0)}, p_partkey LIMIT 1), "
    + ", ".join(f"{_FAR.format(i)}, g{i + 1} AS (SELECT x, y FROM g{i} UNION SELECT x, y FROM f{i} WHERE {_U.format(7, i + 1)} < 8.0 * d / (SELECT sum(d) FROM f{i}))" for i in range(3))
    + " SELECT round(x, 6) AS x, round(y, 6) AS y FROM g3"
)
def model_kmeans_candidates(t, s):
    rows = _points(t).select("p_partkey", NB.vector(["x", "y"]).alias("__x"))
    return rounded(s.createDataFrame(NB.d2_candidates(rows, 4, "p_partkey", 7, rounds=3), "x double, y double"), 6)


@query(None)
def model_kmeans_parallel(t, s):
    """k-means from k-means|| starts; its cost is tested against the best of ten random starts."""
    return I.kmeans(_points(t), ["x", "y"], k=5, key="p_partkey", seed=3)[0].select("p_partkey", "cluster")


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS f, round(l_discount * 100) AS g, CASE WHEN (l_orderkey + l_linenumber) % 97 <> 0 THEN l_extendedprice END AS v FROM lineitem WHERE l_returnflag = 'R'),
q AS (SELECT DISTINCT f, g FROM p WHERE v IS NULL),
best AS (SELECT f, g, k, v, (pf - f) ** 2 + (pg - g) ** 2 AS d FROM (SELECT q.f, q.g, o.f AS pf, o.g AS pg, o.k, o.v FROM q JOIN (SELECT * FROM p WHERE v IS NOT NULL) o ON abs(o.f - q.f) <= 2 AND abs(o.g - q.g) <= 2)),
m AS (SELECT f, g, avg(v) AS m FROM (SELECT *, row_number() OVER (PARTITION BY f, g ORDER BY d, k, v) AS r FROM best) WHERE r <= 7 GROUP BY 1, 2)
SELECT k, round(m, 4) AS v FROM p JOIN m USING (f, g) WHERE v IS NULL""")
def impute_knn_lines(t, s):
    lines = t("lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("f"), F.round(F.col("l_discount") * 100).alias("g"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 97 != 0, F.col("l_extendedprice")).alias("v"))
    return rounded(I.impute_knn(lines.withColumn("gap", F.col("v").isNull()), "v", ["f", "g"], "k", 7).where("gap").select("k", "v"))


_CENT = "CAST(round({0} * 100) AS HUGEINT)"


@query(f"""WITH c AS (SELECT l_returnflag, {_CENT.format('l_extendedprice')} AS x, CAST(round(l_quantity) AS HUGEINT) AS y FROM lineitem)
SELECT l_returnflag, round(sum(x) / 100.0, 2) AS total, round(sum(x) / 100.0 / count(*), 6) AS mean, round((sum(x * x) - CAST(sum(x) AS DOUBLE) * sum(x) / count(*)) / (count(*) - 1) / 10000.0, 0) AS var, round(sum(x * y) / 100.0, 2) AS dot, round(sqrt(sum(x * x)) / 100.0, 3) AS norm FROM c GROUP BY 1""")
def stats_exact(t, s):
    x = "l_extendedprice"
    got = EX.exact_aggregates(t("lineitem"), {"total": ("sum", x), "mean": ("mean", x), "var": ("var", x), "dot": ("dot", x, "l_quantity"), "norm": ("norm", x)}, ["l_returnflag"])
    return got.select("l_returnflag", *[F.round(c, n).alias(c) for c, n in (("total", 2), ("mean", 6), ("var", 0), ("dot", 2), ("norm", 3))])


_GU = "((CAST(('0x' || substr(md5('{0}:' || ({1}) || ':' || p_partkey), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _gamma_sql(shape: str, seed: int, name: str) -> str:
    """Common tables ending in ``name`` (p_partkey, value)."""
    return f"""{name}_a AS (SELECT p_partkey, own, i, CASE WHEN own < 1 THEN own + 1 ELSE own END - 1.0 / 3.0 AS d, sqrt(-2 * ln({_GU.format(seed, '3 * i')})) * cos(2 * pi() * {_GU.format(seed, '3 * i + 1')}) AS z, {_GU.format(seed, '3 * i + 2')} AS u
  FROM (SELECT p_partkey, CAST({shape} AS DOUBLE) AS own FROM part), range(12) r(i)),
{name}_b AS (SELECT *, (1 + z / sqrt(9 * d)) ** 3 AS v FROM {name}_a),
{name}_c AS (SELECT p_partkey, own, i, d * v AS value FROM {name}_b WHERE CASE WHEN v > 0 THEN ln(u) < z * z / 2 + d * (1 - v + ln(v)) ELSE false END),
{name} AS (SELECT p_partkey, arg_min(value, i) * CASE WHEN own < 1 THEN pow({_GU.format(seed, '-1')}, 1 / own) ELSE 1 END AS value FROM {name}_c GROUP BY p_partkey, own)"""


@query(f"WITH {_gamma_sql('p_size / 10.0', 4, 'g')} SELECT p_partkey, round(value * 2.5, 6) AS value FROM g")
def generate_gamma(t, s):
    return rounded(t("part").select("p_partkey", (G.draw_gamma(F.col("p_size") / 10, F.col("p_partkey"), 4) * 2.5).alias("value")), 6)


@query(f"WITH {_gamma_sql('p_size / 20.0', 6, 'g')}, {_gamma_sql('p_retailprice / 500.0', 7, 'h')} SELECT p_partkey, round(g.value / (g.value + h.value), 6) AS value FROM g JOIN h USING (p_partkey)")
def generate_beta(t, s):
    return rounded(t("part").select("p_partkey", G.draw_beta(F.col("p_size") / 20, F.col("p_retailprice") / 500, F.col("p_partkey"), 3).alias("value")), 6)


_DAILY = "daily AS (SELECT event_type AS k, date_trunc('day', ts) AS day, sum(value) AS x FROM events GROUP BY 1, 2)"


def _daily(t):
    return t("events").groupBy(F.col("event_type").alias("k"), F.date_trunc("day", F.col("ts")).alias("day")).agg(F.sum("value").alias("x"))


@query(f"""WITH {_DAILY}, p AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY day) AS t, x - avg(x) OVER (PARTITION BY k) AS d, count(*) OVER (PARTITION BY k) AS n FROM daily),
s AS (SELECT a.k, l.lag, abs(sum(a.d * b.d) / any_value(v.v)) AS score FROM p a JOIN range(2, 51) l(lag) ON l.lag <= a.n // 2 JOIN p b ON b.k = a.k AND b.t = a.t - l.lag JOIN (SELECT k, sum(d * d) AS v FROM p GROUP BY 1) v ON v.k = a.k GROUP BY 1, 2),
f AS (SELECT k, arg_min(lag, (-score, lag)) AS lag, max(score) AS score FROM s GROUP BY 1),
o AS (SELECT s.k, s.lag, s.score FROM s JOIN f USING (k) WHERE s.score >= 0.15 AND NOT EXISTS (SELECT 1 FROM range(1, 7) m(i) WHERE abs(s.lag - m.i * f.lag) <= 1 OR abs(f.lag - m.i * s.lag) <= 1)),
g AS (SELECT o.k, arg_min(o.lag, (-o.score, o.lag)) AS lag, max(o.score) AS score FROM o JOIN f USING (k) WHERE f.score >= 0.15 GROUP BY 1)
SELECT k, CAST(1 AS INTEGER) AS place, CAST(lag AS INTEGER) AS period, round(score, 6) AS score FROM f UNION ALL SELECT k, 2, CAST(lag AS INTEGER), round(score, 6) FROM g""")
def series_periods(t, s):
    return rounded(TS.seasonal_periods(_daily(t), "x", ["day"], ["k"], most=2, threshold=0.15), 6)


@query(f"""WITH {_DAILY}, p AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY day) AS t, x - avg(x) OVER (PARTITION BY k) AS d FROM daily)
SELECT k, CAST(q AS INTEGER) AS period, round(any_value(CASE WHEN q = 2 THEN 1.0 ELSE 2.0 END) * (pow(sum(d * cos(2 * pi() * (t % q) / q)), 2) + pow(sum(d * sin(2 * pi() * (t % q) / q)), 2)) / count(*) / sum(d * d), 6) AS power FROM p, range(2, 15) r(q) GROUP BY k, q""")
def series_periodogram(t, s):
    return rounded(TS.periodogram(_daily(t), "x", list(range(2, 15)), ["day"], ["k"]), 6)


# One endless series: windows without keys, scans in parts.

_GAPS = "(SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


@query(f"SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS value FROM {_GAPS}")
def missing_ffill_all(t, s):
    return FR.fill_direction(gappy(t), "value", ["ts", "event_id"]).select("event_id", "value")


@query(f"SELECT event_id, coalesce(value, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) AS value FROM {_GAPS}")
def missing_bfill_all(t, s):
    return FR.fill_direction(gappy(t), "value", ["ts", "event_id"], forward=False, limit=1).select("event_id", "value")


@query(f"SELECT event_id, round(CASE WHEN row_number() OVER (ORDER BY ts, event_id) >= 25 THEN avg(value) OVER (ORDER BY ts, event_id ROWS 24 PRECEDING) END, 4) AS rolled FROM {_GAPS}")
def window_rolling_all(t, s):
    return rounded(FR.rolling(gappy(t), "value", 25, "mean", ["ts", "event_id"], [], "rolled").select("event_id", "rolled"))


@query("SELECT event_id, lag(value, 3) OVER (ORDER BY ts, event_id) AS before, lead(value, 2) OVER (ORDER BY ts, event_id) AS after FROM events")
def window_shift_all(t, s):
    back = FR.shift(t("events").select("event_id", "ts", "value"), "value", 3, ["ts", "event_id"], [], "before")
    return FR.shift(back, "value", -2, ["ts", "event_id"], [], "after").select("event_id", "before", "after")


@query(f"SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM {_GAPS}")
def window_cumsum_all(t, s):
    return rounded(FR.cumulative(gappy(t), "value", "sum", ["ts", "event_id"], [], "total").select("event_id", "total"), 2)


@query(f"SELECT event_id, round(exp(sum(ln(1 + value / 1e6)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 5) AS growth FROM {_GAPS}")
def window_cumprod_all(t, s):
    grown = gappy(t).withColumn("value", 1 + F.col("value") / 1e6)
    return rounded(FR.cumulative(grown, "value", "prod", ["ts", "event_id"], [], "growth").select("event_id", "growth"), 5)


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
s AS (SELECT event_id, n, value AS z FROM p WHERE n = 1 UNION ALL SELECT p.event_id, p.n, 0.3 * p.value + 0.7 * s.z FROM s JOIN p ON p.n = s.n + 1)
SELECT event_id, round(z, 4) AS ema FROM s""")
def series_exponential_all(t, s):
    return rounded(TS.exponential_average(t("events").where("event_type = 'error'").select("event_id", "ts", "value"), "value", 0.3, ["ts", "event_id"], []).select("event_id", "ema"))


# Tall factorisations.


@query("""WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
c AS (SELECT sum((l_quantity - ma) * (l_quantity - ma)) AS aa, sum((l_quantity - ma) * (l_discount - mb)) AS ab, sum((l_discount - mb) * (l_discount - mb)) AS bb, sum((l_quantity - ma) * (l_extendedprice - my)) AS ay, sum((l_discount - mb) * (l_extendedprice - my)) AS dy FROM lineitem, m),
b AS (SELECT (ay * bb - dy * ab) / (aa * bb - ab * ab) AS b1, (dy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c)
SELECT 'intercept' AS term, round(my - b1 * ma - b2 * mb, 3) AS coefficient FROM b, m UNION ALL SELECT 'l_quantity', round(b1, 3) FROM b UNION ALL SELECT 'l_discount', round(b2, 3) FROM b""")
def model_tall_regression(t, s):
    return rounded(FA.tall_regression(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", "coefficient"), 3)


@query("""WITH c AS (SELECT sqrt(sum(l_quantity * l_quantity)) AS r11, sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity)) AS r12, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem)
SELECT round(r11, 3) AS r11, round(r12, 1) AS r12, round(sqrt(q - r12 * r12), 1) AS r22 FROM c""")
def matrix_tall_qr(t, s):
    r = FA.tall_qr(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return s.createDataFrame([(float(r[0, 0]), float(r[0, 1]), float(r[1, 1]))], "r11 double, r12 double, r22 double").select(F.round("r11", 3).alias("r11"), F.round("r12", 1).alias("r12"), F.round("r22", 1).alias("r22"))


@query("""WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice / 50 AS b FROM part),
c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, covar_samp(a, b) AS ab, var_samp(b) AS bb FROM x),
l AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS top FROM c),
v AS (SELECT *, ab / sqrt(ab * ab + (top - aa) * (top - aa)) AS v1, (top - aa) / sqrt(ab * ab + (top - aa) * (top - aa)) AS v2 FROM l)
SELECT p_partkey, round(ma + ((a - ma) * v1 + (b - mb) * v2) * v1, 4) AS a_back, round(mb + ((a - ma) * v1 + (b - mb) * v2) * v2, 4) AS b_back FROM x, v""")
def model_pca_inverse(t, s):
    x = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"))
    model = FA.fit_components(x, ["a", "b"], 1)
    return rounded(FA.from_components(FA.to_components(x, model), model).select("p_partkey", "a_back", "b_back"))


_INVERSE = "list_sum([((i // CAST(pow({0}, k) AS BIGINT)) % {0}) / pow({0}, k + 1) for k in range({1})])"


@query(f"""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS hi, p_retailprice / 1000 AS top FROM part WHERE p_partkey % 10 = 0),
y AS (SELECT p_partkey, i, hi * top * ((hi * {_INVERSE.format(2, 10)}) * (hi * {_INVERSE.format(2, 10)}) + sin(top * {_INVERSE.format(3, 7)})) AS y FROM b, range(1, 513) r(i))
SELECT p_partkey, CAST(n AS INTEGER) AS samples, round(avg(y), 6) AS value FROM y, (VALUES (64), (512)) s(n) WHERE i <= n GROUP BY p_partkey, n""")
def integral_halton(t, s):
    boxes = t("part").where("p_partkey % 10 = 0").select("p_partkey", F.lit(0.0).alias("zero"), (F.col("p_size").cast("double") / 10).alias("hi"), (F.col("p_retailprice") / 1000).alias("top"))
    found = MC.integrate(boxes, "p_partkey", [("zero", "hi"), ("zero", "top")], lambda x, y: x * x + F.sin(y), 512, "halton", repeats=1, sizes=[64])
    return rounded(found.select("p_partkey", "samples", "value"), 6)


_SU = "((CAST(('0x' || substr(md5('2:0:' || s_suppkey || ':' || i), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query(f"""WITH b AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 500 AS hi FROM supplier),
y AS (SELECT s_suppkey, 500 * (sqrt(abs(lo + 500 * u)) + sqrt(abs(lo + 500 * (1 - u)))) / 2 AS y FROM (SELECT *, {_SU} AS u FROM b, range(1, 101) r(i)))
SELECT s_suppkey, CAST(200 AS INTEGER) AS samples, round(avg(y), 4) AS value, round(stddev_samp(y) / sqrt(count(*)), 4) AS std_error FROM y GROUP BY 1""")
def integral_antithetic(t, s):
    boxes = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    return rounded(MC.integrate(boxes, "s_suppkey", [("lo", "hi")], lambda x: F.sqrt(F.abs(x)), 200, "antithetic", seed=2).select("s_suppkey", "samples", "value", "std_error"))


# Joins with rows that only one side has.

_LEFT = "(SELECT c_custkey, CAST(floor(c_acctbal / 5) AS BIGINT) AS bucket FROM customer)"
_RIGHT = "(SELECT s_suppkey, CAST(floor(s_acctbal / 5) AS BIGINT) AS bucket, s_name FROM supplier)"


def _one_sided(how: str):
    def run(t, s):
        left = t("customer").select("c_custkey", F.floor(F.col("c_acctbal") / 5).alias("bucket"))
        right = t("supplier").select("s_suppkey", F.floor(F.col("s_acctbal") / 5).alias("bucket"), "s_name")
        # keys as doubles: absent ones are null in every reader
        return FR.join(left, right, ["bucket"], how=how).select(*[F.col(c).cast("double").alias(c) for c in ("c_custkey", "bucket", "s_suppkey")], "s_name")

    return run


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    add_query(f"join_one_sided_{_how}", _one_sided(_how), f"SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(l.bucket AS DOUBLE) AS bucket, CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name FROM {_LEFT} l {_sql} {_RIGHT} r ON l.bucket = r.bucket")


# Operators that had no query.


@query("""WITH r AS (SELECT l_suppkey % 5 AS t, l_partkey AS b, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT * FROM r WHERE b IN (SELECT b FROM r GROUP BY b HAVING count(*) = 5)),
k AS (SELECT t, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2.0 AS rk FROM c),
s AS (SELECT t, sum(rk) AS s, count(*) AS n FROM k GROUP BY t)
SELECT round(12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1), 4) AS chi2, CAST(count(*) - 1 AS DOUBLE) AS df FROM s""")
def test_friedman(t, s):
    rows = t("lineitem").groupBy((F.col("l_suppkey") % 5).alias("t"), F.col("l_partkey").alias("b")).agg(F.avg("l_extendedprice").alias("v"))
    whole = rows.groupBy("b").agg(F.count("*").alias("n")).where("n = 5").select("b")
    return rounded(I.friedman(rows.join(whole, "b", "left_semi"), "b", "t", "v"))


@query("""WITH x AS (SELECT l_returnflag AS a, l_linestatus || (l_linenumber % 2) AS b, l_extendedprice / 1000 AS v FROM lineitem),
c AS (SELECT a, b, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1, 2),
g AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS cell, count(*) AS k FROM c),
sa AS (SELECT sum(s * s / n) AS ss, count(*) AS k FROM (SELECT a, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1)), sb AS (SELECT sum(s * s / n) AS ss, count(*) AS k FROM (SELECT b, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1)),
z AS (SELECT sa.ss - g.s * g.s / g.n AS ssa, sb.ss - g.s * g.s / g.n AS ssb, g.cell - sa.ss - sb.ss + g.s * g.s / g.n AS inter, g.q - g.cell AS err, sa.k - 1 AS da, sb.k - 1 AS db, (sa.k - 1) * (sb.k - 1) AS di, g.n - g.k AS de FROM g, sa, sb)
SELECT 'a' AS source, round(ssa, 2) AS ss, CAST(da AS DOUBLE) AS df FROM z UNION ALL SELECT 'b', round(ssb, 2), CAST(db AS DOUBLE) FROM z UNION ALL SELECT 'interaction', round(inter, 2), CAST(di AS DOUBLE) FROM z UNION ALL SELECT 'error', round(err, 2), CAST(de AS DOUBLE) FROM z""")
def test_two_way_anova(t, s):
    x = t("lineitem").select(F.col("l_returnflag").alias("a"), F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("b"), (F.col("l_extendedprice") / 1000).alias("v"))
    return rounded(I.anova_twoway(x, "v", "a", "b").select("source", "ss", "df"), 2)


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / (sum((l_quantity - mx) * (l_quantity - mx)) + 100000) AS slope FROM lineitem, m)
SELECT 'intercept' AS term, round(my - slope * mx, 3) AS coefficient FROM b, m UNION ALL SELECT 'l_quantity', round(slope, 3) FROM b""")
def model_ridge(t, s):
    return rounded(I.linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"], ridge=100_000).select("term", "coefficient"), 3)


@query("""WITH p AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, round(sum(d * d) / sum(value * value), 6) AS dw FROM p GROUP BY 1""")
def series_durbin_watson(t, s):
    return rounded(TS.durbin_watson(t("events").select("event_id", "ts", "user_id", "value"), "value", ["ts", "event_id"], ["user_id"]), 6)


@query("""WITH z AS (SELECT event_type, ts, event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS x, (user_id - avg(user_id) OVER w) / stddev_samp(user_id) OVER w AS y FROM events WINDOW w AS (PARTITION BY event_type)),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM z)
SELECT a.event_type, CAST(k AS INTEGER) AS lag, round(avg(a.x * b.y), 6) AS ccf FROM p a JOIN range(-3, 4) r(k) ON true JOIN p b ON b.event_type = a.event_type AND b.n = a.n + k GROUP BY 1, 2""")
def series_cross_correlation(t, s):
    return rounded(TS.cross_correlation(t("events").select("event_id", "ts", "event_type", "value", F.col("user_id").cast("double").alias("user_id")), "value", "user_id", 3, ["ts", "event_id"], ["event_type"]), 6)


@query("""WITH d AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS day FROM events), f AS (SELECT event_type, day, lead(day) OVER (PARTITION BY event_type ORDER BY day) AS nxt, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM d)
SELECT event_type, CASE WHEN date_diff('hour', day, nxt) = 1 THEN 'H' WHEN date_diff('hour', day, nxt) = 24 THEN 'D' WHEN date_diff('hour', day, nxt) = 168 THEN 'W' ELSE 'IRREGULAR' END AS frequency FROM f WHERE n = 1""")
def series_infer_frequency(t, s):
    return TS.infer_frequency(t("events").select("event_type", F.date_trunc("day", "ts").alias("day")).distinct(), "day", ["event_type"])


@query("SELECT l_orderkey AS i, l_linenumber AS j, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2")
def matrix_sum_duplicates(t, s):
    return rounded(X.sum_duplicates(t("lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v"))))


@query("""SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, b.v), 4) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey""")
def missing_fill_from(t, s):
    gaps = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    other = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    return rounded(FR.fill_from(gaps, other, "o_orderkey", "o_totalprice"))


_ORDERED = "WITH s AS (SELECT row_number() OVER (ORDER BY o_orderdate) - 1 AS t, count(*) OVER () AS m, v FROM (SELECT o_orderdate, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1))"
_ANGLE = "2 * pi() * ((a.t * k.t) % a.m) / a.m"
_LINES = f"{_ORDERED}, f AS (SELECT k.t AS k, any_value(k.m) AS m, sum(a.v * cos({_ANGLE})) AS re, -sum(a.v * sin({_ANGLE})) AS im FROM s a, s k GROUP BY 1)"


def _orders_a_day(t):
    return t("orders").groupBy("o_orderdate").agg(F.count("*").cast("double").alias("v"))


@query(f"{_LINES} SELECT k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM f")
def transform_fft_series(t, s):
    return rounded(SP.fft_series(_orders_a_day(t), ["o_orderdate"], "v"), 3)


@query(f"{_LINES} SELECT k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM f WHERE 2 * k <= m")
def transform_fft_chirp(t, s):
    return rounded(SP.rfft_series(_orders_a_day(t), ["o_orderdate"], "v", longest=1), 3)


@query(f"{_ORDERED} SELECT t AS n, round(v, 6) AS v FROM s")
def transform_fft_inverse(t, s):
    days = _orders_a_day(t)
    return rounded(SP.irfft_series(SP.rfft_series(days, ["o_orderdate"], "v"), days.count()), 6)


@query(f"{_LINES} SELECT k, round(CAST(k AS DOUBLE) / m, 9) AS frequency, round(CASE WHEN 2 * k = m THEN 1 ELSE 2 END * (re * re + im * im) / (CAST(m AS DOUBLE) * m), 6) + 0.0 AS power FROM f WHERE k > 0 AND 2 * k <= m")
def series_power_spectrum(t, s):
    return SP.power_spectrum(_orders_a_day(t), ["o_orderdate"], "v").select("k", F.round("frequency", 9).alias("frequency"), F.round("power", 6).alias("power"))
