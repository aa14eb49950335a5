"""Queries of regression, dependence, windows, joins, fronts, sets, solving and discovery."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import api
from ..functions.compile import scrubbed_sql
from ..functions.parse import parse
from ..operators import causal, detect, dynamics, exact, gram, match, pareto, period, project, quantile, regress, robust, series, solve, units
from ..operators.discover import find, ladder_by_key
from ..operators.genetic import Config, fitness, search
from ..sources import feynman, readers
from ..streaming import incremental
from .base import EVENTS, SECONDS, Registry, events, only, rd, rounded, table

R = Registry()
K = ["user_id"]
W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
ALL = "OVER (PARTITION BY user_id)"

# regression


@R.query(f"SELECT l_suppkey, {rd('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {rd('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, {rd('regr_r2(l_extendedprice, l_quantity)')} AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def ols_by_group(spark, sf):
    own = regress.ols_by_group(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return own.select("l_suppkey", rounded("slope", 4).alias("slope"), rounded("intercept", 4).alias("intercept"), rounded("r2").alias("r2"), "n")


_CRAMER = "SELECT l_returnflag, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM (SELECT l_returnflag, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem) GROUP BY 1"
_C1, _C2 = "(say*sbb - sby*sab)/(saa*sbb - sab*sab)", "(sby*saa - say*sab)/(saa*sbb - sab*sab)"


@R.query(f"SELECT l_returnflag, {rd(_C1, 4)} AS c1, {rd(_C2, 3)} AS c2, {rd(f'my - ({_C1})*ma - ({_C2})*mb', 3)} AS c0 FROM ({_CRAMER})")
def ols_two_var(spark, sf):
    own = regress.ols_two(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", ["l_returnflag"])
    return own.select("l_returnflag", rounded("c1", 4).alias("c1"), rounded("c2", 3).alias("c2"), rounded("c0", 3).alias("c0"))


_QUAD = "SELECT covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM (SELECT l_quantity AS a, l_quantity * l_quantity AS b, l_extendedprice AS y FROM lineitem)"


@R.query(f"SELECT {rd(_C1, 3)} AS c1, {rd(_C2, 4)} AS c2, {rd(f'my - ({_C1})*ma - ({_C2})*mb', 2)} AS c0 FROM ({_QUAD})")
def polyfit2(spark, sf):
    f = regress.polyfit(table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "x"), "x", "l_extendedprice", 2)
    return only(spark.createDataFrame([(round(f.coefficients["x"], 3), round(f.coefficients["x^2"], 4), round(f.intercept, 2))], "c1 double, c2 double, c0 double"))


_LOGS = "regr_slope(ln(l_extendedprice), {x}) AS b, exp(regr_intercept(ln(l_extendedprice), {x})) AS a, regr_r2(ln(l_extendedprice), {x}) AS r"
for _k, _x in (("exp", "l_quantity"), ("power", "ln(l_quantity)")):

    def _log(spark, sf, p="exp" if _k == "exp" else "pow"):
        own = regress.log_linear(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
        return own.select(rounded(f"{p}_a", 3).alias("a"), rounded(f"{p}_b").alias("b"), rounded(f"{p}_r2").alias("r2"))

    R.add(f"loglinear_{_k}", _log, f"SELECT {rd('a', 3)} AS a, {rd('b')} AS b, {rd('r')} AS r2 FROM (SELECT {_LOGS.format(x=_x)} FROM lineitem)")


@R.query("SELECT count(*) AS n, " + ", ".join(f"{rd(e, 5)} AS {k}" for k, e in (("lin_r2", "regr_r2(y, x)"), ("quad_r2", "regr_r2(y, x*x)"), ("pow_r2", "regr_r2(ln(y), ln(x))"), ("exp_r2", "regr_r2(ln(y), x)"), ("log_r2", "regr_r2(y, ln(x))"), ("lin_a", "regr_slope(y, x)"))) + " FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)")
def ladder_scores(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    cols = regress.templates("x", "y")
    return only(own.agg(*[cols[k].alias(k) for k in ("n", "lin_r2", "quad_r2", "pow_r2", "exp_r2", "log_r2", "lin_a")]), digits=5)


@R.query(f"WITH e AS (SELECT event_type, value - 50 AS r FROM events), m AS (SELECT event_type, median(r) AS m FROM e GROUP BY 1), d AS (SELECT e.*, abs(r - m) AS d FROM e JOIN m USING (event_type)), k AS (SELECT event_type, median(d) / 0.6745 AS scale FROM d GROUP BY 1 HAVING median(d) > 0) SELECT event_type, {rd('max(scale)')} AS scale, {rd('avg(CASE WHEN r = 0 THEN 1.0 ELSE least(1.0, 1.345 * scale / abs(r)) END)')} AS mean_weight FROM d JOIN k USING (event_type) GROUP BY 1")
def irls_one_step(spark, sf):
    own = table(spark, sf, "events").select("event_type", "value", F.lit(50.0).alias("p"))
    return only(robust.irls_weights(own, "value", "p", ["event_type"]))


_S = {"a": "l_quantity", "b": "l_discount", "c": "l_tax"}


@R.query("SELECT " + ", ".join(f"{rd(f'covar_pop({_S[i]}, {_S[j]})', 7)} AS s{i}{j}" for i in _S for j in _S if i <= j) + ", count(*) AS n FROM lineitem")
def sindy_gram(spark, sf):
    own = table(spark, sf, "lineitem").select(*[F.col(v).alias(k) for k, v in _S.items()])
    g = gram.gram(own, ["a", "b"], "c")
    p = g.product / g.n
    names = list(_S)
    cells = {f"s{names[i]}{names[j]}": float(p[i, j]) for i in range(3) for j in range(i, 3)}
    return only(spark.createDataFrame([(*cells.values(), int(g.n))], ", ".join(f"{k} double" for k in cells) + ", n long"), digits=7)


_T = "SELECT covar_pop(y, x) AS xy, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, count(*) AS n FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)"


@R.query(f"SELECT {rd('sqrt((yy - xy*xy/xx) / (n - 2) / xx)', 5)} AS se, {rd('(xy/xx) / sqrt((yy - xy*xy/xx) / (n - 2) / xx)', 3)} AS t FROM ({_T})")
def coef_t_stat(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    se, t, _ = robust.significance(gram.gram(own, ["x"], "y"))["x"]
    return spark.createDataFrame([(round(float(se), 5), round(float(t), 3))], "se double, t double")


# dependence


@R.query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rd(f'corr({_S[a]}, {_S[b]})')} AS r FROM lineitem" for a in _S for b in _S if a < b))
def corr_matrix(spark, sf):
    own = table(spark, sf, "lineitem").select(*[F.col(v).alias(k) for k, v in _S.items()])
    c, _ = causal.correlations(own, list(_S))
    rows = [(a, b, float(c[i, j])) for i, a in enumerate(_S) for j, b in enumerate(_S) if i < j]
    return only(spark.createDataFrame(rows, "a string, b string, r double"))


_RHO = "SELECT corr(l_quantity, l_discount) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_discount, l_tax) AS bc, count(*) AS n FROM lineitem"


@R.query(f"SELECT {rd('(ab - ac*bc) / sqrt((1 - ac*ac) * (1 - bc*bc))')} AS r FROM ({_RHO})")
def partial_corr(spark, sf):
    own = table(spark, sf, "lineitem").select(*[F.col(v).alias(k) for k, v in _S.items()])
    c, _ = causal.correlations(own, list(_S))
    return only(spark.createDataFrame([(causal.partial_correlation(c, 0, 1, (2,)),)], "r double"))


@R.query(f"SELECT {rd('0.5 * ln((1 + ab) / (1 - ab)) * sqrt(n - 3)')} AS z FROM ({_RHO})")
def fisher_z(spark, sf):
    import math

    own = table(spark, sf, "lineitem").select(*[F.col(v).alias(k) for k, v in _S.items()])
    c, n = causal.correlations(own, list(_S))
    return only(spark.createDataFrame([(math.atanh(float(c[0, 1])) * math.sqrt(n - 3),)], "z double"))


_EDGE = "+".join("CASE WHEN {c} >= (SELECT quantile_cont({c}, " + str(k / 5) + ") FROM lineitem) THEN 1 ELSE 0 END" for k in range(1, 5))


@R.query(f"WITH b AS (SELECT {_EDGE.format(c='l_quantity')} AS i, {_EDGE.format(c='l_extendedprice')} AS j FROM lineitem), c AS (SELECT i, j, count(*) AS o FROM b GROUP BY 1, 2), e AS (SELECT o, sum(o) OVER (PARTITION BY i) * sum(o) OVER (PARTITION BY j) / CAST(sum(o) OVER () AS DOUBLE) AS e FROM c) SELECT {rd('2 * sum(o * ln(o / e))', 4)} AS g2, 16 AS dof FROM e")
def g2_contingency(spark, sf):
    return only(causal.g_squared(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), digits=4)


# windows over events by user

_H = f"(SELECT *, (max(t) {ALL} - min(t) {ALL}) / nullif(count(t) {ALL} - 1, 0) AS h FROM {EVENTS})"


def _series(name, fn, sql):
    R.add(name, lambda spark, sf: only(fn(events(spark, sf))), sql)


_C = f"(lead(value) {W} - lag(value) {W}) / nullif(2*h, 0)"
_ONE = f"coalesce({_C}, (lead(value) {W} - value) / nullif(h, 0), (value - lag(value) {W}) / nullif(h, 0))"
_FOUR = f"(-(lead(value, 2) {W}) + 8*lead(value) {W} - 8*lag(value) {W} + lag(value, 2) {W}) / nullif(12*h, 0)"
R.add("deriv_central", lambda s, d: only(series.finite_difference(events(s, d), "t", "value", K, "event_id"), "event_id", "dx", digits=9), f"SELECT event_id, {rd('dx', 9)} AS dx FROM (SELECT event_id, {_ONE} AS dx FROM {_H})")
R.add("deriv_4th", lambda s, d: only(series.finite_difference(events(s, d), "t", "value", K, "event_id", 4), "event_id", "dx", digits=9), f"SELECT event_id, {rd('dx', 9)} AS dx FROM (SELECT event_id, coalesce({_FOUR}, {_ONE}) AS dx FROM {_H})")
_D2 = f"(SELECT *, (lead(value) {W} - 2*value + lag(value) {W}) / nullif(h*h, 0) AS d2 FROM {_H})"
R.add("deriv_second", lambda s, d: only(series.second_difference(events(s, d), "t", "value", K, "event_id"), "event_id", "d2x", digits=12), f"SELECT event_id, {rd('d2x', 12)} AS d2x FROM (SELECT event_id, coalesce(d2, lead(d2) {W}, lag(d2) {W}) AS d2x FROM {_D2})")
_SG = f"(lag(value, 2) {W} - 8*lag(value) {W} + 8*lead(value) {W} - lead(value, 2) {W}) / 12 / nullif(h, 0)"


@R.query(f"SELECT event_id, {rd('dx', 9)} AS dx FROM (SELECT event_id, {_SG} AS dx FROM {_H}) WHERE dx IS NOT NULL")
def deriv_savgol_interior(spark, sf):
    w = series.order(K, "t", "event_id")
    own = series.savgol_derivative(events(spark, sf), "t", "value", K, "event_id")
    inside = own.withColumn("a", F.lag("value", 2).over(w)).withColumn("b", F.lead("value", 2).over(w)).filter("a is not null and b is not null and dx is not null")
    return only(inside, "event_id", "dx", digits=9)


_series("even_spacing", lambda d: series.even_spacing(d, "t", K, "event_id"), f"SELECT user_id, {rd('m')} AS mean_step, {rd('dev')} AS deviation, coalesce(dev <= 1e-6, false) AS even FROM (SELECT user_id, avg(g) AS m, greatest(max(g) - avg(g), avg(g) - min(g)) / nullif(abs(avg(g)), 0) AS dev FROM (SELECT user_id, t - lag(t) {W} AS g FROM {EVENTS}) WHERE g IS NOT NULL GROUP BY 1)")
_FLAT = f"(SELECT e.*, value - coalesce(s, 0) * t - coalesce(i, 0) AS r FROM {EVENTS} e JOIN (SELECT user_id, regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM {EVENTS} GROUP BY 1) k USING (user_id))"


@R.query(f"WITH e AS (SELECT user_id, event_id, t - (SELECT min({SECONDS}) FROM events) AS t, value FROM {EVENTS}), k AS (SELECT user_id, regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM e GROUP BY 1), f AS (SELECT e.*, value - coalesce(s, 0) * t - coalesce(i, 0) AS r FROM e JOIN k USING (user_id)), x AS (SELECT *, sign(r) * sign(lag(r) {W}) < 0 AS flip FROM f), g AS (SELECT user_id, t - lag(t) {W} AS g FROM x WHERE flip) SELECT user_id, count(*) AS crossings, {rd('median(g)', 3)} AS median_gap FROM g GROUP BY 1")
def zero_crossings(spark, sf):
    own = events(spark, sf)
    first = own.agg(F.min("t").alias("t0"))
    own = own.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("t0"))
    return only(series.zero_crossings(own, "t", "value", K, "event_id"), digits=3)


_LS = f"(SELECT user_id, event_id, ln(event_id) AS lx, ln(value) AS ly FROM events WHERE event_id > 0 AND value > 0)"
_series("local_slopes", lambda d: series.local_slopes(d, "event_id", "value", K, "t").select((F.col("exponent") + 0.0).alias("exponent"), "n"), f"SELECT floor(s * 2 + 0.5) / 2 + 0.0 AS exponent, count(*) AS n FROM (SELECT (ly - lag(ly) OVER w) / nullif(lx - lag(lx) OVER w, 0) AS s FROM {_LS} WINDOW w AS (PARTITION BY user_id ORDER BY lx)) WHERE s IS NOT NULL GROUP BY 1")
_CV = f"(SELECT user_id, lead(value) {W} - 2*value + lag(value) {W} AS d2, (lead(value) {W} - lag(value) {W}) / 2 AS d1 FROM {EVENTS})"
_series("curvature_stats", lambda d: series.curvature(d, "t", "value", K, "event_id").drop("ratio_mean"), f"SELECT user_id, {rd('avg(d2)')} AS d2_mean, {rd('stddev_pop(d2)')} AS d2_std FROM {_CV} WHERE d2 IS NOT NULL GROUP BY 1")
_ST = f"(SELECT *, row_number() {W} - 1 AS k, count(*) {ALL} AS n, value - lag(value) {W} AS d FROM {EVENTS})"
_series("saturation_thirds", lambda d: series.saturation(d, "t", "value", K, "event_id"), f"SELECT user_id, {rd('var_pop(CASE WHEN k < floor(n/3.0) THEN value END) / nullif(var_pop(value), 0)')} AS first_share, {rd('var_pop(CASE WHEN k >= n - floor(n/3.0) THEN value END) / nullif(var_pop(value), 0)')} AS last_share, coalesce(min(d) >= 0, true) AS monotone FROM {_ST} GROUP BY 1")
_N1 = f"(SELECT *, row_number() {W} AS k, lead(value) {W} - value AS d1 FROM {EVENTS})"
_N2 = f"(SELECT *, lead(d1) {W} - d1 AS d2 FROM {_N1})"
_series("newton_differences", lambda d: series.newton_differences(d, "t", "value", K, "event_id", 2), f"SELECT user_id, {rd('max(CASE WHEN k = 1 THEN value END)')} AS d0, {rd('max(CASE WHEN k = 1 THEN d1 END)')} AS d1, {rd('max(CASE WHEN k = 1 THEN d2 END)')} AS d2, {rd('max(abs(d2))')} AS last_size FROM {_N2} GROUP BY 1")
_PE = f"(SELECT *, abs(value - lag(value) {W}) > 50 AS j, (t + lag(t) {W}) / 2 AS m FROM {EVENTS})"
_series("pulse_edges", lambda d: only(series.pulse_edges(d, "t", "value", K, "event_id", 50.0), digits=2), f"SELECT user_id, count(*) AS edges, {rd('min(m)', 2)} AS first_edge, {rd('max(m)', 2)} AS last_edge FROM {_PE} WHERE j GROUP BY 1")
_CL = f"(SELECT user_id, row_number() {W} AS k, count(*) {ALL} AS n, abs(v - first_value(v) OVER f) > 1e-6 AS h, abs(v - last_value(v) OVER f) > 1e-6 AS l FROM (SELECT *, floor(value / 40) AS v FROM {EVENTS}) WINDOW f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_series("clamp_runs", lambda d: series.clamp_runs(d.withColumn("v", F.floor(F.col("value") / 40).cast("double")), "t", "v", K, "event_id").select("user_id", F.col("head_run").cast("long").alias("head_run"), F.col("tail_run").cast("long").alias("tail_run")), f"SELECT user_id, coalesce(min(CASE WHEN h THEN k END) - 1, max(n)) AS head_run, max(n) - coalesce(max(CASE WHEN l THEN k END), 0) AS tail_run FROM {_CL} GROUP BY 1")
_series("cusps", lambda d: series.cusps(d, "t", "value", K, "event_id", 20.0).select("event_id"), f"SELECT event_id FROM (SELECT event_id, value, lag(value) {W} AS p, lead(value) {W} AS n FROM {EVENTS}) WHERE abs(value) < 20 AND abs(p) > 20 AND abs(n) > 20")
_series("near_poles", lambda d: series.near_poles(d, "t", "value", K, "event_id").select("user_id", rounded("pole", 2).alias("pole"), "peak"), f"SELECT user_id, {rd('pole', 2)} AS pole, {rd('peak')} AS peak FROM (SELECT user_id, (t + lead(t) {W}) / 2 AS pole, abs(lead(value) {W}) / nullif(abs(value), 0) AS r, greatest(abs(value), abs(lead(value) {W})) AS peak FROM {EVENTS}) WHERE (r > 10 OR r < 0.1) AND peak > 10")

# recurrences

#: Recurrences from each supplier's own two first terms, forty terms long.
_FIBS = "WITH RECURSIVE f(k, n, x, y) AS (SELECT s_suppkey, 1, CAST(1 + s_suppkey % 5 AS BIGINT), CAST(2 + s_suppkey % 7 AS BIGINT) FROM supplier UNION ALL SELECT k, n + 1, y, x + y FROM f WHERE n < 40) SELECT k, n, x FROM f"


def _recurrence(spark, sf):
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (1 + F.col("s_suppkey") % 5).cast("long").alias("a"), (2 + F.col("s_suppkey") % 7).cast("long").alias("b"))
    terms = F.aggregate(F.sequence(F.lit(3), F.lit(40)), F.array("a", "b"), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(acc, -2))))
    return own.select("k", F.posexplode(terms).alias("n", "x")).withColumn("n", F.col("n") + 1)


@R.query(f"SELECT k, count(*) AS checked, count(CASE WHEN abs(x - s) <= 0.01 THEN 1 END) AS held FROM (SELECT k, x, lag(x, 1) OVER (PARTITION BY k ORDER BY n) + lag(x, 2) OVER (PARTITION BY k ORDER BY n) AS s FROM ({_FIBS})) WHERE s IS NOT NULL GROUP BY k")
def kbonacci_check(spark, sf):
    return series.k_bonacci(_recurrence(spark, sf), "n", "x", ["k"], 2)


@R.query(f"SELECT k, n, x, x - (lag(x, 1) OVER (PARTITION BY k ORDER BY n) + lag(x, 2) OVER (PARTITION BY k ORDER BY n)) AS residual FROM ({_FIBS})")
def linear_recurrence_residual(spark, sf):
    w = series.order(["k"], "n")
    return _recurrence(spark, sf).select("k", "n", "x", (F.col("x") - (F.lag("x", 1).over(w) + F.lag("x", 2).over(w))).alias("residual"))


_IS = "NOT EXISTS (SELECT 1 FROM range(2, 500) d(v) WHERE d.v * d.v <= p_partkey AND p_partkey % d.v = 0) AND p_partkey >= 2"


@R.query(f"WITH p AS (SELECT p_partkey, {_IS} AS prime FROM part), c AS (SELECT *, count(CASE WHEN prime THEN 1 END) OVER (ORDER BY p_partkey) AS x FROM p), d AS (SELECT *, x - lag(x) OVER (ORDER BY p_partkey) AS d FROM c) SELECT {rd('avg(CASE WHEN prime THEN CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END END)')} AS rises, {rd('avg(CASE WHEN NOT prime THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END END)')} AS stays FROM d WHERE d IS NOT NULL")
def prime_steps(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", F.lit(1).alias("k"))
    counted = match.prime_count(own, "p_partkey")
    return only(series.prime_steps(counted, "p_partkey", "prime_count", ["k"]).drop("k"))


# joins


def _law(spark, sf):
    return table(spark, sf, "part").select(((F.col("p_partkey") % 201) - 100).cast("double").alias("x"), "p_partkey").withColumn("y", F.col("x") * F.col("x"))


_LAW = "(SELECT CAST((p_partkey % 201) - 100 AS DOUBLE) AS x FROM part)"


@R.query(f"SELECT count(*) AS pairs, {rd('avg(CASE WHEN abs(a.x*a.x - b.x*b.x) < 1e-6 THEN 1.0 ELSE 0.0 END)')} AS even_share, {rd('avg(CASE WHEN abs(a.x*a.x + b.x*b.x) < 1e-6 THEN 1.0 ELSE 0.0 END)')} AS odd_share FROM {_LAW} a JOIN {_LAW} b ON a.x > 0 AND b.x < 0 AND a.x = -b.x")
def parity_self_join(spark, sf):
    return only(match.parity(_law(spark, sf), "x", "y"))


_G = "(SELECT p_partkey / 4.0::DOUBLE AS x, gamma(p_partkey / 4.0::DOUBLE) AS y FROM part WHERE p_partkey BETWEEN 1 AND 60)"


@R.query(f"SELECT count(*) AS pairs, count(CASE WHEN abs(b.y - a.x*a.y) <= 0.01 * greatest(abs(b.y), 1.0) THEN 1 END) AS held FROM {_G} a JOIN {_G} b ON abs(b.x - (a.x + 1)) < 0.01")
def gamma_recursion_band(spark, sf):
    from ..functions.library import LIBRARY

    own = table(spark, sf, "part").filter("p_partkey between 1 and 60").selectExpr("p_partkey / 4D AS x").selectExpr("x", f"{LIBRARY['gamma'].spark.format('x')} AS y")
    return match.gamma_recursion(own, "x", "y")


_Z = "(SELECT DISTINCT (p_partkey % 41 - 20) / 2.0::DOUBLE AS z FROM part)"


@R.query(f"SELECT DISTINCT a.z FROM {_Z} a JOIN {_Z} b ON a.z > 0 AND b.z < 0 AND abs(a.z + b.z) < 0.01")
def symmetric_zeros(spark, sf):
    own = table(spark, sf, "part").select(((F.col("p_partkey") % 41 - 20) / 2.0).alias("z")).distinct()
    return match.symmetric_zeros(own, "z")


@R.query("SELECT o || '(' || i || ')' AS formula FROM (VALUES ('sin'), ('exp'), ('log')) a(o), (SELECT DISTINCT 'x^' || p_size AS i FROM part) b")
def pole_times_zero_cross(spark, sf):
    """Outer functions of the powers that parts' sizes name."""
    outer = spark.createDataFrame([("sin",), ("exp",), ("log",)], "outer string")
    inner = table(spark, sf, "part").select(F.concat(F.lit("x^"), F.col("p_size").cast("string")).alias("inner")).distinct()
    return match.compositions(outer, inner)


@R.query("SELECT DISTINCT CAST(p_size AS BIGINT) AS c, x, y FROM part JOIN (SELECT x, y FROM range(-10, 11) a(x), range(-10, 11) b(y)) ON x*x + y*y = p_size")
def integer_circle(spark, sf):
    """Whole points of the circles whose squared radius is a part's size."""
    return match.integer_solutions(table(spark, sf, "part").select(F.col("p_size").cast("long").alias("c")), "c", "x*x + y*y")


@R.query(f"SELECT round(CAST(p_size AS DOUBLE), 9) AS x, {rd('max(p_retailprice) - min(p_retailprice)')} AS spread, count(*) AS n FROM part GROUP BY 1 HAVING max(p_retailprice) - min(p_retailprice) > 1e-7")
def conflict_points(spark, sf):
    return only(match.conflicts(table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), "p_retailprice"), ["x"], "p_retailprice"))


@R.query("SELECT p_partkey, p AS pole, abs(x - p) AS distance FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS x FROM part), (VALUES (3.0::DOUBLE), (7.5::DOUBLE)) v(p) WHERE abs(x - p) < 2")
def pole_neighbours(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("x"))
    return match.pole_neighbours(own, spark.createDataFrame([(3.0,), (7.5,)], "pole double"), "x", "pole").select("p_partkey", "pole", "distance")


_KNOWN = "(VALUES " + ", ".join(f"('{n}', {v!r}::DOUBLE)" for n, v in match.CONSTANTS) + ") k(name, v)"


@R.query(f"WITH p AS (SELECT p_partkey, (p_partkey % 1000) / 100.0::DOUBLE AS x FROM part), b AS (SELECT p_partkey, arg_min(name, (abs(x - v), name)) AS constant FROM p JOIN {_KNOWN} ON abs(x - v) < 0.005 GROUP BY 1) SELECT p_partkey, constant FROM p LEFT JOIN b USING (p_partkey)")
def constant_lookup(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 1000) / 100.0).alias("x"))
    return match.constant_lookup(own, "x", 0.005).select("p_partkey", "constant")


@R.query("WITH RECURSIVE n AS (SELECT CAST(v AS BIGINT) AS v FROM range(2, 2001) t(v)), p AS (SELECT v FROM n WHERE NOT EXISTS (SELECT 1 FROM range(2, 46) d(w) WHERE d.w * d.w <= n.v AND n.v % d.w = 0)) SELECT p_partkey, (SELECT count(*) FROM p WHERE p.v <= p_partkey % 2000) AS prime_count FROM part")
def prime_count_lookup(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 2000).alias("x"))
    return match.prime_count(own, "x").select("p_partkey", "prime_count")


_TS = "floor(epoch_us(ts) / 1000000.0 / 60)"
_GRID = f"WITH o AS (SELECT user_id, {_TS} AS t, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2), p AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, unnest(range(CAST(ceil(t/1440) AS BIGINT), CAST(floor(t2/1440) AS BIGINT) + 1)) * 1440.0::DOUBLE AS grid FROM p WHERE t2 IS NOT NULL) SELECT user_id, grid, {rd('value + (grid - t) / (t2 - t) * (v2 - value)', 4)} AS value FROM g WHERE grid < t2"


@R.query(_GRID)
def asof_resample(spark, sf):
    own = events(spark, sf).withColumn("t", F.floor(F.col("t") / 60).cast("double"))
    return only(match.resample(own, "t", "value", K, 1440.0, "event_id"), digits=4)


# fronts and choices: customers as models of (mse, complexity)

_FRONT = "(SELECT c_custkey AS id, round(c_acctbal + 1000, 2) AS mse, CAST(c_custkey % 40 AS BIGINT) AS complexity FROM customer)"


def _models(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") + 1000, 2).alias("mse"), (F.col("c_custkey") % 40).alias("complexity"))


@R.query(f"SELECT a.* FROM {_FRONT} a WHERE NOT EXISTS (SELECT 1 FROM {_FRONT} b WHERE b.complexity <= a.complexity AND b.mse <= a.mse AND (b.complexity < a.complexity OR b.mse < a.mse))")
def pareto_front(spark, sf):
    return pareto.front(_models(spark, sf))


@R.query(f"WITH e AS (SELECT min(mse) AS c0, max(mse) AS c1, min(complexity) AS s0, max(complexity) AS s1 FROM {_FRONT}) SELECT id, mse, complexity FROM {_FRONT}, e ORDER BY mse < 1e-9 DESC, 1 - CAST(complexity - s0 AS DOUBLE) / (s1 - s0) - (mse - c0) / (c1 - c0) DESC, complexity LIMIT 1")
def knee_point(spark, sf):
    return pareto.knee(_models(spark, sf))


@R.query(f"SELECT id, mse, complexity FROM {_FRONT} WHERE complexity <= 10 ORDER BY mse, complexity, id LIMIT 1")
def best_under_budget(spark, sf):
    return pareto.within_budget(_models(spark, sf), 10)


@R.query(f"SELECT id, mse, complexity FROM {_FRONT} ORDER BY complexity, mse, id LIMIT 1")
def simplest_model(spark, sf):
    return pareto.simplest(_models(spark, sf))


@R.query("SELECT name, r FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {rd(f'abs(corr({e}, l_extendedprice))')} AS r FROM lineitem" for n, e in (("x", "l_quantity"), ("x^2", "l_quantity*l_quantity"), ("log(x)", "ln(l_quantity)"), ("d", "l_discount"), ("t", "l_tax"))) + ") ORDER BY r DESC, name LIMIT 3")
def topk_features(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_extendedprice").alias("y"))
    lib = {"x": "x", "x^2": "x^2", "log(x)": "log(x)", "d": "d", "t": "t"}
    wide = project.build_features(own, lib, ["y"])
    c, _ = causal.correlations(wide, [*lib, "y"])
    rows = sorted(((k, round(abs(float(c[i, -1])), 6)) for i, k in enumerate(lib)), key=lambda r: (-r[1], r[0]))[:3]
    return spark.createDataFrame(rows, "name string, r double")


@R.query(f"SELECT island, id, place FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY round(mse, 6), complexity, id) AS place FROM (SELECT *, id % 7 AS island FROM {_FRONT})) WHERE place <= 2")
def tournament_best(spark, sf):
    own = _models(spark, sf).withColumn("island", F.col("id") % 7)
    return series.tournament(own, ["island"], "mse", "complexity", "id", 2).select("island", "id", F.col("place").cast("long").alias("place"))


# sets of seeds

_A, _B = "SELECT p_size % 10 AS k FROM part WHERE p_size < 25", "SELECT p_size % 15 AS k FROM part WHERE p_size >= 25"


def _seed_sets(spark, sf):
    own = table(spark, sf, "part")
    return own.filter("p_size < 25").selectExpr("CAST(p_size % 10 AS BIGINT) AS k"), own.filter("p_size >= 25").selectExpr("CAST(p_size % 15 AS BIGINT) AS k")


R.add("seed_union_distinct", lambda s, d: (lambda a, b: a.union(b).distinct())(*_seed_sets(s, d)), f"SELECT CAST(k AS BIGINT) AS k FROM ({_A} UNION {_B})")
R.add("seed_intersect", lambda s, d: (lambda a, b: a.intersect(b))(*_seed_sets(s, d)), f"SELECT CAST(k AS BIGINT) AS k FROM ({_A} INTERSECT {_B})")
R.add("seed_except", lambda s, d: (lambda a, b: b.subtract(a))(*_seed_sets(s, d)), f"SELECT CAST(k AS BIGINT) AS k FROM ({_B} EXCEPT {_A})")

# equations


@R.query(f"SELECT p_partkey, {rd('-(p_partkey % 50) / CAST(p_size AS DOUBLE)')} AS root FROM part")
def linear_roots(spark, sf):
    own = table(spark, sf, "part")
    lo, _ = solve.quadratic_columns(F.lit(0.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double"))
    return own.select("p_partkey", rounded(lo).alias("root"))


_Q = "(SELECT p_partkey, 1.0::DOUBLE AS a, CAST(p_size AS DOUBLE) AS b, CAST(p_partkey % 50 AS DOUBLE) AS c FROM part)"


@R.query(f"SELECT p_partkey, {rd('CASE WHEN b*b - 4*a*c >= 0 THEN (-b - sqrt(greatest(b*b - 4*a*c, 0)))/(2*a) END')} AS lo, {rd('CASE WHEN b*b - 4*a*c >= 0 THEN (-b + sqrt(greatest(b*b - 4*a*c, 0)))/(2*a) END')} AS hi FROM {_Q}")
def quadratic_roots(spark, sf):
    lo, hi = solve.quadratic_columns(F.lit(1.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double"))
    return table(spark, sf, "part").select("p_partkey", rounded(lo).alias("lo"), rounded(hi).alias("hi"))


@R.query(f"SELECT DISTINCT CAST(p_size AS BIGINT) AS size, {rd('r', 5)} AS root FROM part, (VALUES (0), (1)) v(k), LATERAL (SELECT CASE WHEN k = 0 THEN acos(p_size / 60.0::DOUBLE) ELSE 2 * pi() - acos(p_size / 60.0::DOUBLE) END AS r)")
def bisection_roots(spark, sf):
    """cos(x) = size / 60 between 0 and 2 pi, by sign changes and bisection, for every size of a part."""
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("size")).distinct()
    return only(solve.grid_roots_by(sizes, "cos(x) - size/60", 0.0, 6.28, 500).select("size", "root"), digits=5)


@R.query("SELECT p_partkey, x FROM part JOIN (SELECT x FROM range(0, 105) t(x)) ON x % 3 = p_partkey % 3 AND x % 5 = p_size % 5 AND x % 7 = (p_partkey * p_size) % 7")
def crt_bruteforce(spark, sf):
    """The one number below 105 with three remainders, for every part."""
    own = table(spark, sf, "part")
    residues = [F.col("p_partkey") % 3, F.col("p_size") % 5, F.col("p_partkey") * F.col("p_size") % 7]
    return own.select("p_partkey", solve.crt_column(residues, [3, 5, 7]).alias("x"))


@R.query(f"SELECT p_partkey, {rd('(p*d - b*q)/nullif(a*d - b*c, 0)')} AS x, {rd('(a*q - p*c)/nullif(a*d - b*c, 0)')} AS y FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, 2.0::DOUBLE AS b, 3.0::DOUBLE AS c, CAST(p_partkey % 11 AS DOUBLE) AS d, 1.0::DOUBLE AS p, 5.0::DOUBLE AS q FROM part)")
def system_2x2(spark, sf):
    x, y = solve.cramer_columns(F.col("p_size").cast("double"), F.lit(2.0), F.lit(3.0), (F.col("p_partkey") % 11).cast("double"), F.lit(1.0), F.lit(5.0))
    return table(spark, sf, "part").select("p_partkey", rounded(x).alias("x"), rounded(y).alias("y"))


@R.query("SELECT DISTINCT CAST(p_size AS BIGINT) AS c, x, y FROM part JOIN (SELECT x, y FROM range(-20, 21) a(x), range(-20, 21) b(y)) ON 3*x + 5*y = p_size")
def diophantine_pairs(spark, sf):
    """Whole solutions of 3 x + 5 y = size up to 20 in size, for every size of a part."""
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("c")).distinct()
    return solve.diophantine_rows(sizes, "c", 3, 5, 20)


@R.query("WITH d AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS d FROM part), s AS (SELECT d, y, CAST(round(sqrt(d * y * y + 1)) AS BIGINT) AS x FROM d, range(1, 4000) t(y) WHERE pow(round(sqrt(d)), 2) <> d) SELECT d, min(x) AS x, min(y) AS y FROM s WHERE x * x = d * y * y + 1 GROUP BY d")
def pell_iterates(spark, sf):
    """The least solution of x^2 - size y^2 = 1 for every size of a part that is no square."""

    def run(batches):
        for batch in batches:
            rows = [(d, *solve.pell_solutions(d, 1)[0]) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["d", "x", "y"])

    sizes = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("d")).distinct()
    return sizes.filter(F.pow(F.round(F.sqrt("d")), 2) != F.col("d")).mapInArrow(run, "d long, x long, y long")


@R.query(f"SELECT p_partkey, {rd('CAST(p_size AS DOUBLE) * 4 - 3 * CAST(p_partkey % 11 AS DOUBLE)')} AS det FROM part")
def det2x2(spark, sf):
    """A determinant of literal and column entries, expanded by the parser's matrices."""
    return only(table(spark, sf, "part").select("p_partkey", api.formula("det([[p_size, 3], [mod(p_partkey, 11), 4]])").alias("det")))


_series("trapezoid_integral", lambda d: solve.trapezoid(d.withColumn("t", F.col("t") / 3600), "t", "value", K, "event_id").select("user_id", F.round("integral", 3).alias("integral")), f"SELECT user_id, round(coalesce(sum((value + lv) / 2 * (t - lt)), 0), 3) AS integral FROM (SELECT user_id, t / 3600 AS t, value, lag(value) {W} AS lv, lag(t) {W} / 3600 AS lt FROM {EVENTS}) GROUP BY 1")


@R.query(f"SELECT {rd('x', 6)} AS x, {rd('sin(x) + x', 6)} AS y FROM (SELECT lo + k * ((hi - lo) / 99) AS x FROM range(100) t(k), (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part))")
def curve_sample(spark, sf):
    """A curve over the range of parts' sizes."""
    ends = table(spark, sf, "part").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).first()
    return only(readers.sample_curve(spark, "sin(x) + x", float(ends.lo), float(ends.hi)))


# benchmark equations and populations


def _lattice(name: str) -> str:
    cols = ", ".join(f"{lo!r}::DOUBLE + (id * {k + 3} % 17) * ({(hi - lo) / 17!r}::DOUBLE) AS \"{v}\"" for k, (v, (lo, hi)) in enumerate(feynman.ranges(name).items()))
    return f"(SELECT id, {cols} FROM (SELECT p_partkey AS id FROM part) t)"


def _plain(name: str) -> str:
    """An equation's own text as the other engine reads it: names quoted, its log is natural, its minus signs bind before powers."""
    quoted = re.sub(rf"\b({'|'.join(feynman.ranges(name))})\b", r'"\1"', feynman.EQUATIONS[name])
    return quoted.replace("log(", "ln(").replace("pi", "pi()").replace("exp(-", "exp(0-")


@R.query(f"SELECT name, rows, CASE WHEN m = 0 THEN 0 ELSE floor(log10(abs(m))) END AS decade, {rd('m / pow(10, CASE WHEN m = 0 THEN 0 ELSE floor(log10(abs(m))) END)', 5)} AS mantissa FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, avg(CASE WHEN isfinite(y) THEN y END) AS m FROM (SELECT TRY({_plain(n)}) AS y FROM {_lattice(n)})" for n in feynman.EQUATIONS) + ")")
def feynman_eval(spark, sf):
    """Every equation on a lattice: how many points, and the mean value as mantissa and power of ten."""
    own = feynman.grid(table(spark, sf, "part").select(F.col("p_partkey").alias("id"))).groupBy("name").agg(F.count("*").alias("rows"), F.avg(F.when(project.is_finite(F.col("y")), F.col("y"))).alias("m"))
    decade = F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.floor(F.log10(F.abs("m"))).cast("double"))
    return only(own.select("name", "rows", decade.alias("decade"), (F.col("m") / F.pow(F.lit(10.0), decade)).alias("mantissa")), digits=5)


POPULATION = ["x", "x^2", "x+1", "sin(x)", "cos(x)", "exp(-x)", "log(x)", "sqrt(x)", "x*x-x", "2*x+3", "x/(x+1)", "abs(x-25)", "x^3/100", "tanh(x)", "atan(x)", "1/x", "min(x,10)", "max(x,10)", "floor(x/3)", "x-floor(x/2)"]


@R.query(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS tree, {rd(f'avg((y - p)*(y - p))', 3)} AS mse FROM (SELECT p_retailprice AS y, {f.replace('log(', 'ln(').replace('min(', 'least(').replace('max(', 'greatest(')} AS p FROM (SELECT p_retailprice, CAST(p_size AS DOUBLE) AS x FROM part))" for k, f in enumerate(POPULATION)))
def gp_population_fitness(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    scores = fitness(own, ["x"], "y", [parse(f) for f in POPULATION])
    return only(spark.createDataFrame([(k, float(m)) for k, (_, m) in enumerate(scores)], "tree long, mse double"), digits=3)


# discovery


@R.query("SELECT count(*) AS n, max(abs(p_retailprice - (900 + (p_partkey % 1000) / 10.0::DOUBLE))) < 1e-6 AS holds FROM part")
def discover_part_price_holds(spark, sf):
    own = table(spark, sf, "part")
    found = find(own, ["p_partkey"], "p_retailprice")
    from ..functions.compile import to_column

    return own.select(F.abs(F.col("p_retailprice") - to_column(parse(found.formula))).alias("e")).agg(F.count("*").alias("n"), (F.max("e") < 1e-6).alias("holds"))


_LAD = "SELECT l_suppkey, regr_r2(y, x) AS r0, regr_r2(y, x*x) AS r1, regr_r2(ln(y), ln(x)) AS r2, regr_r2(ln(y), x) AS r3, regr_r2(y, ln(x)) AS r4 FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1"
_BEST = "greatest(" + ", ".join(f"round(coalesce(r{k}, -1), 9)" for k in range(5)) + ")"


@R.query(f"SELECT l_suppkey, CASE {_BEST} WHEN round(r0, 9) THEN 'linear' WHEN round(r1, 9) THEN 'quadratic' WHEN round(r2, 9) THEN 'power' WHEN round(r3, 9) THEN 'exponential' ELSE 'logarithmic' END AS how, {rd(_BEST)} AS r2 FROM ({_LAD})")
def discover_by_supplier(spark, sf):
    """The ladder for every supplier at once."""
    return only(ladder_by_key(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]).select("l_suppkey", "how", "r2"))


@R.query("SELECT CASE WHEN max(p_partkey) >= 1000 THEN '900 + (1/10)*mod(p_partkey, 1000)' ELSE '(1/10)*p_partkey + 900' END AS formula, 0.0::DOUBLE AS mse, 1.0::DOUBLE AS r2, count(*) AS n FROM part")
def discover_part_price(spark, sf):
    return only(find(table(spark, sf, "part"), ["p_partkey"], "p_retailprice").frame(spark), "formula", "mse", "r2", "n")


#: A sawtooth over order keys with gaps, with every other key missing, and with a row in twenty far from it.
_SAW = {
    "period_gapped": ("o_orderkey % 7 <> 3 AND o_orderkey NOT BETWEEN 500 AND 560", "0"),
    "period_stepped": ("o_orderkey % 2 = 0", "0"),
    "period_outliers": ("true", "CASE WHEN (o_orderkey * 7919) % 100 < 5 THEN 1 + (o_orderkey * 104729) % 10007 ELSE 0 END"),
}


def _sawtooth(where: str, off: str):
    def run(spark, sf):
        own = table(spark, sf, "orders").filter(where).select("o_orderkey", F.expr(f"3 + (o_orderkey % 48) / 4.0D + {off}").alias("y"))
        return only(find(own, ["o_orderkey"], "y").frame(spark), "formula", "r2", "n")

    run.__doc__ = "A period is found behind gaps, steps and outliers; n is how many rows are on the law."
    return run


for _name, (_where, _off) in _SAW.items():
    R.add(_name, _sawtooth(_where, _off), f"SELECT '3 + (1/4)*mod(o_orderkey, 48)' AS formula, 1.0::DOUBLE AS r2, count_if(off = 0) AS n FROM (SELECT {_off} AS off FROM orders WHERE {_where})")


@R.query(f"WITH r AS (SELECT o_orderkey::DOUBLE AS x, o_totalprice::DOUBLE AS y FROM orders), m AS (SELECT avg(y) AS m FROM r), s AS (SELECT p::DOUBLE AS length, count(*) AS n, sum((y - m) * cos(2 * pi() * (x / p - floor(x / p)))) AS re, -sum((y - m) * sin(2 * pi() * (x / p - floor(x / p)))) AS im FROM r, m, range(2, 50) AS g(p) GROUP BY p) SELECT length, n, {rd('(re * re + im * im) / n / 1e6', 2)} AS power FROM s")
def fourier_power(spark, sf):
    """Power of order prices at each period from 2 to 49 keys, by partial Fourier sums in one pass."""
    sums = period.fourier_sums(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", list(range(2, 50)))
    return only(sums.select("length", "n", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n") / 1e6).alias("power")), digits=2)


@R.query(f"SELECT CAST(epoch_us(date_trunc('day', ts)) / 1000000 AS BIGINT) AS day, count(*) AS n, {rd('regr_slope(value, event_id)', 5)} AS slope FROM events GROUP BY 1")
def windowed_line(spark, sf):
    """The streaming operator's aggregate over the same rows as a batch."""
    own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    fit = incremental.with_line(incremental.windowed_fit(own, "ts", "event_id", "value", "1 day"))
    day = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(window.start AS TIMESTAMP_NTZ))")
    return fit.select(day.alias("day"), "n", rounded("slope", 5).alias("slope"))


@R.query(f"SELECT event_type, {rd('median(value)')} AS median, {rd('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr, {rd('var_pop(value)', 4)} AS variance, {rd('stddev_pop(value)')} AS deviation FROM events GROUP BY 1")
def robust_stats(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events")
    q = quantile.percentiles(rows, v, [0.25, 0.5, 0.75], ["event_type"])
    own = rows.groupBy("event_type").agg(F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation")).join(q, "event_type").withColumn("median", F.col("__q")[1]).withColumn("iqr", F.col("__q")[2] - F.col("__q")[0])
    return own.select("event_type", rounded("median").alias("median"), rounded("iqr").alias("iqr"), rounded("variance", 4).alias("variance"), rounded("deviation").alias("deviation"))


@R.query(f"SELECT p_partkey, {rd('y / CASE WHEN x / m > 1000 THEN m ELSE 1.0 END')} AS y FROM (SELECT p_partkey, pow(p_size, 6) AS y FROM part), (SELECT quantile_cont(pow(p_size, 6), 0.5) AS m, max(pow(p_size, 6)) AS x FROM part)")
def scale_by_median(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", F.pow("p_size", F.lit(6)).alias("y"))
    return only(project.scale_by_median(own, "y")[0])


@R.query("WITH r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_size AS k FROM part)), s AS (SELECT *, floor(i * 9 / greatest(n - 1, 1)) AS a, floor((i - 1) * 9 / greatest(n - 1, 1)) AS b FROM r) SELECT CAST(k AS BIGINT) AS complexity FROM s WHERE n <= 10 OR i = 0 OR a > b")
def front_trim(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("complexity")).distinct()
    return pareto.trim(own, 10)


_EFF = "SELECT covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem)"


@R.query(f"SELECT {rd(_C1, 3)} AS effect FROM ({_EFF})")
def causal_effect(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_extendedprice").alias("y"))
    graph = causal.Graph(["a", "b", "y"], {("b", "a"), ("a", "y")})
    return spark.createDataFrame([(round(float(causal.effect(own, graph, "a", "y")), 3),)], "effect double")


_NEG = list(project.monomials(["q", "d"], 2, negative=True).values())


@R.query("SELECT p_partkey, " + ", ".join(f"{rd(f if f != '1' else '1.0::DOUBLE')} AS m{k}" for k, f in enumerate(_NEG)) + " FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS q, p_retailprice / 500 AS d FROM part)")
def monomials_negative(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("q"), (F.col("p_retailprice") / 500).alias("d"))
    return only(project.build_features(own, {f"m{k}": f for k, f in enumerate(_NEG)}, ["p_partkey"]))


_SCRUB = parse("log(x - 5)/(x - 10) + sqrt(x - 20)")


@R.query(f"SELECT p_partkey, {rd('CASE WHEN p_size > 5 AND p_size <> 10 THEN ln(p_size - 5) / (p_size - 10) ELSE 0 END + CASE WHEN p_size >= 20 THEN sqrt(p_size - 20) ELSE 0 END')} AS v FROM part")
def scrubbed_evaluation(spark, sf):
    return only(table(spark, sf, "part").select("p_partkey", F.expr(scrubbed_sql(_SCRUB, "spark", {"x": "CAST(p_size AS DOUBLE)"})).alias("v")))


@R.query("SELECT '{\"p_partkey\":' || CAST(p_partkey AS VARCHAR) || ',\"ok\":true,\"v\":' || CAST(p_size AS VARCHAR) || '}' AS json FROM part")
def json_rows(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", F.lit(True).alias("ok"), F.col("p_size").alias("v"))
    return readers.as_json(own)


# without SQL: iterative selections and searches, held by tests to their laws


def _supplier_law(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_quantity") * 3 - F.col("l_discount") * 40 + 7 + (F.col("l_orderkey") % 7) * 0.001).alias("y"))


def _fit_frame(spark, f):
    rows = [(k, round(float(v), 4)) for k, v in f.coefficients.items() if abs(v) > 1e-9] + [("1", round(float(f.intercept), 4))]
    return spark.createDataFrame(rows, "term string, coefficient double")


_LIB = {"q": "q", "d": "d", "t": "t", "q^2": "q^2", "q*d": "q*d", "q*t": "q*t", "log(q)": "log(q)", "sqrt(q)": "sqrt(q)", "d^2": "d^2", "t^2": "t^2", "d*t": "d*t"}


def _lib_gram(spark, sf):
    return gram.gram(project.build_features(_supplier_law(spark, sf), _LIB, ["y"]), list(_LIB), "y")

# y = 3 q - 40 d + 7 and a small pattern: what each method must come to is the least-squares plane of q and d
_PLANE = "SELECT l_quantity AS a, l_discount AS b, l_quantity * 3 - l_discount * 40 + 7 + (l_orderkey % 7) * 0.001::DOUBLE AS y FROM lineitem"
_PLANE = f"SELECT covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, var_pop(y) AS syy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM ({_PLANE})"
_TERMS = f"SELECT 'q' AS term, {rd(_C1, 4)} AS coefficient FROM ({_PLANE}) UNION ALL SELECT 'd', {rd(_C2, 4)} FROM ({_PLANE}) UNION ALL SELECT '1', {rd(f'my - ({_C1}) * ma - ({_C2}) * mb', 4)} FROM ({_PLANE})"
_SSE = f"(n * greatest(syy - ({_C1}) * say - ({_C2}) * sby, 0))"


def _keyed_law(spark, sf):
    return _supplier_law(spark, sf).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@R.query(_TERMS)
def omp_select(spark, sf):
    """Two terms of eleven by orthogonal matching pursuit."""
    return _fit_frame(spark, regress.omp(_lib_gram(spark, sf), 2))


@R.query(_TERMS)
def bfss(spark, sf):
    """The best of all subsets of one to three features."""
    return _fit_frame(spark, regress.best_subsets(_lib_gram(spark, sf)))


@R.query(_TERMS)
def ransac(spark, sf):
    return _fit_frame(spark, robust.ransac(_keyed_law(spark, sf), ["q", "d"], "y", "id", 20)[0])


@R.query(_TERMS)
def irls(spark, sf):
    """Huber weights on residuals without outliers are all one."""
    return _fit_frame(spark, robust.irls(_supplier_law(spark, sf), ["q", "d"], "y", "huber", 5))


@R.query(_TERMS.replace("'d', ", "'100*d', ").replace(rd(_C2, 4), rd(f"({_C2}) / 100", 4)))
def stlsq(spark, sf):
    """Thresholding drops the feature that isn't in the law; lengths of columns are alike, as pruning asks."""
    lib = {"q": "q", "100*d": "100*d", "100*t": "100*t"}
    wide = project.build_features(_supplier_law(spark, sf), lib, ["y"])
    return _fit_frame(spark, regress.stlsq(gram.gram(wide, list(lib), "y"), 0.5))


@R.query(f"SELECT {rd(f'greatest(abs(say) / sqrt(saa), abs(sby) / sqrt(sbb))', 4)} AS top_alpha, 0 AS first_terms, 'q' AS first_feature, true AS holds FROM ({_PLANE})")
def lasso_path(spark, sf):
    """The path starts where all is zero, lets the strongest feature in first, and its best BIC is the law's."""
    g = gram.gram(project.build_features(_supplier_law(spark, sf), {"q": "q", "d": "d", "t": "t"}, ["y"]), ["q", "d", "t"], "y")
    path = regress.lasso_path(g, 24)
    terms = [[k for k, v in f.coefficients.items() if abs(v) > 1e-9] for _, f, _ in path]
    best = min(range(len(path)), key=lambda k: path[k][2])
    first = next((t for t in terms if t), [""])
    return spark.createDataFrame([(round(path[0][0], 4), len(terms[0]), first[0], {"q", "d"} <= set(terms[best]))], "top_alpha double, first_terms int, first_feature string, holds boolean")


@R.query(f"SELECT term, coefficient AS estimate, true AS covers FROM ({_TERMS})")
def bootstrap_ci(spark, sf):
    """Estimates, and whether their intervals hold them."""
    found = robust.bootstrap(_keyed_law(spark, sf), ["q", "d"], "y", "id", 100)
    return spark.createDataFrame([("1" if k == "intercept" else k, round(e, 4), bool(lo <= e <= hi and hi - lo < 0.01)) for k, (e, lo, hi) in found.items()], "term string, estimate double, covers boolean")


@R.query(f"SELECT term, true AS near FROM ({_TERMS})")
def monte_carlo_errors(spark, sf):
    """Means within five standard errors of the fit's, deviations within a third of the textbook's."""
    own = _keyed_law(spark, sf).withColumn("sigma", F.lit(0.1))
    g = gram.gram(own, ["q", "d"], "y")
    inv = np.linalg.inv(g.xx)
    want = dict(zip(("q", "d"), 0.1 * np.sqrt(np.diag(inv)), strict=True)) | {"intercept": 0.1 * float(np.sqrt(1 / g.n + g.mean[:-1] @ inv @ g.mean[:-1]))}
    fit = regress.solve(g, ["q", "d"])
    base = fit.coefficients | {"intercept": fit.intercept}
    rows = [("1" if k == "intercept" else k, bool(abs(m - base[k]) < 5 * want[k] / 200**0.5 and abs(s / want[k] - 1) < 1 / 3)) for k, (m, s) in robust.monte_carlo(own, ["q", "d"], "y", "sigma", "id", 200).items()]
    return spark.createDataFrame(rows, "term string, near boolean")


# Student's quantile at 0.975 by its expansion in 1 / degrees of freedom (error under 1e-6 from 100 on)
_Z = 1.959963984540054
_T = f"({_Z} + {(_Z**3 + _Z) / 4} / (n - 3) + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / ((n - 3) * (n - 3)))"
_DA, _DB = "(l_quantity - ma)", "(l_discount - mb)"
_HALF = f"{_T} * sqrt({_SSE} / (n - 3)) * sqrt(1 + 1.0::DOUBLE / n + ({_DA} * {_DA} * sbb - 2 * {_DA} * {_DB} * sab + {_DB} * {_DB} * saa) / (n * (saa * sbb - sab * sab)))"
_PRED = f"(my + ({_C1}) * {_DA} + ({_C2}) * {_DB})"


@R.query(f"SELECT l_orderkey, l_linenumber, {rd(_PRED, 4)} AS prediction, {rd(f'{_PRED} - {_HALF}', 4)} AS lower, {rd(f'{_PRED} + {_HALF}', 4)} AS upper FROM lineitem, ({_PLANE})")
def prediction_interval(spark, sf):
    own = _supplier_law(spark, sf)
    return only(robust.prediction_interval(own, gram.gram(own, ["q", "d"], "y")), "l_orderkey", "l_linenumber", "prediction", "lower", "upper", digits=4)


@R.query("SELECT * FROM (VALUES ('q', 'y', true), ('d', 'y', true)) AS t (src, dst, directed)")
def pc_skeleton(spark, sf):
    """q and d are independent causes of y, and t is none."""
    own = _supplier_law(spark, sf).withColumn("y", F.col("q") + F.col("d") * 500 + (F.col("l_orderkey") % 7))
    return causal.pc(own, ["q", "d", "t", "y"], 1e-3).frame(spark)


# the derivative of the trigonometric interpolant, by its closed differentiation matrix
_EVEN = "CASE WHEN k = 0 THEN 0 WHEN n % 2 = 0 THEN 0.5 * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END / tan(pi() * k / n) ELSE 0.5 * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END / sin(pi() * k / n) END"


@R.query(f"WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, (max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id)) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0) AS h FROM {EVENTS}), p AS (SELECT a.event_id, a.n, a.h, b.value, a.i - b.i AS k FROM s a JOIN s b USING (user_id)) SELECT event_id, {rd(f'2 * pi() / (n * nullif(h, 0)) * sum(value * ({_EVEN}))', 5)} AS dx FROM p GROUP BY event_id, n, h")
def fft_derivative(spark, sf):
    return only(series.spectral_derivative(events(spark, sf), "t", "value", K, "event_id").select("event_id", "dx"), digits=5)


R.add("tv_derivative", lambda s, d: series.tv_derivative(events(s, d), "t", "value", K, "event_id").select("event_id", "dx"))


@R.query("SELECT true AS solved, true AS small, count(*) AS n, max(CAST(p_size AS DOUBLE) * p_size + 1) AS top FROM part")
def gp_search(spark, sf):
    """x^2 + 1 over the sizes of parts: islands breed on executors, the formula found gives every row, the greatest too."""
    own = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_size") * F.col("p_size") + 1.0).alias("y"))
    best = search(own, ["x"], "y", Config(population=300, islands=3, generations=60, patience=30, seconds=60)).best
    from ..functions.compile import to_column

    row = own.agg(F.count("*").alias("n"), F.round(F.max(to_column(parse(best[0]))), 1).alias("top")).first()
    return spark.createDataFrame([(best[1] < 1e-6, best[2] <= 20, row.n, row.top)], "solved boolean, small boolean, n long, top double")


_Q = "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(CASE WHEN l_quantity = 0 THEN 1 END) AS zeros FROM lineitem"
_D = _Q.replace("l_quantity", "l_discount")


@R.query(f"SELECT '1/q' AS feature, zeros = 0 AS admitted FROM ({_Q}) UNION ALL SELECT 'sqrt(q)', lo >= 0 FROM ({_Q}) UNION ALL SELECT '1/(30-q)', 30 NOT BETWEEN lo AND hi FROM ({_Q}) UNION ALL SELECT '1/(340-q)', 340 NOT BETWEEN lo AND hi FROM ({_Q}) UNION ALL SELECT 'q^10', true UNION ALL SELECT 'q*d', true UNION ALL SELECT 'log(q)', lo > 0 FROM ({_Q}) UNION ALL SELECT 'exp(q)', lo >= -50 AND hi <= 50 FROM ({_Q}) UNION ALL SELECT 'asin(q)', lo > -1 AND hi < 1 FROM ({_Q}) UNION ALL SELECT '1/d', zeros = 0 FROM ({_D}) UNION ALL SELECT 'log(d)', lo > 0 FROM ({_D}) UNION ALL SELECT 'asin(d)', lo > -1 AND hi < 1 FROM ({_D}) UNION ALL SELECT 'q/d', zeros = 0 FROM ({_D}) UNION ALL SELECT 'd/q', zeros = 0 FROM ({_Q})")
def feature_library(spark, sf):
    """Which candidates the library admits, by the extremes and zeros of the whole table."""
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    admitted = project.admissible_features(own, ["q", "d"], 2)
    asked = ["1/q", "sqrt(q)", "1/(30-q)", "1/(340-q)", "q^10", "q*d", "log(q)", "exp(q)", "asin(q)", "1/d", "log(d)", "asin(d)", "q/d", "d/q"]
    return spark.createDataFrame([(f, f in admitted) for f in asked], "feature string, admitted boolean")


def _decay(spark, sf):
    """A series for each customer: t and x = a e^-t, a of its own."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 7).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("id"))
    return own.withColumn("t", F.col("id") * 0.01).withColumn("x", F.col("a") * F.exp(-F.col("t")))


@R.query("SELECT 'sparse' AS method, 'dx/dt = -x' AS equation, count(*) * 80 AS n FROM customer UNION ALL SELECT 'linear', 'y'' + y = 0', count(*) * 80 FROM customer")
def ode_discover(spark, sf):
    own = _decay(spark, sf)
    n = own.count()
    return spark.createDataFrame([("sparse", e, n) for e in dynamics.sindy(own, "t", ["x"], ["k"], "id").equations()] + [("linear", dynamics.linear_ode(own, "t", "x", ["k"], "id")[0], n)], "method string, equation string, n long")


@R.query("SELECT 'y + y'''' = 0' AS equation, true AS small, count(*) * 80 AS n FROM customer")
def implicit_ode(spark, sf):
    """Sines of any phase satisfy the oscillator's equation."""
    own = _decay(spark, sf).withColumn("x", F.col("a") * F.sin(F.col("t") * 5 + F.col("k")) / 5)
    own = own.withColumn("t", F.col("t") * 5)
    equation, residual = dynamics.implicit_ode(own, "t", "x", ["k"], "id", 1)
    return spark.createDataFrame([(equation, residual < 1e-3, own.count())], "equation string, small boolean, n long")


@R.query("SELECT * FROM (VALUES ('x', 1.0::DOUBLE), ('x^2', -1.0::DOUBLE), ('1', 0.0::DOUBLE)) AS t (term, coefficient), (SELECT count(*) * 80 AS n FROM customer)")
def autonomous_ode(spark, sf):
    """Logistic curves, begun anywhere, have the law x (1 - x)."""
    own = _decay(spark, sf).withColumn("t", F.col("t") * 4).withColumn("x", 1 / (1 + F.exp(F.col("a") - 4 - F.col("t"))))
    return only(_fit_frame(spark, dynamics.autonomous(own, "t", "x", ["k"], "id", 2)), digits=2).withColumn("n", F.lit(own.count()))


#: Right sides of y'' = g(y, y'), and the equations that are to be found.
_MOTIONS = {"pendulum": (lambda y, v: -np.sin(y), "y'' + sin(y) = 0"), "damped pendulum": (lambda y, v: -2 * np.sin(y) - 0.3 * v, "y'' + 0.3*y' + 2*sin(y) = 0"), "van der Pol": (lambda y, v: (1 - y * y) * v - y, "y'' - y' + y^2*y' + y = 0")}


def _motion(spark, sf, g):
    """A motion for each customer, begun by its balance: integrated for a batch of them at once."""

    def run(batches):
        h, steps = 0.02, 150
        for batch in batches:
            k, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            rhs = lambda s: np.stack([s[1], g(s[0], s[1])])
            path = np.stack(list(series.rk4(rhs, np.stack([y, np.zeros_like(y)]), h * np.arange(steps))))[:, 0]
            for lo in range(0, len(k), 500):
                part = path[:, lo : lo + 500]
                ids = np.repeat(np.arange(steps), part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(k[lo : lo + 500], steps)), pa.array(ids), pa.array(ids * h), pa.array(part.reshape(-1))], ["k", "id", "t", "x"])

    starts = table(spark, sf, "customer").select("c_custkey", (0.3 + F.pmod(F.floor(F.col("c_acctbal")), F.lit(23)) / 9).alias("y"))
    # a row becomes 150: they are dealt to all cores first, and the series to tasks of two million rows at most on average
    cores, rows = spark.sparkContext.defaultParallelism, starts.count() * 150
    made = starts.repartition(4 * cores, "c_custkey").mapInArrow(run, "k long, id long, t double, x double")
    return made.repartition(max(cores, rows // 2_000_000 + 1), "k")


@R.query(" UNION ALL ".join("SELECT '{}' AS motion, '{}' AS equation, count(*) * 150 AS n FROM customer".format(name, text.replace("'", "''")) for name, (_, text) in _MOTIONS.items()))
def ode_search(spark, sf):
    """Non-linear equations of motion, by a search over sums of expressions of y, y' and y''."""
    found = []
    for name, (g, _) in _MOTIONS.items():
        equation = dynamics.search_ode(_motion(spark, sf, g), "t", "x", ["k"], "id")
        found.append((name, equation.text, equation.rows))
    return spark.createDataFrame(found, "motion string, equation string, n long")


#: Tests of independence between columns of lineitem: (a, b, given).
_TESTS = [("l_quantity", "l_extendedprice", ()), ("l_quantity", "l_discount", ()), ("l_quantity", "l_tax", ("l_discount",)), ("l_extendedprice", "l_tax", ()), ("l_quantity", "l_extendedprice", ("l_discount", "l_tax")), ("l_discount", "l_tax", ("l_quantity",))]


def _strata_sql(a: str, b: str, given: tuple[str, ...]) -> str:
    by = lambda *cols: f"PARTITION BY {', '.join([*cols, *given])}" if cols or given else ""
    names = ", ".join([a, b, *given])
    cells = f"SELECT {names}, sum(o) AS o FROM cells GROUP BY {names}"
    stratum = " || '-' || ".join(given) if given else "''"
    e = f"SELECT o, {stratum} AS z, sum(o) OVER ({by(a)}) * sum(o) OVER ({by(b)}) / CAST(sum(o) OVER ({by()}) AS DOUBLE) AS e, sum(o) OVER ({by()}) AS n FROM ({cells})"
    return f"SELECT '{a}' AS a, '{b}' AS b, '{' '.join(given)}' AS given, {rd('2 * sum(o * ln(o / e))', 3)} AS g2, CAST(16 * count(DISTINCT z) AS INTEGER) AS dof FROM ({e}) WHERE n >= 10"


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@R.query(f"WITH cells AS (SELECT {', '.join(f'{_EDGE.format(c=c)} AS {c}' for c in _COLUMNS)}, count(*) AS o FROM lineitem GROUP BY ALL) " + " UNION ALL ".join(_strata_sql(*t) for t in _TESTS))
def g2_cube(spark, sf):
    """Independence of several pairs, some given others' bins: one pass over the rows, one over the counts."""
    cells = causal.cube(table(spark, sf, "lineitem"), _COLUMNS)
    named = spark.createDataFrame([(k, a, b, " ".join(given)) for k, (a, b, given) in enumerate(_TESTS)], "test int, a string, b string, given string")
    return only(causal.g_tests(cells, _TESTS).join(F.broadcast(named), "test"), "a", "b", "given", "g2", "dof", digits=3)


_BENT = "SELECT (o_orderkey * 7919) % 1001 - 500.0::DOUBLE AS x, (o_orderkey * 104729) % 997 - 498.0::DOUBLE AS z, pow((o_orderkey * 7919) % 1001 - 500.0::DOUBLE, 2) + (o_orderkey * 31) % 50 AS y FROM orders"


def _bent_edge(c: str) -> str:
    return "+".join(f"CASE WHEN {c} >= (SELECT quantile_cont({c}, {k / 5}) FROM r) THEN 1 ELSE 0 END" for k in range(1, 5))


def _bent_sql(a: str, b: str) -> str:
    g2 = f"(SELECT 2 * sum(o * ln(o / e)) FROM (SELECT o, sum(o) OVER (PARTITION BY i) * sum(o) OVER (PARTITION BY j) / CAST(sum(o) OVER () AS DOUBLE) AS e FROM (SELECT {_bent_edge(a)} AS i, {_bent_edge(b)} AS j, count(*) AS o FROM r GROUP BY ALL)))"
    z = f"(SELECT abs(0.5 * ln((1 + corr({a}, {b})) / (1 - corr({a}, {b})))) * sqrt(count(*) - 3) FROM r)"
    # quantiles at 0.001: the normal's at 0.0005 either side, chi-square's at 16 degrees of freedom
    return f"SELECT '{a}' AS a, '{b}' AS b, {z} > 3.2905267 AS fisher, {g2} > 39.2523548 AS g2"


@R.query(f"WITH r AS ({_BENT}) " + " UNION ALL ".join(_bent_sql(*p) for p in (("x", "y"), ("x", "z"), ("y", "z"))))
def pc_bent(spark, sf):
    """A parabola's two sides cancel in a correlation: skeletons by partial correlation miss it, those by counts find it."""
    own = table(spark, sf, "orders").select((F.col("o_orderkey") * 7919 % 1001 - 500.0).alias("x"), (F.col("o_orderkey") * 104729 % 997 - 498.0).alias("z"), (F.col("o_orderkey") * 31 % 50).alias("u"))
    own = own.withColumn("y", F.col("x") * F.col("x") + F.col("u"))
    graphs = {test: causal.pc(own, ["x", "y", "z"], 1e-3, test) for test in ("fisher", "g2")}
    edges = {test: {frozenset(e) for e in g.directed | g.undirected} for test, g in graphs.items()}
    return spark.createDataFrame([(a, b, frozenset((a, b)) in edges["fisher"], frozenset((a, b)) in edges["g2"]) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))], "a string, b string, fisher boolean, g2 boolean")


_FAR = "(l_orderkey * 7919 + l_linenumber * 104729) % 10 < 4"
_WILD = "3*l_quantity + 500*l_discount + 7"


@R.query(f"SELECT 'l_quantity' AS term, 3.0::DOUBLE AS coefficient, s AS share FROM (SELECT round(avg(CASE WHEN {_FAR} THEN 0.0 ELSE 1.0 END), 6) AS s FROM lineitem) UNION ALL SELECT 'l_discount', 500.0, s FROM (SELECT round(avg(CASE WHEN {_FAR} THEN 0.0 ELSE 1.0 END), 6) AS s FROM lineitem) UNION ALL SELECT '1', 7.0, s FROM (SELECT round(avg(CASE WHEN {_FAR} THEN 0.0 ELSE 1.0 END), 6) AS s FROM lineitem)")
def ransac_two_fifths(spark, sf):
    """A plane that two rows in five are far from, all on one side: least squares misses it, consensus doesn't."""
    own = table(spark, sf, "lineitem").withColumn("y", F.expr(f"{_WILD} + if({_FAR}, 900 + (l_orderkey * 31 + l_linenumber * 17) % 997, 0)")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    fit, share = robust.ransac(own, ["l_quantity", "l_discount"], "y", "id")
    return only(_fit_frame(spark, fit), digits=4).withColumn("share", F.round(F.lit(share), 6))


#: Twelve times a polynomial of lineitem's columns, as a whole number.
_TWELVE = "9*l_quantity*l_quantity - 24*l_linenumber*l_quantity + 10*round(100*l_discount) + 7"


@R.query(f"SELECT term, coefficient, (SELECT count(*) FROM lineitem) AS n, (SELECT bool_and(abs(({_TWELVE}) / 12.0::DOUBLE - (0.75::DOUBLE*l_quantity*l_quantity - 2*l_linenumber*l_quantity + 250.0::DOUBLE/3*l_discount + 7.0::DOUBLE/12)) < 1e-6) FROM lineitem) AS holds FROM (VALUES ('l_quantity^2', '3/4'), ('l_quantity*l_linenumber', '-2'), ('l_discount', '250/3'), ('1', '7/12')) AS t (term, coefficient)")
def exact_table_polynomial(spark, sf):
    """The polynomial in fractions that all rows satisfy, from one pass of sums modulo primes."""
    own = table(spark, sf, "lineitem").withColumn("y", F.expr(_TWELVE))
    found = exact.table_polynomial(own, {"l_quantity": 0, "l_linenumber": 0, "l_discount": 2}, "y") or {}
    n = own.count()
    return spark.createDataFrame([(k, str(v / 12), n, bool(found)) for k, v in found.items()], "term string, coefficient string, n long, holds boolean")


@R.query("SELECT 'x^3 - 2*x' AS formula, count(*) AS n FROM nation")
def exact_interpolation(spark, sf):
    """Newton's polynomial in fractions through a point for each nation."""
    points = [(int(r.k), int(r.v)) for r in table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.pow("n_nationkey", F.lit(3)) - 2 * F.col("n_nationkey")).alias("v")).orderBy("k").collect()]
    return spark.createDataFrame([(exact.polynomial_text(exact.interpolate(points)), len(points))], "formula string, n long")


@R.query("WITH o AS (SELECT x, x * x AS y, lag(x * x) OVER (ORDER BY x, p_partkey) AS py FROM (SELECT p_partkey, CAST((p_partkey % 201) - 100 AS DOUBLE) AS x FROM part)) SELECT count(*) AS n, count(*) AS whole, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, count(CASE WHEN abs(y - py) > 0.5 THEN 1 END) AS jumps, count(CASE WHEN y * py < 0 THEN 1 END) AS flips, count(CASE WHEN abs(y) < 0.01 AND abs(py) > 0.01 THEN 1 END) AS falls, bool_and(coalesce(y >= py, true)) AS monotone, 1.0::DOUBLE AS is_square, round(avg(CASE WHEN abs(y - x) <= 1e-6 * greatest(1, y) THEN 1.0 ELSE 0.0 END), 9) AS is_floor, round(avg(CASE WHEN abs(y - greatest(x, 0)) <= 1e-6 * greatest(1, y) THEN 1.0 ELSE 0.0 END), 9) AS is_relu FROM o")
def detect_patterns(spark, sf):
    """What one pass over sorted rows says about a square."""
    own = detect.detect(_law(spark, sf), "x", "y", "p_partkey")
    falls = _law(spark, sf).withColumn("py", F.lag("y").over(series.order([], "x", "p_partkey"))).agg(F.count_if((F.abs("y") < 0.01) & (F.abs("py") > 0.01)).alias("falls"))
    return only(own.crossJoin(falls), "n", "whole", "x_lo", "x_hi", "y_lo", "y_hi", "jumps", "flips", "falls", "monotone", "is_square", "is_floor", "is_relu", digits=9)
@R.query("SELECT name, true AS succeeds, count(*) AS n FROM (VALUES ('I.12.1'), ('I.14.4'), ('I.39.1')) AS t (name), part GROUP BY name")
def feynman_benchmark(spark, sf):
    """Three of the equations at points that parts' keys give, half of them for training: the formula found explains the others."""
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    found = feynman.run_on(keys, ["I.12.1", "I.14.4", "I.39.1"])
    return found.select("name", (F.col("exact") | (F.col("r2") > 0.999)).alias("succeeds"), "n")


# readers, flags and residuals


@R.query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice FROM part")
def csv_round_trip(spark, sf):
    """A table written as CSV and read back by the reader, which finds names and types."""
    path = f"{quantile.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), "p_retailprice").write.option("header", True).csv(path)
    return readers.read_csv(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))


@R.query(f"WITH d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events)) SELECT user_id, {rd('avg(g)', 4)} AS mean_step FROM d WHERE g IS NOT NULL GROUP BY 1")
def mean_steps(spark, sf):
    """Mean distance of neighbours in each series."""
    return only(series.even_spacing(events(spark, sf), "t", ["user_id"], "event_id").select("user_id", "mean_step"), digits=4)


@R.query("SELECT p_partkey, coalesce(list_bool_and(list_transform(range(2, p_size), lambda d: p_size % d <> 0)), true) AND p_size > 1 AS prime FROM part")
def prime_flags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.coalesce(match.is_prime(F.col("p_size").cast("long")), F.lit(False)).alias("prime"))


@R.query("SELECT p_partkey, (p_retailprice - m) / s AS residual FROM part, (SELECT 900.0::DOUBLE AS m, max(abs(p_retailprice - 900)) AS s FROM part)")
def amplified_residual(spark, sf):
    """What a formula leaves, scaled to unit size."""
    return detect.residual_amplified(table(spark, sf, "part"), "900", "p_retailprice").select("p_partkey", "residual")
