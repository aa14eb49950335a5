"""Queries of scans, filters, scalar functions, projections and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compile import complex_sql, to_column
from ..functions.library import BINARY, LIBRARY, UNARY
from ..functions.parse import parse
from ..functions.registry import Registry as Functions
from ..operators import loss, project
from ..sources import readers
from .base import EVENTS, Registry, events, only, rd, rounded, table
from .definitions import DEFINITIONS, DIGITS

R = Registry()

# scans and filters


@R.query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part WHERE p_size <= 25")
def scan_project(spark, sf):
    """Filter and columns reach the scan."""
    return table(spark, sf, "part").filter("p_size <= 25").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")


@R.query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part WHERE p_size > 5 AND p_size <= 25")
def file_loader(spark, sf):
    """The loader makes every column a number; a parsed predicate filters."""
    own = readers.read(spark, f"{sf}/part.parquet").filter(to_column(parse("5 < p_size <= 25")) != 0)
    return own.select("p_partkey", "p_size", "p_retailprice")


@R.query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part")
def scan_try_cast(spark, sf):
    """Text columns as numbers: names are trimmed, what is no number is NaN (null here), a column without numbers goes."""
    text = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias(" p_partkey "), "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("odd").alias("size"))
    return only(project.to_doubles(text))


@R.query(f"SELECT event_id, {rd('value')} AS value FROM events WHERE value IS NOT NULL AND isfinite(value) AND isfinite(CASE WHEN value > 1 THEN ln(value) ELSE 'NaN'::DOUBLE END)")
def filter_finite(spark, sf):
    own = table(spark, sf, "events").withColumn("l", F.expr("CASE WHEN value > 1 THEN ln(value) ELSE double('NaN') END"))
    return only(project.finite_rows(own, "value", "l"), "event_id", "value")


PIECES = "Piecewise((q*2, q < 10), (q + 10, q < 30), (40, True))"


@R.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_quantity * 2 WHEN l_quantity < 30 THEN l_quantity + 10 ELSE 40.0 END AS piece FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 45")
def filter_predicate_piecewise(spark, sf):
    own = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity")).filter(to_column(parse("5 < q <= 45")) != 0)
    return own.select("l_orderkey", "l_linenumber", to_column(parse(PIECES)).alias("piece"))


OUTLIER = {
    "mad": "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT e.*, abs(value - m) AS d FROM events e JOIN m USING (event_type)), k AS (SELECT event_type, median(d) AS mad FROM d GROUP BY 1) SELECT event_id, d > 3.5 * mad / 0.6745 AS is_outlier FROM d JOIN k USING (event_type)",
    "iqr": "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events JOIN q USING (event_type)",
    "zscore": "WITH q AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, abs(value - m) > 3 * s AS is_outlier FROM events JOIN q USING (event_type)",
}
for _m, _sql in OUTLIER.items():
    R.add(f"outlier_{_m}", lambda spark, sf, m=_m: project.outliers(table(spark, sf, "events"), "value", m, ["event_type"]).select("event_id", "is_outlier"), _sql)

# scalar functions: each over arguments made of part's columns

_X = "(p_partkey % 97) / 16.0 - 3.0"
ARGUMENTS = {  # name -> arguments (exact in binary)
    "factorial": ("p_partkey % 21 + 0.0",), "gcd": ("p_partkey + 0.0", "p_size + 0.0"), "lcm": ("p_partkey + 0.0", "p_size + 0.0"), "binomial": ("p_partkey % 20 + 0.0", "p_size % 20 + 0.0"),
    "gamma": ("(p_partkey % 97) / 16.0 + 0.25",), "fibonacci": ("p_partkey % 30 + 0.0",), "lucas": ("p_partkey % 30 + 0.0",), "primepi": ("p_partkey % 997 + 0.0",), "exp": ("(p_partkey % 97) / 16.0 - 3.0",),
    "root": ("(p_partkey % 97) / 16.0 + 1.0", "p_size % 5 + 1.0"), "pow": ("(p_partkey % 97) / 16.0 + 0.25", "p_size % 5 - 2.0"), "gp_pow": ("(p_partkey % 97) / 16.0 + 0.25", "p_size % 5 - 2.0"),
    **{k: ("p_partkey % 97 + 0.0", "p_size + 0.0") for k in ("bitwise_and", "bitwise_or", "bitwise_xor")}, **{k: ("p_partkey % 97 + 0.0", "p_size % 8 + 0.0") for k in ("lshift", "rshift")},
    "besselj0": ("(p_partkey % 97) / 4.0 - 12.0",), "besselj1": ("(p_partkey % 97) / 4.0 - 12.0",), "lambertw": ("(p_partkey % 97) / 8.0 - 0.25",), "if": (f"{_X} + 1", "p_size + 0.0", "p_partkey + 0.0"),
}


def _arguments(name: str, dialect: str) -> list[str]:
    default = (_X, "p_size % 9 - 3.5", "p_size + 0.0")
    args = ARGUMENTS.get(name, default)[: LIBRARY[name].arity]
    return [f"CAST({a} AS DOUBLE)" if dialect == "spark" else f"CAST({a.replace('16.0', '16.0::DOUBLE').replace('4.0 -', '4.0::DOUBLE -').replace('8.0 -', '8.0::DOUBLE -')} AS DOUBLE)" for a in args]


def _scalar(name: str):
    def run(spark, sf):
        args = [f"a{k}" for k in range(LIBRARY[name].arity)]
        own = table(spark, sf, "part").selectExpr("p_partkey", *[f"{a} AS a{k}" for k, a in enumerate(_arguments(name, "spark"))])
        return only(own.selectExpr("p_partkey", f"CAST({LIBRARY[name].spark.format(*args)} AS DOUBLE) AS value"), digits=DIGITS.get(name, 6))

    inner = ", ".join(f"{a} AS a{k}" for k, a in enumerate(_arguments(name, "duck")))
    sql = f"SELECT p_partkey, {rd('v', DIGITS.get(name, 6))} AS value FROM (SELECT p_partkey, CAST({DEFINITIONS[name]} AS DOUBLE) AS v FROM (SELECT p_partkey, {inner} FROM part))"
    return run, sql


_seen: set[str] = set()
for _name in [*UNARY.values(), *BINARY.values(), *LIBRARY]:
    if _name not in _seen and not any(_name != k and LIBRARY[_name] is LIBRARY[k] for k in _seen):
        R.add(f"eval_{_name}", *_scalar(_name))
    _seen.add(_name)


# complex values

COMPLEX = {"mul": "a*b", "div": "a/b", "sqrt": "sqrt(a)", "exp": "exp(a)", "log": "log(a)", "pow": "a^2"}
_PARTS = {"a": ("ar", "ai"), "b": ("br", "bi")}
for _k, _f in COMPLEX.items():

    def _complex(spark, sf, f=_f):
        own = table(spark, sf, "part").selectExpr("p_partkey", "CAST((p_partkey % 13) - 6 AS DOUBLE) AS ar", "CAST((p_size % 7) - 3 AS DOUBLE) AS ai", "CAST((p_partkey % 5) + 1 AS DOUBLE) AS br", "CAST((p_size % 3) - 1 AS DOUBLE) AS bi")
        re, im = complex_sql(parse(f), "spark", _PARTS)
        return only(own.selectExpr("p_partkey", f"{re} AS re", f"{im} AS im"))

    _re, _im = complex_sql(parse(_f), "duck", _PARTS)
    R.add(f"eval_complex_{_k}", _complex, f"SELECT p_partkey, {rd('re')} AS re, {rd('im')} AS im FROM (SELECT p_partkey, {_re} AS re, {_im} AS im FROM (SELECT p_partkey, CAST((p_partkey % 13) - 6 AS DOUBLE) AS ar, CAST((p_size % 7) - 3 AS DOUBLE) AS ai, CAST((p_partkey % 5) + 1 AS DOUBLE) AS br, CAST((p_size % 3) - 1 AS DOUBLE) AS bi FROM part))")

# user functions


@R.query(f"SELECT p_partkey, {rd('CAST(2 * p_size * p_size + 1.0 AS DOUBLE)')} AS v FROM part")
def user_function_inlined(spark, sf):
    f = Functions()
    f.define("f(x) = 2x^2 + 1")
    f.register(spark, "f")
    table(spark, sf, "part").createOrReplaceTempView("lodestar_part")
    return only(spark.sql("SELECT p_partkey, f(CAST(p_size AS DOUBLE)) AS v FROM lodestar_part"))


@R.query(f"SELECT p_partkey, {rd('CAST((p_size + 1.0) * (p_size + 1.0) - (p_size - 1.0) AS DOUBLE)')} AS v FROM part")
def nested_function_call(spark, sf):
    f = Functions()
    f.define("a(x) = x + 1")
    f.define("g(x, y) = a(x)^2 - y")
    return only(table(spark, sf, "part").select("p_partkey", to_column(f.expand("g(p_size, p_size - 1)")).alias("v")))


# projections

BOUNDS = ["x", "x^2", "1/x", "sqrt(x)", "log(x)"]


@R.query("SELECT " + ", ".join(f"{rd(f'min({e})')} AS lo_{k}, {rd(f'max({e})')} AS hi_{k}, count(CASE WHEN isfinite({e}) THEN 1 END) AS n_{k}" for k, e in enumerate(["l_quantity", "l_quantity * l_quantity", "1.0 / l_quantity", "sqrt(l_quantity)", "ln(l_quantity)"])) + " FROM lineitem")
def feature_library_bounds(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"))
    wide = project.build_features(own, {f"f{k}": f for k, f in enumerate(BOUNDS)}, [])
    return wide.agg(*[c for k in range(len(BOUNDS)) for c in (rounded(F.min(f"f{k}")).alias(f"lo_{k}"), rounded(F.max(f"f{k}")).alias(f"hi_{k}"), F.count_if(project.is_finite(F.col(f"f{k}"))).alias(f"n_{k}"))])


@R.query(f"SELECT p_partkey, 1.0::DOUBLE AS f0, {rd('x')} AS f1, {rd('y')} AS f2, {rd('x*x')} AS f3, {rd('x*y')} AS f4, {rd('y*y')} AS f5, {rd('sin(x)')} AS f6, {rd('cos(x)')} AS f7, {rd('sin(y)')} AS f8, {rd('cos(y)')} AS f9 FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x, p_retailprice / 1000 AS y FROM part)")
def sindy_library(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    lib = project.sindy_library(["x", "y"], 2, trig=True)
    return only(project.build_features(own, {f"f{k}": f for k, f in enumerate(lib.values())}, ["p_partkey"]))


@R.query(f"SELECT p_partkey, {rd('x')} AS m0, {rd('y')} AS m1, {rd('x*x')} AS m2, {rd('x*y')} AS m3, {rd('y*y')} AS m4 FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x, p_retailprice / 1000 AS y FROM part)")
def monomials_deg2(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    lib = [f for f in project.monomials(["x", "y"], 2).values() if f != "1"]
    return only(project.build_features(own, {f"m{k}": f for k, f in enumerate(lib)}, ["p_partkey"]))


@R.query(f"SELECT l_orderkey, l_linenumber, {rd('(l_quantity - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END')} AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def standardise(spark, sf):
    return only(project.standardise(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]))


@R.query(f"SELECT o_orderkey, {rd('(o_totalprice - lo) / (hi - lo)')} AS o_totalprice_scaled FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def minmax_scale(spark, sf):
    return only(project.minmax(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"), "o_orderkey", "o_totalprice_scaled")


@R.query(f"SELECT c_custkey, {rd('CASE WHEN c_acctbal > 1e-10 THEN ln(c_acctbal) END')} AS log_y, {rd('CASE WHEN abs(c_acctbal) > 1e-10 THEN 1.0 / c_acctbal END', 9)} AS inverse_y FROM customer")
def log_inverse_targets(spark, sf):
    own = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    t = project.target_transforms(own, "c_acctbal")
    out = own.select("c_custkey").join(t["log"].withColumnRenamed("c_acctbal", "log_y"), "c_custkey", "left").join(t["inverse"].withColumnRenamed("c_acctbal", "inverse_y"), "c_custkey", "left")
    return out.select("c_custkey", rounded("log_y").alias("log_y"), rounded("inverse_y", 9).alias("inverse_y"))


# losses: price of a part against the straight line through its law

_P, _Y = "900 + (p_partkey % 1000) / 10.0::DOUBLE + p_size / 100.0::DOUBLE", "p_retailprice"


def _fit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("y"), F.expr("900 + (p_partkey % 1000) / 10D + p_size / 100D").alias("p"))


_FIT = f"(SELECT p_partkey, p_size, {_Y} AS y, {_P} AS p FROM part)"


@R.query(f"SELECT {rd('avg((y-p)*(y-p))')} AS mse, {rd('sqrt(avg((y-p)*(y-p)))')} AS rmse FROM {_FIT}")
def mse_rmse(spark, sf):
    m = loss.mse(F.col("y"), F.col("p"))
    return only(_fit(spark, sf).agg(m.alias("mse"), F.sqrt(m).alias("rmse")))


@R.query(f"SELECT {rd('avg(pow((y-p)/(abs(y)+eps), 2))', 12)} AS relative_mse FROM {_FIT}, (SELECT greatest(quantile_cont(abs(p_retailprice), 0.5) * 1e-10, 1e-100) AS eps FROM part)")
def relative_mse(spark, sf):
    return only(loss.relative_mse(_fit(spark, sf), "y", "p"), digits=12)


@R.query(f"SELECT {rd('avg(CASE WHEN abs(y-p) <= 0.25 THEN 0.5*(y-p)*(y-p) ELSE 0.25*(abs(y-p)-0.125) END)')} AS huber FROM {_FIT}")
def huber_loss(spark, sf):
    return only(_fit(spark, sf).agg(loss.huber(F.col("y"), F.col("p"), 0.25).alias("huber")))


_SST = "(sum(y*y) - sum(y)*sum(y)/count(y))"


@R.query(f"SELECT {rd(f'1 - sum((y-p)*(y-p))/{_SST}')} AS r2, {rd(f'1 - (sum((y-p)*(y-p))/{_SST})*(count(y)-1)/(count(y)-3)')} AS adjusted FROM {_FIT}")
def r2_adj(spark, sf):
    y, p = F.col("y"), F.col("p")
    return only(_fit(spark, sf).agg(loss.r2(y, p).alias("r2"), loss.adjusted_r2(y, p, 2).alias("adjusted")))


@R.query(f"SELECT {rd('count(y)*ln(avg((y-p)*(y-p))) + 6', 4)} AS aic, {rd('count(y)*ln(avg((y-p)*(y-p))) + 3*ln(count(y))', 4)} AS bic FROM {_FIT}")
def aic_bic(spark, sf):
    y, p = F.col("y"), F.col("p")
    return only(_fit(spark, sf).agg(loss.aic(y, p, 3).alias("aic"), loss.bic(y, p, 3).alias("bic")), digits=4)


@R.query(f"SELECT {rd('max(abs(y-p))')} AS max_residual, bool_and(abs(y-p) < 1e-10 OR abs(y-p) < 1e-8*abs(y)) AS exact FROM {_FIT}")
def max_residual(spark, sf):
    y, p = F.col("y"), F.col("p")
    return only(_fit(spark, sf).agg(loss.max_residual(y, p).alias("max_residual"), loss.exact_fit(y, p).alias("exact")))


@R.query(f"SELECT {rd('sum(w*(y-p)*(y-p))/sum(w)')} AS weighted FROM (SELECT y, p, CASE WHEN abs(p_size) = near THEN 5.0 WHEN p_size = floor(p_size) THEN 3.0 ELSE 1.0 END AS w FROM {_FIT}, (SELECT min(abs(p_size)) AS near FROM part))")
def weighted_anchor_mse(spark, sf):
    own = loss.anchor_weights(_fit(spark, sf), "p_size")
    return only(own.agg(loss.mse(F.col("y"), F.col("p"), F.col("weight")).alias("weighted")))


@R.query(f"SELECT {rd('max(abs(o_totalprice)) / quantile_cont(abs(o_totalprice), 0.5)')} AS skew_ratio, {rd('max(o_totalprice) - min(o_totalprice)', 2)} AS y_range FROM orders")
def skew_ratio(spark, sf):
    own = loss.skew_ratio(table(spark, sf, "orders"), "o_totalprice")
    return own.select(rounded("skew_ratio").alias("skew_ratio"), rounded("y_range", 2).alias("y_range"))


_GAPS = "(SELECT s, LAG(x) OVER (PARTITION BY s ORDER BY x, k) AS px, LAG(y) OVER (PARTITION BY s ORDER BY x, k) AS py, x, y FROM (SELECT l_suppkey AS s, l_quantity AS x, l_linenumber * 5.0 AS y, l_orderkey * 8 + l_linenumber AS k FROM lineitem))"


@R.query(f"SELECT slope, count(*) AS n FROM (SELECT floor((y - py) / (x - px) * 2 + 0.5) / 2 + 0.0 AS slope FROM {_GAPS} WHERE x <> px) GROUP BY 1 HAVING count(*) >= 2")
def slope_histogram(spark, sf):
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 5.0).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return loss.slope_histogram(own, "x", "y", ["s"], "k").select((F.col("slope") + 0.0).alias("slope"), "n")


@R.query("SELECT arg_max(gap, n * 1e9 - gap) AS gap, max(n) AS n FROM (SELECT gap, count(*) AS n FROM (SELECT round(x - LAG(x) OVER (PARTITION BY s ORDER BY x), 3) AS gap FROM (SELECT l_suppkey AS s, l_quantity AS x FROM lineitem)) WHERE gap IS NOT NULL GROUP BY 1)")
def modal_gap(spark, sf):
    return loss.modal_gap(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x")), "x", ["s"])


@R.query("SELECT p_brand, bit_or(CAST(p_size AS BIGINT)) AS or_y, bit_and(CAST(p_size AS BIGINT)) AS and_y, min(xor(p_partkey, CAST(p_size AS BIGINT))) AS xor_lo, max(xor(p_partkey, CAST(p_size AS BIGINT))) AS xor_hi FROM part GROUP BY 1")
def bit_reduce(spark, sf):
    return loss.bit_reduce(table(spark, sf, "part"), "p_partkey", "p_size", ["p_brand"])


@R.query("SELECT min(xor(p_partkey, xor(p_partkey, 5))) = max(xor(p_partkey, xor(p_partkey, 5))) AS constant, min(xor(p_partkey, xor(p_partkey, 5))) AS k FROM part")
def xor_constant(spark, sf):
    own = table(spark, sf, "part").withColumn("y", F.expr("p_partkey ^ 5L"))
    return loss.bit_reduce(own, "p_partkey", "y").select((F.col("xor_lo") == F.col("xor_hi")).alias("constant"), F.col("xor_lo").alias("k"))


@R.query(f"SELECT p_brand, {rd('avg(CASE WHEN floor(p_retailprice) = p_retailprice THEN 1.0 ELSE 0.0 END)')} AS rate FROM part GROUP BY 1")
def match_rate_floor(spark, sf):
    return only(table(spark, sf, "part").groupBy("p_brand").agg(loss.match_rate(F.floor("p_retailprice") == F.col("p_retailprice")).alias("rate")))


_RESULTS = "(SELECT p_brand AS method, CAST(p_size % 3 AS BIGINT) AS noise, p_size % 2 = 0 AS exact, p_retailprice / 2000 AS r2 FROM part)"


@R.query(f"SELECT method, noise, count(*) AS n, {rd('avg(CASE WHEN exact OR r2 > 0.999 THEN 1.0 ELSE 0.0 END)')} AS success_rate, {rd('avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END)')} AS exact_rate, {rd('avg(r2)')} AS mean_r2 FROM {_RESULTS} GROUP BY ROLLUP (method, noise)")
def bench_rollup(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_brand").alias("method"), (F.col("p_size") % 3).cast("long").alias("noise"), (F.col("p_size") % 2 == 0).alias("exact"), (F.col("p_retailprice") / 2000).alias("r2"))
    return only(loss.benchmark_rollup(own))


@R.query(f"SELECT user_id, {rd('avg(value)')} AS mean_value, count(*) AS n FROM {EVENTS} GROUP BY 1")
def json_results(spark, sf):
    """Rows through JSON text and back."""
    from ..sources.readers import as_json

    own = events(spark, sf).groupBy("user_id").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    return only(as_json(own).select(F.from_json("json", "user_id long, mean_value double, n long").alias("r")).select("r.*"))


_FORM = parse("(2x + 1)/(x^2 + 1) + mod(x, 3) - abs(x - 20)")


@R.query(f"SELECT p_partkey, {rd('(2.0::DOUBLE * p_size + 1) / (p_size * p_size + 1) + p_size % 3 - abs(p_size - 20)')} AS v FROM part")
def formula_evaluation(spark, sf):
    return only(table(spark, sf, "part").select("p_partkey", to_column(_FORM, {"x": "CAST(p_size AS DOUBLE)"}).alias("v")))
