"""Laws go in, formulas come out: values agree on the points, whatever the rows' order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import ast
from lodestar.functions.compile import evaluate
from lodestar.functions.parse import parse
from lodestar.operators import causal, detect, dynamics, genetic, gram, quantile, regress, robust, series
from lodestar.operators.discover import find, from_points
from lodestar.sources import readers
from lodestar.streaming import incremental

LAWS = {
    "square": ([1, 2, 3, 4, 5], lambda x: x * x),
    "line": ([0, 1, 2], lambda x: 2 * x + 5),
    "cosine": ([0, math.pi / 2, math.pi, 2 * math.pi], math.cos),
    "double sine": ([0.3, 0.7, 1.1, 2.0], lambda x: math.sin(2 * x)),
    "cube": ([1, 2, 3, 4, 5], lambda x: 2 * x**3),
    "damped": ([0.2 * k for k in range(10)], lambda x: math.exp(-x) * math.cos(2 * x)),
    "entropy": ([0.1 + 0.3 * k for k in range(10)], lambda x: -5 * x * math.log(x)),
    "x exp": ([0.1 + 0.2 * k for k in range(10)], lambda x: x * math.exp(x)),
    "power of two": ([0, 1, 2, 3, 4, 5], lambda x: 2.0**x),
    "inverse": ([1, 2, 4, 5], lambda x: 3 / x),
}


@pytest.mark.parametrize("name", LAWS)
def test_laws_in_one_variable(spark, name):
    xs, law = LAWS[name]
    points = [(x, law(x)) for x in xs]
    found = find(from_points(spark, points, ["x"]), ["x"], "y")
    for x, y in points:
        assert evaluate(parse(found.formula), x=float(x)) == pytest.approx(y, rel=1e-6, abs=1e-6)


def test_laws_in_more_variables(spark):
    rng = np.random.default_rng(3)
    r = rng.uniform(1, 5, (15, 3))
    for law in (lambda a, b, c: 9000 * a * b / c**2, lambda a, b, c: 0.5 * a * b**2 + 9.8 * a * c, lambda a, b, c: a * b / c):
        found = find(from_points(spark, [(tuple(map(float, v)), float(law(*v))) for v in r], ["a", "b", "c"]), ["a", "b", "c"], "y")
        for v in r:
            assert evaluate(parse(found.formula), a=float(v[0]), b=float(v[1]), c=float(v[2])) == pytest.approx(law(*v), rel=1e-5)


def test_conflicting_points_are_an_error(spark):
    with pytest.raises(ValueError, match="apart"):
        find(from_points(spark, [(1, 1), (1, 2), (2, 3)], ["x"]), ["x"], "y")


def test_gram_ways_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 12))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, x @ np.arange(12) + 4]], ", ".join(f"c{k} double" for k in range(13)))
    wide = gram.gram(df, [f"c{k}" for k in range(12)], "c12")
    few = gram.gram(df, ["c1", "c2"], "c12")
    assert np.allclose(wide.part(["c1", "c2"]).product, few.product)
    fit = gram.solve(wide)
    assert fit.intercept == pytest.approx(4) and fit.coefficients["c7"] == pytest.approx(7)
    assert set(k for k, v in regress.omp(wide, 12).coefficients.items() if abs(v) > 1e-6) == {f"c{k}" for k in range(1, 12)}


def test_robust_fits_ignore_an_outlier(spark):
    df = spark.createDataFrame([(k, float(k), 100.0 if k == 3 else 2.0 * k) for k in range(20)], "id long, x double, y double")
    for fit in (robust.irls(df, ["x"], "y", "tukey"), robust.ransac(df, ["x"], "y", "id", 30)[0]):
        assert fit.coefficients["x"] == pytest.approx(2, abs=1e-3)
    lo_hi = robust.bootstrap(df.filter("id <> 3"), ["x"], "y", "id", 50)["x"]
    assert lo_hi[1] == pytest.approx(2) and lo_hi[2] == pytest.approx(2)


def test_sindy_and_simulation(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), "id", (F.col("id") * 0.01).alias("t")).withColumn("x", F.exp(-F.col("t")))
    model = dynamics.sindy(df, "t", ["x"], ["k"], "id", 1, 0.5)
    assert model.fits["x"].coefficients["x"] == pytest.approx(-1, abs=1e-3)
    assert model.simulate([1.0], np.linspace(0, 1, 50))[-1, 0] == pytest.approx(math.exp(-1), rel=1e-2)
    assert dynamics.linear_ode(df.withColumn("x", F.sin("t")), "t", "x", ["k"], "id")[0] == "y'' + y = 0"


def test_causal_chain(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=1000)
    b = a + 0.5 * rng.normal(size=1000)
    c = b + 0.5 * rng.normal(size=1000)
    d = rng.normal(size=1000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[a, b, c, d]], "a double, b double, c double, d double")
    g = causal.pc(df, ["a", "b", "c", "d"], 0.001)
    edges = {frozenset(e) for e in g.directed | g.undirected}
    assert edges == {frozenset("ab"), frozenset("bc")}


def test_search_finds_a_square(spark):
    df = spark.createDataFrame([(float(k), float(k * k + k)) for k in range(-10, 11)], "x double, y double")
    found = genetic.search(df, ["x"], "y", genetic.Config(population=150, islands=2, generations=40, seconds=20))
    assert found.best[1] < 1e-6
    again = genetic.search(df, ["x"], "y", genetic.Config(population=150, islands=2, generations=40, seconds=20))
    assert again.best[0] == found.best[0]


def test_detectors(spark):
    t = lambda rows: from_points(spark, rows, ["x"])
    assert "bitwise_xor(x, 5)" in detect.seeds(t([(k, k ^ 5) for k in range(20)]), "x", "y")
    assert "floor(x)" in detect.seeds(t([(k / 2, math.floor(k / 2)) for k in range(20)]), "x", "y")
    assert detect.modulo(t([(k / 4, (k / 4) % 1.5) for k in range(60)]), "x", "y") == 1.5
    assert detect.integer_ratio(t([(k, (k * k + 1) / (k + 1)) for k in range(1, 12)]), "x", "y") == "(x^2 + 1)/(x^1 + 1)"


def test_savgol_is_exact_on_cubics(spark):
    df = spark.range(12).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("t")).withColumn("x", F.pow("t", F.lit(3)) - F.col("t"))
    for r in series.savgol_derivative(df, "t", "x", ["k"], "id").collect():
        assert r.dx == pytest.approx(3 * r.t**2 - 1, abs=1e-8)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x, y ,note\n1,1,a\n2,4,b\n3,oops,c\n")
    df = readers.read(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and math.isnan(df.filter("x = 3").first().y)
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert readers.read(spark, str(tmp_path / "b.csv")).columns == ["col0", "col1"]
    assert readers.inline_arrays(spark, "x=[1, 2], y=[pi/2, 3]").count() == 2
    assert readers.split_target(["a", "b", "y"]) == (["a", "b"], "y")
    assert "*" in readers.ascii_plot(readers.sample_curve(spark, "x^2"))


def test_stream_equals_batch(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, "ts", "event_id", "value", "fits", window="1 day")
    q.processAllAvailable()
    q.stop()
    want = {r.window.start: r.n for r in incremental.windowed_fit(events, "ts", "event_id", "value", "1 day").collect()}
    got = {r.window.start: r.n for r in spark.sql("select * from fits").collect()}
    assert got == want


def test_ladder_by_key(spark):
    from lodestar.operators.discover import ladder_by_key

    rows = [("a", float(x), 3.0 * x + 1) for x in range(1, 9)] + [("b", float(x), 2.0 * x**2.5) for x in range(1, 9)] + [("c", float(x), -math.exp(x) + 1) for x in range(1, 9)]
    got = {r.k: r for r in ladder_by_key(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert (got["a"].how, got["a"].formula) == ("linear", "3.0*x + 1.0")
    assert got["b"].how == "power" and got["b"].b == pytest.approx(2.5)
    assert got["c"].how in ("linear", "quadratic", "logarithmic") and got["c"].r2 < 1


def test_symbols_among_points(spark):
    from lodestar.operators.discover import infer_symbols

    assert infer_symbols(spark, [(1, 2), (2, 4), (3, 6), ("a", 10), (7, "b")], ["x"]) == {"a": "5", "b": "14"}


def test_implicit_equation(spark):
    df = spark.range(400).select(F.lit(1).alias("k"), "id", (F.col("id") * 0.01).alias("t")).withColumn("x", F.sin("t"))
    text, residual = dynamics.implicit_ode(df, "t", "x", ["k"], "id", 1)
    assert text.replace("1*", "") == "y + y'' = 0" and residual < 1e-4


def test_cache(tmp_path):
    from lodestar import api

    api.cache.clear()
    assert api.evaluate("2 + 3").result == "5" and api.evaluate("2 + 3").result == "5"
    assert (api.cache.hits, api.cache.misses) == (1, 1)
    api.cache.save(str(tmp_path / "c.json"))
    api.cache.clear()
    assert api.cache.load(str(tmp_path / "c.json")) == 1 and api.evaluate("2 + 3").approx == "5" and api.cache.hits == 1


@pytest.mark.parametrize(("rows", "period"), [(1_200_000, 1000), (1_700_000, 500_000)])
def test_periods_beyond_a_million_keys(spark, rows, period):
    from lodestar.operators import discover

    df = spark.range(1, rows + 1).select("id", (900 + (F.col("id") % period) / 10).alias("y"))
    assert [f for _, f in discover.periodic(df, "id", "y")] == [f"900 + (1/10)*mod(id, {period})"]
    # many rows of few keys
    assert [f for _, f in discover.periodic(spark.range(1_100_000).select((F.col("id") % 40).alias("k"), (F.col("id") % 40 % 7).cast("double").alias("y")), "k", "y")] == ["mod(k, 7)"]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_any_size_are_exact(spark, keys):
    """The narrowing path, forced by a small limit, against the plain one: ties, heavy tails, huge and equal values."""
    rng = np.random.default_rng(9)
    values = np.r_[rng.normal(size=3000), np.exp(rng.normal(size=3000) * 20), np.zeros(500), [1e308, -1e308, 1e-300]]
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)] + [("c", 5.0)] * 700 + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {tuple(r[k] for k in keys): r["__q"] for r in quantile.percentiles(df, F.col("v"), probs, keys, limit=40).collect()}
    for key in {tuple(r[:1]) if keys else () for r in rows if r[1] is not None}:
        own = np.array([v for k, v in rows if v is not None and (not keys or k == key[0])])
        lo, hi = np.quantile(own, probs, method="lower"), np.quantile(own, probs, method="higher")
        at = np.array(probs) * (len(own) - 1)
        assert got[key] == pytest.approx((lo + (hi - lo) * (at - np.floor(at))).tolist(), rel=1e-9, abs=1e-12)
    assert quantile.median(df.filter("k = 'd'"), F.col("v")) is None


def test_commands(spark, tmp_path):
    from lodestar import cli

    (tmp_path / "d.csv").write_text("x,y\n" + "\n".join(f"{k},{k * k + 1}" for k in range(1, 30)) + "\n")
    path = tmp_path / "d.csv"
    assert cli.run("find dimensionless F=N, rho=kg/m^3, v=m/s, L=m")["groups"] == ["F^(1)*rho^(-1)*v^(-2)*L^(-2)"]
    assert cli.run("health")["ok"] is True
    assert cli.run("timing on")["timing"] and "seconds" in cli.run("2 + 2") and "timing" in cli.run("timing off")
    assert cli.run(f"h f(x) from {path}")["mse"] < 1e-9
    got = cli.run(f"evolve f(x) --file {path} --polynomial --seed x^2 --verbose --hp")
    assert "sin" not in got["formula"] and got["front"] and float(got["mse_50_digits"]) == pytest.approx(got["mse"], abs=1e-6)
    assert ("x", "y") in {tuple(sorted(e)) for v in cli.run(f"discover causal from {path}").values() for e in v}
    assert cli.run("benchmark I.12.1")["succeeded"] == 1


def test_fifty_digits(spark):
    from decimal import Decimal, localcontext

    with localcontext() as c:
        c.prec = 50
        assert abs(genetic.precise(parse("sin(x)^2 + cos(x)^2"), {"x": Decimal("123.4")}) - 1) < Decimal("1e-46")
        assert str(genetic.precise(parse("pi"), {}))[:42] == "3.1415926535897932384626433832795028841971"
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(5)], "x double, y double")
    assert genetic.precise_mse(df, "x^2", ["x"], "y") == 0


def test_shared_subexpressions_lose_nothing():
    from lodestar.operators import islands

    breeder = genetic.Breeder(["x", "z"], genetic.Config(population=200, seeds=("x^2", "pi*sin(x)")))
    trees = breeder.initial()
    assert [islands.decode(islands.encode(t)) for t in trees] == trees
    rng = np.random.default_rng(1)
    x, y = {"x": rng.normal(size=50), "z": rng.uniform(1, 2, 50)}, rng.normal(size=50)
    shared = islands.Shared(trees)
    assert np.allclose(shared.losses(x, y, 1.35), genetic._losses(trees, x, y, 1.35), rtol=1e-9, equal_nan=True)
    assert len(shared.steps) < sum(ast.size(t) for t in trees) / 2


def test_islands_breed_on_executors_and_move(spark):
    from lodestar.operators import islands

    df = spark.range(20_000).select((F.col("id") % 997 / 100).alias("x"), (F.col("id") % 89).cast("double").alias("z")).withColumn("y", F.col("x") * F.col("z") + F.col("x"))
    c = genetic.Config(population=80, islands=3, generations=20, migration_every=5, seconds=120, sample=150)
    one, made = islands.evolve(df, ["x", "z"], "y", c)
    two, again = islands.evolve(df, ["x", "z"], "y", c)
    assert made == again and [islands.encode(t) for t, _ in one] == [islands.encode(t) for t, _ in two]
    errors = [m for _, m in one]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.2 * errors[0]
    # rows that islands draw: bounded, and all of them get some
    sizes = {r["__island"]: r["count"] for r in islands.drawn(df, 20_000, c, 3).groupBy("__island").count().collect()}
    assert set(sizes) == {0, 1, 2} and all(60 < v < 300 for v in sizes.values())


def test_search_keeps_rows_unseen_and_scores_all(spark):
    df = spark.range(3000).select((F.col("id") / 100).alias("x")).withColumn("y", 2 * F.col("x") + 3)
    found = genetic.search(df, ["x"], "y", genetic.Config(population=120, islands=2, generations=40, seconds=60, sample=200))
    assert found.best[1] < 0.05
    exact = genetic.fitness(df, ["x"], "y", [parse(f) for f, _, _ in found.front])
    assert [m for _, m in exact] == pytest.approx([m for _, m, _ in found.front], rel=1e-3, abs=1e-6)
    assert genetic.winner([(1.0, 5), (0.5, 9), (0.51, 3)], 0.05) == 2 and genetic.winner([(1.0, 5), (0.5, 9), (0.51, 3)], None) == 1


def test_exact_polynomials_of_tables(spark):
    from fractions import Fraction

    from lodestar.operators import exact

    df = spark.range(5000).select((F.col("id") % 71 - 30).alias("a"), (F.col("id") % 43).alias("b"), (F.col("id") % 13 / 100).alias("c")).withColumn("twice", 2 * F.col("a"))
    y = F.expr("14*a*a*b - 21*b + 6*a + 35")
    assert exact.table_polynomial(df.withColumn("y", y), {"a": 0, "b": 0}, "y", 0, 3) == {"a^2*b": 14, "b": -21, "a": 6, "1": 35}
    # decimals, a column that depends on another, large numbers, nulls, one wrong row, no rows
    cents = df.withColumn("y", F.expr("cast(round(300*c) + a as double) / 10"))
    assert exact.table_polynomial(cents, {"a": 0, "twice": 0, "c": 2}, "y", 1, 1) == {"a": Fraction(1, 10), "c": 30}
    huge = df.withColumn("y", F.expr("cast(1000000007 as bigint)*a*a + 999999937"))
    assert exact.table_polynomial(huge.union(huge.limit(3).withColumn("y", F.lit(None).cast("bigint"))), {"a": 0}, "y") == {"a^2": 1000000007, "1": 999999937}
    assert exact.table_polynomial(df.withColumn("y", F.when(F.col("a") == 7, 50).otherwise(F.col("a") * F.col("a"))), {"a": 0}, "y") is None
    assert exact.table_polynomial(df.limit(0).withColumn("y", y), {"a": 0}, "y") is None


@pytest.mark.parametrize("share", [0.1, 0.4])
def test_consensus_with_many_outliers(spark, share):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(0, 50, (2, 30_000))
    far = rng.random(30_000) < share
    y = 2 * x - z + 5 + rng.normal(size=30_000) * 0.1 + np.where(far, rng.uniform(200, 900, 30_000), 0)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "id long, x double, z double, y double").repartition(4)
    fit, inside = robust.ransac(df, ["x", "z"], "y", "id")
    assert fit.coefficients["x"] == pytest.approx(2, abs=0.01) and fit.coefficients["z"] == pytest.approx(-1, abs=0.01) and fit.intercept == pytest.approx(5, abs=0.1)
    assert 0.85 * (1 - share) < inside <= 1.01 - share
    again, _ = robust.ransac(df, ["x", "z"], "y", "id")
    assert again.coefficients == pytest.approx(fit.coefficients, rel=1e-9)
