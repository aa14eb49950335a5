"""Equations of motion from a table of series, and independence by counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.special import chi2_sf
from lodestar.operators import causal, dynamics, series

MOTIONS = {
    "y'' + sin(y) = 0": lambda y, v: -np.sin(y),
    "y'' + 0.3*y' + 2*sin(y) = 0": lambda y, v: -2 * np.sin(y) - 0.3 * v,
    "y'' - y' + y^2*y' + y = 0": lambda y, v: (1 - y * y) * v - y,
    "y'' + 4*y = 0": lambda y, v: -4 * y,
    "y'' - y + y^3 = 0": lambda y, v: y - y**3,
}


@pytest.mark.parametrize("text", MOTIONS)
def test_equations_of_motion(spark, text):
    t = 0.01 * np.arange(500)
    rows = []
    for k, start in enumerate(np.linspace(0.3, 2.4, 10)):
        path = np.array(list(series.rk4(lambda s: np.array([s[1], MOTIONS[text](s[0], s[1])]), np.array([start, 0.4]), t)))[:, 0]
        rows += [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, path, strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, t double, x double").repartition(3)
    found = dynamics.search_ode(df, "t", "x", ["k"], "i")
    assert found.text == text and found.residual < 1e-7


def test_no_identity_and_no_empty_sum_is_an_equation():
    rng = np.random.default_rng(1)
    y0, y1, y2 = rng.normal(size=(3, 4000))
    names = ["y0", "y1", "y2", "sin(y0)", "y0^2"]
    values = np.stack([y0, y1, y2, np.sin(y0), y0 * y0], 1)
    front = dynamics.ode_front(values.T @ values / 4000, names)
    assert all(e.residual > 1e-3 for e in front) and all(any("y1" in t or "y2" in t for t in e.terms) for e in front)
    # an identity of y alone holds, but is no equation
    twice = np.c_[values, 2 * y0]
    assert all(e.residual > 1e-3 for e in dynamics.ode_front(twice.T @ twice / 4000, [*names, "2*y0"]))


def test_cube_tests_equal_plain_counts(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 3000))
    rows = np.c_[x, x * x + 0.1 * rng.normal(size=3000), z, x + z]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    edges = np.quantile(rows, [0.2, 0.4, 0.6, 0.8], axis=0)
    binned = np.stack([(rows[:, [k]] >= edges[:, k]).sum(axis=1) for k in range(4)], 1)
    tests = [("a", "b", ()), ("a", "c", ()), ("a", "c", ("d",)), ("b", "d", ("a", "c"))]
    got = {r.test: (r.g2, r.dof) for r in causal.g_tests(causal.cube(df, list("abcd")), tests).collect()}
    for k, (a, b, given) in enumerate(tests):
        i, j = binned[:, "abcd".index(a)], binned[:, "abcd".index(b)]
        stratum = sum((binned[:, "abcd".index(g)] * 5**e for e, g in enumerate(given)), np.zeros(3000, int))
        g2, strata = 0.0, 0
        for s in np.unique(stratum):
            own = stratum == s
            if own.sum() >= 10:
                o = np.zeros((5, 5))
                np.add.at(o, (i[own], j[own]), 1)
                e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
                g2 += 2 * (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum()
                strata += 1
        assert got[k] == (pytest.approx(g2, rel=1e-9), 16 * strata)
    assert chi2_sf(*got[0]) < 1e-9 < chi2_sf(*got[1])
    # a parabola is seen by counts alone; a and c are independent until d, their sum, is given
    fisher, counts = (causal.pc(df.select("a", "b", "c"), ["a", "b", "c"], 1e-3, t) for t in ("fisher", "g2"))
    edge = lambda g: {frozenset(e) for e in g.directed | g.undirected}
    assert edge(counts) == {frozenset("ab")} and frozenset("ab") not in edge(fisher)
    collider = causal.pc(df.select("a", "c", F.col("d")), ["a", "c", "d"], 1e-3, "g2")
    assert collider.directed == {("a", "d"), ("c", "d")}
