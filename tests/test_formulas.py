"""Parser, compiler, algebra, registry and the public functions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar import api, cli
from lodestar.functions import ast, cas
from lodestar.functions.compile import evaluate, to_numpy, to_python
from lodestar.functions.library import BINARY, LIBRARY, UNARY
from lodestar.functions.parse import FormulaError, parse, split_top_level
from lodestar.functions.registry import Registry
from lodestar.functions.special import beta_inc, chi2_sf, prime_pi, t_sf2
from lodestar.operators import exact, solve, units


@pytest.mark.parametrize(("text", "value"), [("2 + 2", 4), ("sqrt(16)", 4), ("sin(0)", 0), ("log(E)", 1), ("50%", 0.5), ("2(3 + 4)", 14), ("-2^2", -4), ("2^-1", 0.5), ("10 mod 3", 1), ("5!", 120), ("0xff", 255), ("|3 - 5|", 2), ("11x", 22), ("3²", 9), ("√(9)", 3), ("6÷2", 3), ("log(8, 2)", 3)])
def test_values(text, value):
    assert evaluate(parse(text), x=2.0) == pytest.approx(value)


@pytest.mark.parametrize(("text", "code"), [("", "EMPTY_INPUT"), ("(((", "UNBALANCED_PARENS"), ("x**", "SYNTAX_ERROR"), ("*/x", "SYNTAX_ERROR"), ("foo(x)", "FORBIDDEN_FUNCTION"), ("sin(1, 2)", "WRONG_ARGUMENT_COUNT"), ("__import__('os')", "FORBIDDEN_TOKEN"), ("x" * 20_000, "TOO_LONG"), ("(" * 200 + "x" + ")" * 200, "TOO_DEEP"), ("'x", "UNMATCHED_QUOTES")])
def test_error_codes(text, code):
    with pytest.raises(FormulaError) as e:
        parse(text)
    assert e.value.code == code


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_raises_formula_error(text):
    try:
        parse(text)
    except FormulaError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.sampled_from(["x", "y", "2", "0.5"]), lambda s: st.one_of(st.tuples(s, st.sampled_from("+-*"), s).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), s.map(lambda t: f"sin({t})")), max_leaves=8))
def test_text_round_trip_keeps_the_value(text):
    x = parse(text)
    at = {"x": 0.7, "y": -1.3}
    assert evaluate(parse(ast.text(x)), **at) == pytest.approx(evaluate(x, **at), rel=1e-9, abs=1e-12)


def test_tables_of_search_functions():
    assert len(UNARY) == 35 and len(BINARY) == 13
    assert all(v in LIBRARY for v in (*UNARY.values(), *BINARY.values()))


def test_split_top_level():
    assert split_top_level("f(1, 2)=3, [a, b], c") == ["f(1, 2)=3", "[a, b]", "c"]


@pytest.mark.parametrize("f", ["x^3*sin(x)", "exp(-x^2)", "log(x)/x", "atan(x)*sqrt(x)", "x^x", "tanh(2x)"])
def test_derivatives_match_differences(f):
    x, h = parse(f), 1e-6
    d = cas.diff(x, "x")
    for v in (0.4, 1.1, 2.3):
        assert evaluate(d, x=v) == pytest.approx((evaluate(x, x=v + h) - evaluate(x, x=v - h)) / (2 * h), rel=1e-5)


@pytest.mark.parametrize("f", ["3x^2 + 1/x", "exp(2x)", "x*exp(x)", "sin(3x + 1)", "sqrt(x)", "log(x)", "1/(2x + 1)", "x^2*cos(x)", "2^x"])
def test_antiderivatives(f):
    x = parse(f)
    d = cas.diff(cas.integrate(x, "x"), "x")
    for v in (0.5, 1.7):
        assert evaluate(d, x=v) == pytest.approx(evaluate(x, x=v), rel=1e-9)


def test_polynomials():
    assert ast.text(cas.expand(parse("(x + 1)^3"))) == "x^3 + 3*x^2 + 3*x + 1"
    assert cas.roots(parse("x^3 - 6x^2 + 11x - 6"), "x")[0] == ["1", "2", "3"]
    assert cas.equivalent(cas.factor(parse("x^2 - 1"), "x"), parse("x^2 - 1"))
    assert cas.limit(parse("sin(x)/x"), "x", 0.0) == pytest.approx(1)
    assert cas.limit(parse("1/x^2"), "x", 0.0) == math.inf


def test_distributions():
    assert t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    assert prime_pi(np.array([1, 2, 100, 1000.0])).tolist() == [0, 1, 25, 168]


def test_equations():
    assert solve.solve_equation("x^2 - 1 = 0").approx == [-1, 1]
    assert solve.solve_equation("1 = 0").exact == ["Contradiction"]
    assert solve.solve_equation("x^2 - 2*y^2 = 1").exact[:2] == ["(3, 2)", "(17, 12)"]
    assert solve.solve_equation("sin(x) = 0.5").approx[4] == pytest.approx(math.pi / 6)
    assert solve.solve_equation("1/x = 2").approx == [0.5]
    assert solve.solve_system("x + y = 3, x - y = 1").exact == ["x = 2", "y = 1"]
    assert solve.solve_system("x = 2 mod 3, x = 3 mod 5").exact == ["8 + 15*n"]
    assert solve.solve_inequality("0 < x < 5").exact == ["(0, 5)"]
    assert solve.solve_inequality("x^2 - 1 <= 0").exact == ["[-1, 1]"]
    assert len(solve.inverse("x^2 + y^2", "25", "integer").exact) == 12
    x, y = solve.diophantine(3, 5, 1)[0]
    assert 3 * x + 5 * y == 1
    assert solve.crt([(1, 2), (0, 2)]) is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=5))
def test_interpolation_is_exact(c):
    points = [(k, sum(v * k**p for p, v in enumerate(c))) for k in range(len(c))]
    got = exact.interpolate(points)
    assert all(sum(v * k**p for p, v in enumerate(got)) == y for k, y in points)
    assert exact.lagrange(points, 11) == sum(v * 11**p for p, v in enumerate(got))


def test_exact():
    assert exact.line_through((1, 2), (3, 8)) == (3, -1)
    assert exact.to_rational("0.33333") == Fraction(1, 3)
    assert exact.recognise(math.pi / 2) == "pi/2"
    assert exact.sparse_exact([((x, y), 3 * x + 2 * y - 5) for x, y in ((1, 2), (2, 1), (3, 5), (0, 4))], ["x", "y"]) == {"x": 3, "y": 2, "1": -5}


def test_units():
    d = units.Dimension.of
    assert units.pi_groups({"F": d("N"), "rho": d("kg/m^3"), "v": d("m/s"), "L": d("m")}) == [{"F": 1, "rho": -1, "v": -2, "L": -2}]
    assert units.check("m*v^2/2", {"m": d("kg"), "v": d("m/s")}) == d("J")
    with pytest.raises(ValueError):
        units.check("m + v", {"m": d("kg"), "v": d("m/s")})


def test_registry(tmp_path):
    r = Registry()
    r.define("f(x) = 2x + a")
    r.define("a = 3")
    assert evaluate(r.expand("f(f(1))")) == 13
    r.save(str(tmp_path / "f.json"))
    q = Registry()
    assert q.load(str(tmp_path / "f.json")) == [] and q.functions == r.functions
    space: dict = {}
    exec(r.export("f"), space)
    assert space["f"](4) == 11
    assert "math" in to_python("g", ["x"], parse("sin(x)"))


def test_public_functions():
    assert api.evaluate("det([[1, 2], [3, 4]])").result == "-2"
    assert api.evaluate("integrate(x^2, x, 0, 3)").approx == "9"
    assert api.evaluate("(((").error_code == "UNBALANCED_PARENS"
    assert cli.run("x > 2")["exact"] == ["(2, oo)"]
    assert cli.main(["-e", "2 + 2", "--format", "json"]) == 0


def test_numpy_guards():
    x = np.array([-1.0, 0.0, 2.0])
    assert np.isfinite(to_numpy(parse("x"), {"x": x})).all()
    assert LIBRARY["plog"].numpy(x).tolist()[1] == pytest.approx(math.log(1e-10))
    assert LIBRARY["gp_round"].numpy(np.array([2.5])).tolist() == [2.0] and LIBRARY["round"].numpy(np.array([2.5])).tolist() == [3.0]


@pytest.mark.parametrize(
    ("formula", "at", "want"),
    [
        ("1.00005+x", 0.0, 1.00005), ("x/100000+0.00003", 0.0, 0.00003), ("sin(x)/x", 0.0, 1.0), ("(1-cos(x))/x^2", 0.0, 0.5), ("(x^3-1)/(x-1)", 1.0, 3.0), ("(3^x-1)/x", 0.0, math.log(3)),
        ("x*log(x)", 0.0, 0.0), ("log(x)", 0.0, -math.inf), ("1/x^2", 0.0, math.inf), ("abs(x)/x", 0.0, math.nan), ("sin(1/x)", 0.0, math.nan), ("(1+1/x)^x", math.inf, math.e), ("log(x)/x", math.inf, 0.0),
        ("1/log(x)", math.inf, 0.0), ("sqrt(x^2+x)-x", math.inf, 0.5), ("exp(x)", math.inf, math.inf), ("sin(x)", math.inf, math.nan), ("atan(x)", math.inf, math.pi / 2), ("exp(x)", -math.inf, 0.0),
    ],
)
def test_limits(formula, at, want):
    assert cas.limit(parse(formula), "x", at) == pytest.approx(want, rel=1e-8, abs=1e-12, nan_ok=True)


@pytest.mark.parametrize(
    ("equation", "want"),
    [
        ("log(x)=5", [math.exp(5)]), ("exp(x)=1000000", [math.log(1e6)]), ("2^x=100000", [math.log2(1e5)]), ("sqrt(x)=20", [400]), ("log(x)+x=1000", [993.0991694723891]), ("sqrt(x)+x=1000000", [999000.49987506246]),
        ("1/x+log(x)=3", [0.22196368406307, 19.05883745772271]), ("x*log(x)=1000000", [87847.5395778]), ("10^x=1e-8", [-8]), ("abs(x-3)=2", [1, 5]), ("x=cos(x)", [0.739085133215]), ("x^2.5=32", [4]),
    ],
)
def test_equations_beyond_any_window(equation, want):
    got = solve.solve_equation(equation)
    assert got.ok and got.approx == pytest.approx(want, rel=1e-9)


def test_no_solution_is_said_only_where_it_is_known():
    assert [solve.solve_equation(e).error_code for e in ("exp(x)=-1", "sin(x)=2", "sqrt(x)=-1", "exp(x)=x")] == ["NO_SOLUTION"] * 3 + ["NOT_FOUND"]
    assert len(solve.solve_equation("sin(x)=0.5").approx) == 8


@pytest.mark.parametrize(("formula", "at", "want"), [("x/(x + 1000000)", math.inf, 1), ("(exp(x) - 1 - x - x^2/2)/x^3", 0, 1 / 6), ("(cos(x) - 1)/x^2", 0, -0.5), ("x - sqrt(x^2 - x)", math.inf, 0.5), ("exp(-x)*x^5", math.inf, 0), ("log(x)/x", math.inf, 0), ("abs(x)/x", 0, math.nan), ("sin(1/x)", 0, math.nan)])
def test_limits_without_cancellation(formula, at, want):
    from lodestar.functions.cas import limit

    assert limit(parse(formula), "x", at) == pytest.approx(want, rel=1e-12, abs=1e-12, nan_ok=True)


@pytest.mark.parametrize(("equation", "want"), [("(x-1)^2*exp(x) = 0", [1]), ("x^2*exp(-x) = 0", [0]), ("(x-2)^2*log(x) = 0", [1, 2]), ("(x-1)^2*(x+3) = 0", [-3, 1]), ("x*exp(x) = 1", [0.5671432904097838])])
def test_no_roots_from_underflow(equation, want):
    from lodestar.operators import solve

    assert solve.solve_equation(equation).approx == pytest.approx(want)


def test_primes_and_fractions_of_exact_fits():
    from lodestar.operators.match import sieve

    assert set(exact.MODULI) <= set(sieve(2**31 - 300, 2**31).tolist())
    modulus = math.prod(exact.MODULI[:-exact.CHECKS])
    for f in (Fraction(3, 4), Fraction(-2), Fraction(250, 3), Fraction(0), Fraction(-(10**30), 7**20)):
        assert exact.rational_of(f.numerator * pow(f.denominator, -1, modulus) % modulus, modulus) == f
    rng = np.random.default_rng(0)
    a = rng.integers(0, exact.MODULI[0], (5, 700))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) % exact.MODULI[0] for q in a] for p in a]
    assert exact.products_modulo(a, exact.MODULI[0]).tolist() == want
