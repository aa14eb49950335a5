"""The function library: each function once, as Spark SQL, as DuckDB SQL and as NumPy.

Two families share it. Calculator functions follow textbook definitions; search functions (the
``UNARY`` and ``BINARY`` tables of formula search) are guarded so that any tree can be evaluated
on any data. Where both have a name with other semantics, the search one has the prefix ``gp_``.

Spark runs ANSI SQL here, so templates use try_divide and CASE guards; an invalid real value is
NULL or NaN and never an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import special


@dataclass(frozen=True)
class Fn:
    arity: int
    spark: str
    duck: str
    numpy: Callable
    python: str = ""


def _both(arity: int, sql: str, fn: Callable, python: str = "") -> Fn:
    return Fn(arity, sql, sql, fn, python)


def _clip(x: str, most: str) -> str:
    return f"least(greatest({x}, CAST(-{most} AS DOUBLE)), CAST({most} AS DOUBLE))"


_PI = repr(math.pi)
_PHI = repr((1 + math.sqrt(5)) / 2)
_ROOT5 = repr(math.sqrt(5))


def _quiet(fn: Callable) -> Callable:
    def run(*a):
        with np.errstate(all="ignore"):
            return fn(*[np.asarray(x, dtype=complex if np.iscomplexobj(x) else float) for x in a])

    return run


def _div(a, b):
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1, b))


def _round_half_up(x):
    return np.floor(x + 0.5)


def _int(x):
    return np.nan_to_num(x, nan=0, posinf=0, neginf=0).astype(np.int64)


def _shift(fn):
    return lambda x, y: np.where((y >= 0) & (y <= 63), fn(_int(x), np.clip(_int(y), 0, 63)), 0).astype(float)


def _fib(x):
    phi = (1 + 5**0.5) / 2
    return (phi**x - np.cos(np.pi * x) * phi ** (-x)) / 5**0.5


def _lucas(x):
    phi = (1 + 5**0.5) / 2
    return phi**x + np.cos(np.pi * x) * phi ** (-x)


def _big(x: str) -> tuple[str, str]:
    spark = f"CASE WHEN isnan({x}) OR abs({x}) >= 9.2e18D THEN 0L ELSE CAST({x} AS BIGINT) END"
    duck = f"CASE WHEN isnan({x}) OR abs({x}) >= 9.2e18 THEN 0 ELSE CAST(trunc({x}) AS BIGINT) END"
    return spark, duck


_A, _B = _big("{0}"), _big("{1}")

LIBRARY: dict[str, Fn] = {
    # arithmetic
    "add": _both(2, "({0} + {1})", _quiet(np.add), "({0} + {1})"),
    "sub": _both(2, "({0} - {1})", _quiet(np.subtract), "({0} - {1})"),
    "mul": _both(2, "({0} * {1})", _quiet(np.multiply), "({0} * {1})"),
    "div": Fn(2, "try_divide({0}, {1})", "({0} / nullif({1}, 0))", _quiet(_div), "({0} / {1})"),
    "pow": _both(2, "pow({0}, {1})", _quiet(lambda a, b: np.power(a, b)), "({0} ** {1})"),
    "neg": _both(1, "(-({0}))", _quiet(np.negative), "(-{0})"),
    # elementary
    **{k: _both(1, f"{k}({{0}})", _quiet(getattr(np, v)), f"math.{k}({{0}})") for k, v in (("sin", "sin"), ("cos", "cos"), ("tan", "tan"), ("sinh", "sinh"), ("cosh", "cosh"), ("tanh", "tanh"), ("asinh", "arcsinh"), ("atan", "arctan"), ("exp", "exp"), ("cbrt", "cbrt"))},
    "asin": _both(1, "CASE WHEN abs({0}) <= 1 THEN asin({0}) END", _quiet(np.arcsin), "math.asin({0})"),
    "acos": _both(1, "CASE WHEN abs({0}) <= 1 THEN acos({0}) END", _quiet(np.arccos), "math.acos({0})"),
    "acosh": _both(1, "CASE WHEN {0} >= 1 THEN acosh({0}) END", _quiet(np.arccosh), "math.acosh({0})"),
    "atanh": _both(1, "CASE WHEN abs({0}) < 1 THEN atanh({0}) END", _quiet(np.arctanh), "math.atanh({0})"),
    "atan2": _both(2, "atan2({0}, {1})", _quiet(np.arctan2), "math.atan2({0}, {1})"),
    "cot": Fn(1, "try_divide(1D, tan({0}))", "(1 / nullif(tan({0}), 0))", _quiet(lambda x: _div(1, np.tan(x))), "(1 / math.tan({0}))"),
    "sec": Fn(1, "try_divide(1D, cos({0}))", "(1 / nullif(cos({0}), 0))", _quiet(lambda x: _div(1, np.cos(x))), "(1 / math.cos({0}))"),
    "csc": Fn(1, "try_divide(1D, sin({0}))", "(1 / nullif(sin({0}), 0))", _quiet(lambda x: _div(1, np.sin(x))), "(1 / math.sin({0}))"),
    "log": _both(1, "CASE WHEN {0} > 0 THEN ln({0}) END", _quiet(np.log), "math.log({0})"),
    "log2": _both(1, "CASE WHEN {0} > 0 THEN log2({0}) END", _quiet(np.log2), "math.log2({0})"),
    "log10": _both(1, "CASE WHEN {0} > 0 THEN log10({0}) END", _quiet(np.log10), "math.log10({0})"),
    "sqrt": _both(1, "CASE WHEN {0} >= 0 THEN sqrt({0}) END", _quiet(np.sqrt), "math.sqrt({0})"),
    "root": Fn(2, "pow({0}, try_divide(1D, {1}))", "pow({0}, 1.0::DOUBLE / nullif({1}, 0))", _quiet(lambda x, n: np.power(x, 1 / n)), "({0} ** (1 / {1}))"),
    "abs": _both(1, "abs({0})", _quiet(np.abs), "abs({0})"),
    "sign": Fn(1, "signum({0})", "CAST(sign({0}) AS DOUBLE)", _quiet(np.sign), "math.copysign(1, {0})"),
    "floor": Fn(1, "CAST(floor({0}) AS DOUBLE)", "floor({0})", _quiet(np.floor), "math.floor({0})"),
    "ceil": Fn(1, "CAST(ceil({0}) AS DOUBLE)", "ceil({0})", _quiet(np.ceil), "math.ceil({0})"),
    "frac": _both(1, "({0} - floor({0}))", _quiet(lambda x: x - np.floor(x)), "({0} - math.floor({0}))"),
    "round": _both(1, "CAST(floor({0} + 0.5) AS DOUBLE)", _quiet(_round_half_up), "math.floor({0} + 0.5)"),
    "mod": Fn(2, "({0} - {1} * floor(try_divide({0}, {1})))", "({0} - {1} * floor({0} / nullif({1}, 0)))", _quiet(lambda x, y: x - y * np.floor(_div(x, y))), "({0} % {1})"),
    "min": _both(2, "least({0}, {1})", _quiet(np.minimum), "min({0}, {1})"),
    "max": _both(2, "greatest({0}, {1})", _quiet(np.maximum), "max({0}, {1})"),
    "heaviside": _both(1, "CASE WHEN {0} > 0 THEN 1.0 WHEN {0} = 0 THEN 0.5 ELSE 0.0 END", _quiet(lambda x: np.heaviside(x, 0.5)), "(1.0 if {0} > 0 else 0.5 if {0} == 0 else 0.0)"),
    "sinc": Fn(1, "CASE WHEN {0} = 0 THEN 1D ELSE try_divide(sin({0}), {0}) END", "CASE WHEN {0} = 0 THEN 1.0 ELSE sin({0}) / {0} END", _quiet(lambda x: np.sinc(x / np.pi)), "(math.sin({0}) / {0} if {0} else 1.0)"),
    "factorial": Fn(1, "CASE WHEN {0} BETWEEN 0 AND 20 AND {0} = floor({0}) THEN CAST(factorial(CAST({0} AS INT)) AS DOUBLE) END", "CASE WHEN {0} BETWEEN 0 AND 20 AND {0} = floor({0}) THEN CAST(factorial(CAST({0} AS INTEGER)) AS DOUBLE) END", _quiet(np.vectorize(lambda x: float(math.factorial(int(x))) if 0 <= x <= 170 and x == int(x) else math.nan, otypes=[float])), "math.factorial({0})"),
    "gcd": Fn(2, "aggregate(sequence(1, 92), named_struct('a', abs(CAST({0} AS BIGINT)), 'b', abs(CAST({1} AS BIGINT))), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> CAST(s.a AS DOUBLE))", "CAST(gcd(CAST({0} AS BIGINT), CAST({1} AS BIGINT)) AS DOUBLE)", _quiet(lambda a, b: np.gcd(a.astype(np.int64), b.astype(np.int64)).astype(float)), "math.gcd(int({0}), int({1}))"),
    "sigmoid": _both(1, f"(1.0 / (1.0 + exp(-({_clip('{0}', '700')}))))", _quiet(lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))), "(1 / (1 + math.exp(-{0})))"),
    "softplus": _both(1, f"ln(1.0 + exp({_clip('{0}', '700')}))", _quiet(lambda x: np.log1p(np.exp(np.clip(x, -700, 700)))), "math.log1p(math.exp({0}))"),
    "relu": _both(1, "greatest({0}, CAST(0 AS DOUBLE))", _quiet(lambda x: np.maximum(x, 0)), "max({0}, 0)"),
    # special functions: polynomials and series from published formulas, in either SQL
    "erf": Fn(1, special.erf_sql("{0}"), special.erf_sql("{0}"), _quiet(special.erf), "math.erf({0})"),
    "gamma": Fn(1, special.gamma_sql("{0}", "spark"), special.gamma_sql("{0}", "duck"), _quiet(special.gamma), "math.gamma({0})"),
    "besselj0": Fn(1, special.bessel_sql("{0}", 0), special.bessel_sql("{0}", 0), _quiet(special.bessel_j0)),
    "besselj1": Fn(1, special.bessel_sql("{0}", 1), special.bessel_sql("{0}", 1), _quiet(special.bessel_j1)),
    "lambertw": Fn(1, special.lambertw_sql("{0}", "spark"), special.lambertw_sql("{0}", "duck"), _quiet(special.lambertw)),
    "fibonacci": _both(1, f"((pow({_PHI}, {{0}}) - cos({_PI} * {{0}}) * pow({_PHI}, -({{0}}))) / {_ROOT5})", _quiet(_fib)),
    "lucas": _both(1, f"(pow({_PHI}, {{0}}) + cos({_PI} * {{0}}) * pow({_PHI}, -({{0}})))", _quiet(_lucas)),
    "primepi": Fn(1, special.primepi_sql("{0}", "spark"), special.primepi_sql("{0}", "duck"), _quiet(special.prime_pi)),
    # bits of truncated integers
    "bitwise_and": Fn(2, f"CAST(({_A[0]}) & ({_B[0]}) AS DOUBLE)", f"CAST(({_A[1]}) & ({_B[1]}) AS DOUBLE)", _quiet(lambda a, b: (_int(a) & _int(b)).astype(float)), "(int({0}) & int({1}))"),
    "bitwise_or": Fn(2, f"CAST(({_A[0]}) | ({_B[0]}) AS DOUBLE)", f"CAST(({_A[1]}) | ({_B[1]}) AS DOUBLE)", _quiet(lambda a, b: (_int(a) | _int(b)).astype(float)), "(int({0}) | int({1}))"),
    "bitwise_xor": Fn(2, f"CAST(({_A[0]}) ^ ({_B[0]}) AS DOUBLE)", f"CAST(xor({_A[1]}, {_B[1]}) AS DOUBLE)", _quiet(lambda a, b: (_int(a) ^ _int(b)).astype(float)), "(int({0}) ^ int({1}))"),
    "lshift": Fn(2, f"CASE WHEN {{1}} BETWEEN 0 AND 40 THEN CAST(shiftleft({_A[0]}, CAST({{1}} AS INT)) AS DOUBLE) ELSE 0D END", f"CASE WHEN {{1}} BETWEEN 0 AND 40 THEN CAST(({_A[1]}) * CAST(pow(2, trunc({{1}})) AS BIGINT) AS DOUBLE) ELSE 0.0 END", _quiet(_shift(np.left_shift)), "(int({0}) << int({1}))"),
    "rshift": Fn(2, f"CASE WHEN {{1}} BETWEEN 0 AND 63 THEN CAST(shiftright({_A[0]}, CAST({{1}} AS INT)) AS DOUBLE) ELSE 0D END", f"CASE WHEN {{1}} BETWEEN 0 AND 63 THEN CAST(({_A[1]}) >> CAST(trunc({{1}}) AS INTEGER) AS DOUBLE) ELSE 0.0 END", _quiet(_shift(np.right_shift)), "(int({0}) >> int({1}))"),
    # comparisons give 1 or 0
    **{k: _both(2, f"CASE WHEN {{0}} {op} {{1}} THEN 1.0 ELSE 0.0 END", _quiet(lambda a, b, f=f: f(a, b).astype(float)), f"(1.0 if {{0}} {py} {{1}} else 0.0)") for k, op, py, f in (("lt", "<", "<", np.less), ("le", "<=", "<=", np.less_equal), ("gt", ">", ">", np.greater), ("ge", ">=", ">=", np.greater_equal), ("eq", "=", "==", np.equal), ("ne", "<>", "!=", np.not_equal))},
    "if": _both(3, "CASE WHEN {0} <> 0 THEN {1} ELSE {2} END", _quiet(lambda c, a, b: np.where(c != 0, a, b)), "({1} if {0} else {2})"),
}
LIBRARY["ln"] = LIBRARY["log"]
LIBRARY["ceiling"] = LIBRARY["ceil"]
LIBRARY["Abs"] = LIBRARY["abs"]
LIBRARY["Mod"] = LIBRARY["mod"]
LIBRARY["arcsin"], LIBRARY["arccos"], LIBRARY["arctan"] = LIBRARY["asin"], LIBRARY["acos"], LIBRARY["atan"]
LIBRARY["LambertW"] = LIBRARY["lambertw"]
LIBRARY["Heaviside"] = LIBRARY["heaviside"]
LIBRARY["binomial"] = Fn(2, "CASE WHEN {0} BETWEEN 0 AND 20 AND {1} BETWEEN 0 AND {0} THEN CAST(factorial(CAST({0} AS INT)) AS DOUBLE) / (factorial(CAST({1} AS INT)) * factorial(CAST({0} - {1} AS INT))) END", "CASE WHEN {0} BETWEEN 0 AND 20 AND {1} BETWEEN 0 AND {0} THEN CAST(factorial(CAST({0} AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST({1} AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST({0} - {1} AS INTEGER)) AS DOUBLE)) END", _quiet(np.vectorize(lambda n, k: float(math.comb(int(n), int(k))) if n >= k >= 0 else math.nan, otypes=[float])), "math.comb(int({0}), int({1}))")
LIBRARY["lcm"] = Fn(2, f"try_divide(abs({{0}} * {{1}}), {LIBRARY['gcd'].spark})", f"(abs({{0}} * {{1}}) / nullif({LIBRARY['gcd'].duck}, 0))", _quiet(lambda a, b: np.lcm(a.astype(np.int64), b.astype(np.int64)).astype(float)), "math.lcm(int({0}), int({1}))")

_GUARDED = {
    "gp_tan": _both(1, f"tan({_clip('{0}', '1e6')})", _quiet(lambda x: np.tan(np.clip(x, -1e6, 1e6)))),
    "gp_exp": _both(1, f"exp({_clip('{0}', '700')})", _quiet(lambda x: np.exp(np.clip(x, -700, 700)))),
    "gp_log": _both(1, "CASE WHEN {0} = 0 THEN ln(1e-10) WHEN {0} > 0 THEN ln({0}) END", _quiet(lambda x: np.where(x == 0, np.log(1e-10), np.log(x)))),
    "plog": _both(1, "ln(abs({0}) + 1e-10)", _quiet(lambda x: np.log(np.abs(x) + 1e-10))),
    "psqrt": _both(1, "sqrt(abs({0}))", _quiet(lambda x: np.sqrt(np.abs(x)))),
    "inv": Fn(1, "try_divide(1D, {0} + 1e-10 * {0} / (abs({0}) + 1e-10))", "(1.0 / nullif({0} + 1e-10 * {0} / (abs({0}) + 1e-10), 0))", _quiet(lambda x: _div(1, x + 1e-10 * x / (np.abs(x) + 1e-10)))),
    "square": _both(1, _clip("({0} * {0})", "1e100"), _quiet(lambda x: np.clip(x * x, -1e100, 1e100))),
    "cube": _both(1, _clip("({0} * {0} * {0})", "1e100"), _quiet(lambda x: np.clip(x * x * x, -1e100, 1e100))),
    "gp_sinh": _both(1, f"sinh({_clip('{0}', '700')})", _quiet(lambda x: np.sinh(np.clip(x, -700, 700)))),
    "gp_cosh": _both(1, f"cosh({_clip('{0}', '700')})", _quiet(lambda x: np.cosh(np.clip(x, -700, 700)))),
    "gp_round": Fn(1, "rint({0})", "round_even({0}, 0)", _quiet(np.rint)),
    "gp_sinc": Fn(1, f"CASE WHEN {{0}} = 0 THEN 1D ELSE sin({_PI} * {{0}}) / ({_PI} * {{0}}) END", f"CASE WHEN {{0}} = 0 THEN 1.0 ELSE sin({_PI} * {{0}}) / ({_PI} * {{0}}) END", _quiet(np.sinc)),
    "gp_mul": _both(2, _clip("({0} * {1})", "1e100"), _quiet(lambda a, b: np.clip(a * b, -1e100, 1e100))),
    "gp_div": Fn(2, "try_divide({0}, {1} + 1e-10 * {1} / (abs({1}) + 1e-10))", "({0} / nullif({1} + 1e-10 * {1} / (abs({1}) + 1e-10), 0))", _quiet(lambda a, b: _div(a, b + 1e-10 * b / (np.abs(b) + 1e-10)))),
    "gp_pow": _both(2, f"least(greatest(pow({_clip('{0}', '1e150')}, {_clip('{1}', '100')}), -1e100), 1e100)", _quiet(lambda a, b: np.clip(np.power(np.clip(a, -1e150, 1e150), np.clip(b, -100, 100)), -1e100, 1e100))),
    "gp_mod": Fn(2, "CASE WHEN abs({1}) < 1e-10 THEN 0D ELSE {0} - {1} * floor(try_divide({0}, {1})) END", "CASE WHEN abs({1}) < 1e-10 THEN 0.0 ELSE {0} - {1} * floor({0} / nullif({1}, 0)) END", _quiet(lambda a, b: np.where(np.abs(b) < 1e-10, 0, a - b * np.floor(_div(a, b))))),
}
LIBRARY |= _GUARDED

#: What formula search may use: name -> library function.
UNARY = {
    **{k: k for k in ("sin", "cos", "tanh", "asinh", "acosh", "atanh", "floor", "ceil", "frac", "lambertw", "sign", "erf", "heaviside", "fibonacci", "lucas", "gamma", "abs", "neg", "plog", "psqrt", "inv", "square", "cube", "sqrt")},
    "tan": "gp_tan", "exp": "gp_exp", "log": "gp_log", "sinh": "gp_sinh", "cosh": "gp_cosh", "round": "gp_round", "sinc": "gp_sinc",
    "bessel_j0": "besselj0", "bessel_j1": "besselj1", "prime_pi": "primepi", "ceiling": "ceil",
}
BINARY = {
    "add": "add", "sub": "sub", "mul": "gp_mul", "div": "gp_div", "pow": "gp_pow", "max": "max", "min": "min",
    "bitwise_xor": "bitwise_xor", "bitwise_and": "bitwise_and", "bitwise_or": "bitwise_or", "lshift": "lshift", "rshift": "rshift", "mod": "gp_mod",
}
CONSTANTS = {"pi": math.pi, "e": math.e, "E": math.e, "oo": math.inf, "nan": math.nan}
