"""Equations: single ones, systems, congruences, Pell, integer solutions, inequalities, inverses; and their column forms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ast, cas
from ..functions.compile import evaluate, to_column, to_numpy
from ..functions.exactness import text_number
from ..functions.parse import FormulaError, parse, split_top_level
from ..functions.precise import value_of


@dataclass
class Result:
    """type: equation, pell, identity_or_contradiction, multi_isolate, system, congruence or inequality."""

    ok: bool
    result_type: str
    exact: list[str] = field(default_factory=list)
    approx: list[float] = field(default_factory=list)
    error: str | None = None
    error_code: str | None = None


def sides(equation: str) -> tuple[ast.Node, ast.Node]:
    parts = re.split(r"(?<![<>!=])=(?!=)", equation)
    if len(parts) != 2:
        raise FormulaError("SYNTAX_ERROR", "an equation has one equals sign")
    return parse(parts[0]), parse(parts[1])


def pell_coefficient(equation: str) -> int | None:
    """D of x^2 - D y^2 = 1, in any arrangement and names."""
    try:
        a, b = sides(equation)
    except FormulaError:
        return None
    p = cas.poly(a - b)
    if p is None or p.get(()) not in (Fraction(-1), Fraction(1)):
        return None
    sign = -p[()]
    squares = {k[0][0]: v * sign for k, v in p.items() if k and len(k) == 1 and k[0][1] == 2}
    if len(squares) != 2 or len(p) != 3:
        return None
    values = sorted(squares.values(), reverse=True)
    return int(-values[1]) if values[0] == 1 and values[1] < 0 and values[1].denominator == 1 else None


def pell_solutions(d: int, count: int = 5) -> list[tuple[int, int]]:
    """The least solutions by the continued fraction of sqrt(d)."""
    root = math.isqrt(d)
    if root * root == d:
        return [(1, 0)]
    m, q, a = 0, 1, root
    h, k = (1, root), (0, 1)
    while h[1] ** 2 - d * k[1] ** 2 != 1:
        m = q * a - m
        q = (d - m * m) // q
        a = (root + m) // q
        h, k = (h[1], a * h[1] + h[0]), (k[1], a * k[1] + k[0])
    x1, y1 = h[1], k[1]
    out, x, y = [], x1, y1
    for _ in range(count):
        out.append((x, y))
        x, y = x1 * x + d * y1 * y, x1 * y + y1 * x
    return out


#: Half the width of the window in which periodic equations are solved.
WINDOW = 4 * math.pi
PERIODIC = frozenset("sin cos tan cot sec csc gp_sin gp_cos gp_tan".split())


def _bracketed(x: ast.Node, name: str, t: np.ndarray) -> list[float]:
    """Sign changes between neighbours of t, bisected; touching zeros by local minima of the size."""
    with np.errstate(all="ignore"):
        v = np.real(np.broadcast_to(to_numpy(x, {name: t}), t.shape)).astype(float)

    def f(z: float) -> float:
        with np.errstate(all="ignore"):
            return float(np.real(to_numpy(x, {name: np.float64(z)})))

    out: list[float] = []
    for run in np.split(np.nonzero(v == 0)[0], np.nonzero(np.diff(np.nonzero(v == 0)[0]) > 1)[0] + 1):
        # several in a row may be numbers below the least one that a double holds
        if len(run) < 3 or value_of(x, 60, **{name: Decimal(float(t[run[len(run) // 2]]))}) in (None, 0):
            out += [float(z) for z in t[run]]
    for k in np.nonzero(np.isfinite(v[:-1]) & np.isfinite(v[1:]) & (np.sign(v[:-1]) * np.sign(v[1:]) < 0))[0]:
        a, b, fa = t[k], t[k + 1], v[k]
        for _ in range(200):
            m = (a + b) / 2
            if m in (a, b):
                break
            fm = f(m)
            a, b, fa = (m, b, fm) if (fa > 0) == (fm > 0) else (a, m, fa)
        # a pole changes sign too, but isn't small there
        z = a if abs(f(a)) <= abs(f(b)) else b
        if abs(f(z)) <= 1e-6 * max(1.0, min(abs(v[k]), abs(v[k + 1]))):
            out.append(float(z))
    size = np.abs(v)
    for k in np.nonzero((size[1:-1] < size[:-2]) & (size[1:-1] < size[2:]) & (size[1:-1] < 1e-4) & (np.sign(v[:-2]) * np.sign(v[2:]) > 0))[0] + 1:
        a, b = t[k - 1], t[k + 1]
        for _ in range(100):
            p, q = a + (b - a) / 3, b - (b - a) / 3
            a, b = (a, q) if abs(f(p)) < abs(f(q)) else (p, b)
        if abs(f((a + b) / 2)) < 1e-10:
            out.append((a + b) / 2)
    return out


def numeric_roots(x: ast.Node, name: str, lo: float = -WINDOW, hi: float = WINDOW, grid: int = 4001, far: bool | None = None) -> list[float]:
    """Real roots: on a grid of the window, and beyond it on grids of growing distance up to 1e15.

    A periodic equation (``far`` false; found by its functions where None) has endless roots; those of the window are
    listed, and farther ones only where it has none.
    """
    out = _bracketed(x, name, np.linspace(lo, hi, grid))
    if far is None:
        far = not out or not any(isinstance(n, ast.Call) and n.fn in PERIODIC for n in ast.walk(x))
    if far:
        away = np.geomspace(1, 1e14, 6000)
        out += [z for z in _bracketed(x, name, hi + (away - 1) * max(1.0, abs(hi)))] + [z for z in _bracketed(x, name, (lo - (away - 1) * max(1.0, abs(lo)))[::-1])]
        # and close to zero, where logarithms and quotients live
        out += _bracketed(x, name, np.geomspace(1e-15, 1e-2, 2000)) + _bracketed(x, name, -np.geomspace(1e-15, 1e-2, 2000)[::-1])
    whole = {float(round(z)) for z in out if abs(z) < 1e15 and abs(z - round(z)) < 1e-9 and value_of(x, 60, **{name: Decimal(round(z))}) == 0}
    out = sorted(whole | {float(z) for z in out if float(round(z)) not in whole and _crosses(x, name, z)})
    return [z for k, z in enumerate(out) if not k or z - out[k - 1] > 1e-9 * max(1.0, abs(z))]


def _crosses(x: ast.Node, name: str, z: float) -> bool:
    """Is a zero of floating point one in many digits too: exactly, by a change of sign around it, or less than either neighbour?

    A function that only falls below the least number isn't zero. Formulas without a decimal form are believed.
    """
    h = Decimal(max(abs(z), 1e-12)) / 10**6
    at = [value_of(x, 60, **{name: Decimal(z) + k * h}) for k in (-1, 0, 1)]  # h is far above the last digit
    if at[1] is None or at[1] == 0:
        return True
    if at[0] is None or at[2] is None:
        return True
    return (at[0] < 0) != (at[2] < 0) or abs(at[1]) < min(abs(at[0]), abs(at[2])) / 100


def _count(x: ast.Node, name: str) -> int:
    return sum(isinstance(n, ast.Sym) and n.name == name for n in ast.walk(x))


def unwound(x: ast.Node, name: str, value: float) -> list[float] | None:
    """All real solutions of x = value by inverse functions, where the symbol stands once; None where that can't be told.

    An empty list means that there are none.
    """
    if isinstance(x, ast.Sym):
        return [value] if x.name == name else None
    if not isinstance(x, ast.Call) or _count(x, name) != 1 or not math.isfinite(value):
        return None
    at = [k for k, a in enumerate(x.args) if _count(a, name)][0]
    inner = x.args[at]
    try:
        other = [float(np.real(evaluate(a))) for k, a in enumerate(x.args) if k != at]
    except (KeyError, TypeError, ValueError):
        return None
    if any(not math.isfinite(c) for c in other):
        return None
    c = other[0] if other else 0.0

    def go(values: list[float]) -> list[float] | None:
        found = [unwound(inner, name, v) for v in values]
        return None if None in found else [z for r in found for z in r]

    try:
        match x.fn:
            case "neg":
                return go([-value])
            case "add":
                return go([value - c])
            case "sub":
                return go([value + c if at == 0 else c - value])
            case "mul":
                return go([value / c]) if c else None
            case "div":
                if at == 0:
                    return go([value * c]) if c else None
                return go([c / value]) if value and c else ([] if c else None)
            case "pow" if at == 1:
                if c <= 0 or c == 1:
                    return None
                return go([math.log(value) / math.log(c)]) if value > 0 else []
            case "pow":
                if c == int(c) and c:
                    even = int(c) % 2 == 0
                    if value == 0:
                        return go([0.0]) if c > 0 else []
                    if even:
                        root = abs(value) ** (1 / c)
                        return go([-root, root]) if value > 0 else []
                    return go([math.copysign(abs(value) ** (1 / c), value)])
                return (go([value ** (1 / c)]) if value > 0 else []) if c else None
            case "sqrt":
                return go([value * value]) if value >= 0 else []
            case "exp":
                return go([math.log(value)]) if value > 0 else []
            case "log":
                return go([math.exp(value)])
            case "log2":
                return go([2.0**value])
            case "log10":
                return go([10.0**value])
            case "abs":
                return go([-value, value] if value else [0.0]) if value >= 0 else []
            case "asin" | "atan":
                if abs(value) > math.pi / 2 or x.fn == "atan" and abs(value) == math.pi / 2:
                    return []
                return go([math.sin(value) if x.fn == "asin" else math.tan(value)])
            case "acos":
                return go([math.cos(value)]) if 0 <= value <= math.pi else []
            case "sinh":
                return go([math.asinh(value)])
            case "tanh":
                return go([math.atanh(value)]) if abs(value) < 1 else []
            case "cosh":
                return go([-math.acosh(value), math.acosh(value)] if value > 1 else [0.0]) if value >= 1 else []
            case "sin" | "cos" if abs(value) > 1:
                return []
    except OverflowError:
        return None
    return None


def solve_equation(equation: str, name: str | None = None) -> Result:
    """Solutions of one equation in one symbol (the others stand as parameters in linear ones)."""
    try:
        d = pell_coefficient(equation)
        if d is not None:
            found = pell_solutions(d)
            return Result(True, "pell", [f"({x}, {y})" for x, y in found], [float(x) for x, _ in found])
        a, b = sides(equation)
        names = ast.symbols(a - b) if not isinstance(a - b, ast.Num) else []
        if not names or cas.equivalent(a, b) and cas.poly(a - b) == {}:
            same = cas.equivalent(a, b)
            return Result(True, "identity_or_contradiction", ["Identity" if same else "Contradiction"])
        if name is None and len(names) > 1:
            exact = [f"{k} = {ast.text(s)}" for k in names if (s := isolate(a - b, k)) is not None]
            return Result(bool(exact), "multi_isolate", exact, error=None if exact else "no symbol can be isolated", error_code=None if exact else "UNSUPPORTED")
        name = name or names[0]
        f = a - b
        m = re.fullmatch(r"mod\((.*), (\d+)\)", ast.text(a)) if isinstance(a, ast.Call) and a.fn == "mod" else None
        if m and isinstance(b, ast.Num) and isinstance(a.args[1], ast.Num) and b.value.denominator == 1:
            n = int(a.args[1].value)
            hits = [k for k in range(n) if abs(evaluate(a.args[0], **{name: float(k)}) % n - float(b.value)) < 1e-9]
            return Result(bool(hits), "congruence", [f"{k} + {n}*n" for k in hits], [float(k) for k in hits], None if hits else "no residue fits")
        if cas.coefficients(f, name) is not None:
            exact, values = cas.roots(f, name)
            real = sorted({round(v.real, 12) for v in values if abs(v.imag) < 1e-8})
            return Result(True, "equation", exact or [text_number(v) for v in real], real)
        cleared = f
        if isinstance(f, ast.Call):
            cleared = _clear(f)
        if cleared != f and cas.coefficients(cleared, name) is not None:
            _, values = cas.roots(cleared, name)
            real = sorted({round(v.real, 12) for v in values if abs(v.imag) < 1e-8})
            real = [v for v in real if abs(evaluate(f, **{name: v})) < 1e-6]
            return Result(True, "equation", [text_number(v) for v in real], real)
        for own, rest in ((a, b), (b, a)):
            if _count(own, name) == 1 and not _count(rest, name):
                real = unwound(own, name, float(np.real(evaluate(rest))))
                if real is not None:
                    real = sorted({float(round(v)) if abs(v - round(v)) < 1e-12 * max(1.0, abs(v)) else v for v in real})
                    return Result(bool(real), "equation", [text_number(v) for v in real], real, None if real else "no real solution", None if real else "NO_SOLUTION")
        real = numeric_roots(f, name)
        return Result(bool(real), "equation", [text_number(v) for v in real], real, None if real else "no root was found numerically", None if real else "NOT_FOUND")
    except FormulaError as e:
        return Result(False, "equation", error=str(e), error_code=e.code)
    except (KeyError, ValueError, ZeroDivisionError) as e:
        return Result(False, "equation", error=str(e), error_code="UNSUPPORTED")


def _clear(x: ast.Node) -> ast.Node:
    """The numerator over a common denominator."""

    def go(n: ast.Node) -> tuple[ast.Node, ast.Node]:
        if not isinstance(n, ast.Call) or n.fn not in ("add", "sub", "mul", "div", "neg"):
            return n, ast.ONE
        (p, q), (r, s) = go(n.args[0]), go(n.args[-1])
        match n.fn:
            case "neg":
                return -p, q
            case "mul":
                return p * r, q * s
            case "div":
                return p * s, q * r
            case _:
                return (p * s + r * q if n.fn == "add" else p * s - r * q), q * s

    return go(x)[0]


def isolate(f: ast.Node, name: str) -> ast.Node | None:
    """The symbol from f = 0 where f is linear in it."""
    p = cas.poly(f)
    if p is None or any(dict(k).get(name, 0) > 1 for k in p):
        return None
    lead = {tuple(t for t in k if t[0] != name): v for k, v in p.items() if dict(k).get(name)}
    rest = {k: -v for k, v in p.items() if not dict(k).get(name)}
    return cas.simplify(ast.div(cas.from_poly(rest), cas.from_poly(lead))) if lead else None


def solve_system(text: str) -> Result:
    """Linear systems exactly; x = a mod n lists by remainders; two polynomials numerically."""
    parts = split_top_level(text)
    mods = [re.fullmatch(r"\s*(\w+)\s*(?:=|≡)\s*(-?\d+)\s*\(?\s*mod\s*(\d+)\s*\)?\s*", p) for p in parts]
    if all(mods):
        got = crt([(int(m[2]), int(m[3])) for m in mods])
        return Result(got is not None, "congruence", [f"{got[0]} + {got[1]}*n"] if got else [], [float(got[0])] if got else [], None if got else "the congruences conflict")
    try:
        eqs = [a - b for a, b in map(sides, parts)]
        names = sorted({n for e in eqs for n in ast.symbols(e)})
        polys = [cas.poly(e) for e in eqs]
        if all(p is not None and all(sum(e for _, e in k) <= 1 for k in p) for p in polys):
            from .exact import solve_exact

            sol = solve_exact([[p.get(((n, 1),), Fraction(0)) for n in names] for p in polys], [-p.get((), Fraction(0)) for p in polys])
            if sol is None:
                return Result(False, "system", error="no single solution", error_code="NO_SOLUTION")
            return Result(True, "system", [f"{n} = {v}" for n, v in zip(names, sol, strict=True)], [float(v) for v in sol])
        found = newton_system(eqs, names)
        return Result(bool(found), "system", [", ".join(f"{n} = {text_number(v)}" for n, v in zip(names, s, strict=True)) for s in found], [v for s in found for v in s])
    except FormulaError as e:
        return Result(False, "system", error=str(e), error_code=e.code)


def newton_system(eqs: list[ast.Node], names: list[str], starts: int = 60) -> list[tuple[float, ...]]:
    rng, out = np.random.default_rng(4), []
    jac = [[cas.diff(e, n) for n in names] for e in eqs]
    for _ in range(starts):
        x = rng.uniform(-6, 6, len(names))
        for _ in range(60):
            at = dict(zip(names, x.tolist(), strict=True))
            f = np.array([evaluate(e, **at) for e in eqs], complex).real
            j = np.array([[evaluate(d, **at) for d in row] for row in jac], complex).real
            step = np.linalg.lstsq(j, f, rcond=None)[0]
            x = x - step
            if not np.isfinite(x).all() or np.abs(step).max() < 1e-13:
                break
        at = dict(zip(names, x.tolist(), strict=True))
        if np.isfinite(x).all() and max(abs(evaluate(e, **at)) for e in eqs) < 1e-8 and not any(np.abs(np.array(s) - x).max() < 1e-6 for s in out):
            out.append(tuple(float(v) if abs(v - round(v)) > 1e-9 else float(round(v)) for v in x))
    return sorted(out)


def extended_gcd(a: int, b: int) -> tuple[int, int, int]:
    x0, x1, y0, y1 = 1, 0, 0, 1
    while b:
        q, a, b = a // b, b, a % b
        x0, x1, y0, y1 = x1, x0 - q * x1, y1, y0 - q * y1
    return a, x0, y0


def crt(pairs: list[tuple[int, int]]) -> tuple[int, int] | None:
    """(remainder, modulus) of x = r mod n for all pairs; None if they conflict."""
    r, n = 0, 1
    for a, m in pairs:
        g, p, _ = extended_gcd(n, m)
        if (a - r) % g:
            return None
        r, n = r + n * ((a - r) // g * p % (m // g)), n // g * m
        r %= n
    return r, n


def diophantine(a: int, b: int, c: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """A solution of a x + b y = c and the step to the next."""
    g, x, y = extended_gcd(a, b)
    if not g or c % g:
        return None
    return (x * c // g, y * c // g), (b // g, -a // g)


def solve_inequality(text: str, name: str | None = None) -> Result:
    """Intervals of one symbol, chained or not, by the sign between the roots."""
    try:
        x = parse(text)
        parts = [n for n in ast.walk(x) if isinstance(n, ast.Call) and n.fn in ("lt", "le", "gt", "ge")]
        if not parts:
            raise FormulaError("SYNTAX_ERROR", "there's no inequality")
        name = name or ast.symbols(x)[0]
        points: set[float] = set()
        for p in parts:
            f = p.args[0] - p.args[1]
            points |= set(r for r in (solve_equation(f"{ast.text(f)} = 0", name).approx))
        edges = [-math.inf, *sorted(points), math.inf]
        holds = lambda v: all(bool(evaluate(p, **{name: v})) for p in parts)
        spans: list[list] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mid = 0.0 if math.isinf(a) and math.isinf(b) else b - 1 if math.isinf(a) else a + 1 if math.isinf(b) else (a + b) / 2
            closed = math.isfinite(a) and holds(a)
            if closed and spans and spans[-1][1] == a:
                spans[-1][3] = True
            elif closed:
                spans.append([a, a, True, True])
            if holds(mid):
                if spans and spans[-1][1] == a and spans[-1][3]:
                    spans[-1][1], spans[-1][3] = b, False
                else:
                    spans.append([a, b, False, False])
        show = lambda v: "oo" if v == math.inf else "-oo" if v == -math.inf else text_number(v)
        out = [f"{'[' if lc else '('}{show(a)}, {show(b)}{']' if rc else ')'}" for a, b, lc, rc in spans]
        return Result(True, "inequality", out or ["empty"], [v for a, b, *_ in spans for v in (a, b)])
    except FormulaError as e:
        return Result(False, "inequality", error=str(e), error_code=e.code)


def inverse(formula: str, value: str, domain: str = "real", reach: int = 50, most: int = 20) -> Result:
    """Arguments at which a formula has a value: whole numbers by grid, one symbol else by its equation."""
    x, v = parse(formula), parse(value)
    names = ast.symbols(x)
    if domain == "integer" or len(names) > 1:
        axes = np.meshgrid(*[np.arange(-reach, reach + 1.0)] * len(names), indexing="ij")
        got = np.broadcast_to(to_numpy(x, dict(zip(names, axes, strict=True))), axes[0].shape)
        at = np.argwhere(np.abs(got - evaluate(v)) < 1e-9) - reach
        found = [tuple(int(k) for k in row) for row in at]
        found.sort(key=lambda t: (sum(map(abs, t)), t))
        return Result(bool(found), "equation", [str(t if len(t) > 1 else t[0]) for t in found[:most]], [float(t[0]) for t in found[:most]])
    return solve_equation(f"{formula} = {value}", names[0])


# column forms


def quadratic_columns(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Real roots, the lesser first; a linear equation has the first alone; null where there are none."""
    disc = b * b - 4 * a * c
    root = F.sqrt(F.when(disc >= 0, disc))
    lo, hi = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    return F.when(a == 0, F.try_divide(-c, b)).otherwise(F.least(lo, hi)), F.when(a != 0, F.greatest(lo, hi))


def cramer_columns(a: Column, b: Column, c: Column, d: Column, p: Column, q: Column) -> tuple[Column, Column]:
    """Solution of a x + b y = p, c x + d y = q."""
    det = a * d - b * c
    return F.try_divide(p * d - b * q, det), F.try_divide(a * q - p * c, det)


def grid_roots_by(df: DataFrame, formula: str, lo: float, hi: float, steps: int, bisections: int = 40) -> DataFrame:
    """Each row of the table with each root of a formula in x and its columns (root), by sign changes on a grid, bisected within the row."""
    from ..functions.compile import to_sql

    f = parse(formula)
    at = lambda c: to_column(f, {"x": c})
    h = (hi - lo) / steps
    cells = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    own = cells.withColumns({"__a": F.lit(lo) + F.col("__i") * h, "__b": F.lit(lo) + (F.col("__i") + 1) * h}).withColumns({"__fa": at("__a"), "__fb": at("__b")}).filter("__fa * __fb < 0 or __fa = 0")
    m = "(s.a + s.b) / 2"
    fm, fa = (to_sql(f, "spark", {"x": v}) for v in (f"({m})", "s.a"))
    step = f"aggregate(sequence(1, {bisections}), named_struct('a', __a, 'b', __b), (s, i) -> CASE WHEN ({fa}) * ({fm}) <= 0 THEN named_struct('a', s.a, 'b', {m}) ELSE named_struct('a', {m}, 'b', s.b) END, s -> (s.a + s.b) / 2)"
    return own.withColumn("root", F.expr(f"CASE WHEN __fa = 0 THEN __a ELSE {step} END")).drop("__i", "__a", "__b", "__fa", "__fb")


def grid_roots(spark: SparkSession, formula: str, lo: float, hi: float, steps: int, bisections: int = 40) -> DataFrame:
    """Roots of a formula in x alone."""
    return grid_roots_by(spark.range(1).select(), formula, lo, hi, steps, bisections)


def crt_column(residues: list[Column], moduli: list[int]) -> Column:
    """The least number with the given remainders, for coprime moduli, from columns of remainders."""
    whole = math.prod(moduli)
    total = F.lit(0).cast("long")
    for r, m in zip(residues, moduli, strict=True):
        rest = whole // m
        total = total + F.pmod(r.cast("long"), F.lit(m)) * (rest * pow(rest, -1, m) % whole)
    return F.pmod(total, F.lit(whole))


def diophantine_rows(df: DataFrame, value: str, a: int, b: int, reach: int) -> DataFrame:
    """value, x and y: whole solutions of a x + b y = value up to ``reach`` in size, for each value of the table."""
    g, p, q = extended_gcd(a, b)
    c = F.col(value) / g
    own = df.filter(F.pmod(F.col(value), F.lit(abs(g))) == 0).select(value, (c * p).cast("long").alias("x0"), (c * q).cast("long").alias("y0"))
    dx, dy = b // g, -(a // g)
    # the steps that keep x within reach
    ends = [F.floor((F.lit(sign * reach) - F.col("x0")) / dx) for sign in (-1, 1)]
    own = own.withColumn("k", F.explode(F.sequence(F.least(*ends), F.greatest(*ends) + 1)))
    own = own.select(value, (F.col("x0") + F.col("k") * dx).alias("x"), (F.col("y0") + F.col("k") * dy).alias("y"))
    return own.filter((F.abs("x") <= reach) & (F.abs("y") <= reach))


def trapezoid(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Integral of x over t within keys."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    area = (F.col(x) + F.lag(x).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return df.withColumn("__a", area).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("integral"))
