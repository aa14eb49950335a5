"""Exact arithmetic: rationals, interpolation, sparse exact fits of a few points, exact polynomials of whole tables, recognised constants."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import CONSTANTS


def to_rational(x: float | str, most: int = 2000, tolerance: float = 2e-5) -> Fraction | None:
    """The rational with the least denominator up to ``most`` within the tolerance; decimals' own rounding if text."""
    if isinstance(x, str):
        if "." in x:
            tolerance = 0.5 * 10.0 ** -len(x.split(".")[1].split("e")[0])
        x = float(Fraction(x)) if "/" in x else float(x)
    if not math.isfinite(x):
        return None
    for d in range(1, most + 1):
        n = round(x * d)
        if abs(x - n / d) <= tolerance:
            return Fraction(n, d)
    return None


def recognise(x: float, tolerance: float = 1e-9) -> str | None:
    """A whole number, a simple fraction, or such a multiple of a known constant."""
    if not math.isfinite(x):
        return None
    for name, v in (("", 1.0), *CONSTANTS):
        for d in range(1, 13):
            n = round(x / v * d)
            if n and abs(n) <= 1000 and abs(x - n * v / d) <= tolerance * max(1.0, abs(x)):
                if not name:
                    return str(Fraction(n, d))
                lead = "" if n == 1 else "-" if n == -1 else f"{n}*"
                return f"{lead}{name}" + (f"/{d}" if d > 1 and math.gcd(n, d) == 1 else "") if math.gcd(n, d) == 1 else None
    return None


def ambiguous(x: str) -> bool:
    """Do several fractions of denominators up to 50 round to the same decimals?"""
    if "." not in x:
        return False
    half, v = 0.5 * 10.0 ** -len(x.split(".")[1]), float(x)
    return len({f for d in range(1, 51) if abs((f := Fraction(round(v * d), d)) - Fraction(x)) <= half}) > 1


def line_through(p: tuple, q: tuple) -> tuple[Fraction, Fraction]:
    """Slope and intercept of the exact line through two points."""
    (x1, y1), (x2, y2) = [tuple(Fraction(str(v)) for v in r) for r in (p, q)]
    if x1 == x2:
        raise ValueError("the points have one x")
    m = (y2 - y1) / (x2 - x1)
    return m, y1 - m * x1


def solve_exact(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction] | None:
    """The solution of a consistent system of full column rank by rational elimination, else None."""
    rows = [[*map(Fraction, r), Fraction(v)] for r, v in zip(a, b, strict=True)]
    n = len(a[0]) if a else 0
    for c in range(n):
        p = next((k for k in range(c, len(rows)) if rows[k][c]), None)
        if p is None:
            return None
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for k in range(len(rows)):
            if k != c and rows[k][c]:
                f = rows[k][c]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[c], strict=True)]
    if any(r[-1] for r in rows[n:]):
        return None
    return [rows[k][-1] for k in range(n)]


def sparse_exact(points: list[tuple[list, object]], names: list[str], degree: int = 2, inverse: bool = False, most_terms: int = 3, most_subsets: int = 1000) -> dict[str, Fraction] | None:
    """The polynomial (or, with ``inverse``, rational) of the fewest terms through all points exactly; ties by total degree."""
    xs = [[Fraction(str(v)) for v in x] for x, _ in points]
    ys = [Fraction(str(y)) for _, y in points]
    exps = [e for e in product(range(-degree if inverse else 0, degree + 1), repeat=len(names)) if sum(map(abs, e)) <= degree]
    if inverse:
        exps = [e for e in exps if not any(k < 0 and not x[i] for x in xs for i, k in enumerate(e))]
    exps.sort(key=lambda e: (sum(map(abs, e)), tuple(-k for k in e)))
    value = lambda x, e: math.prod((v**k for v, k in zip(x, e, strict=True)), start=Fraction(1))
    for k in range(1, min(most_terms, len(points)) + 1):
        for tried, own in enumerate(combinations(exps, k)):
            if tried >= most_subsets:
                break
            c = solve_exact([[value(x, e) for e in own] for x in xs], ys)
            if c is not None:
                name = lambda e: "*".join(n if p == 1 else f"{n}^{p}" if p > 0 else f"{n}^({p})" for n, p in zip(names, e, strict=True) if p) or "1"
                return {name(e): v for e, v in zip(own, c, strict=True) if v}
    return None


def newton(points: list[tuple]) -> tuple[list[Fraction], list[Fraction]]:
    """Nodes and divided differences."""
    xs, c = [Fraction(str(x)) for x, _ in points], [Fraction(str(y)) for _, y in points]
    for k in range(1, len(c)):
        for i in range(len(c) - 1, k - 1, -1):
            c[i] = (c[i] - c[i - 1]) / (xs[i] - xs[i - k])
    return xs, c


def interpolate(points: list[tuple]) -> list[Fraction]:
    """Coefficients, lowest first, of the polynomial through the points (expanded Newton form)."""
    xs, c = newton(points)
    out = [Fraction(0)]
    for k in reversed(range(len(c))):
        out = [Fraction(0), *out]
        for i in range(len(out) - 1):
            out[i] -= xs[k] * out[i + 1]
        out[0] += c[k]
    while len(out) > 1 and not out[-1]:
        out.pop()
    return out


def lagrange(points: list[tuple], x) -> Fraction:
    """The interpolating polynomial's value at x."""
    own = [(Fraction(str(a)), Fraction(str(b))) for a, b in points]
    x = Fraction(str(x))
    return sum(yi * math.prod(((x - xj) / (xi - xj) for j, (xj, _) in enumerate(own) if j != i), start=Fraction(1)) for i, (xi, yi) in enumerate(own))


def polynomial_text(c: list[Fraction], x: str = "x") -> str:
    terms = []
    for k in reversed(range(len(c))):
        if c[k]:
            power = "" if k == 0 else x if k == 1 else f"{x}^{k}"
            lead = "" if abs(c[k]) == 1 and k else str(abs(c[k])) if abs(c[k]).denominator == 1 or not k else f"({abs(c[k])})"
            terms.append(("-" if c[k] < 0 else "+", lead + ("*" if lead and power else "") + power))
    if not terms:
        return "0"
    return ("-" if terms[0][0] == "-" else "") + terms[0][1] + "".join(f" {s} {t}" for s, t in terms[1:])


#: Primes below 2**31 that sums of products are taken modulo; how many of them only check the result.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497, 2147483489, 2147483477)
CHECKS = 2


def products_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """a @ a.T modulo p of numbers below 2**31: halves of 16 bits, whose sums floats hold exactly for up to 2**20 columns."""
    high, low = (a >> 16).astype(float), (a & 0xFFFF).astype(float)
    whole = lambda x: x.astype(np.int64) % p
    cross = high @ low.T
    return (whole(high @ high.T) * ((1 << 32) % p) % p + whole(cross + cross.T) * (1 << 16) % p + whole(low @ low.T)) % p


def _powers(base: list[np.ndarray], exps: list[tuple[int, ...]], p: int) -> list[np.ndarray]:
    own = [b % p for b in base]
    out = []
    for e in exps:
        v = np.ones(len(base[0]), np.int64)
        for x, k in zip(own, e, strict=True):
            for _ in range(k):
                v = v * x % p
        out.append(v)
    return out


def solve_modulo(g: list[list[int]], r: list[int], p: int) -> tuple[list[int], list[int]]:
    """Pivot columns and the solution of g x = r modulo a prime on them; columns that depend on earlier ones are 0."""
    n = len(g)
    rows = [[*map(int, g[k]), int(r[k])] for k in range(n)]
    pivots, top = [], 0
    for c in range(n):
        k = next((k for k in range(top, n) if rows[k][c]), None)
        if k is None:
            continue
        rows[top], rows[k] = rows[k], rows[top]
        inverse = pow(rows[top][c], -1, p)
        rows[top] = [x * inverse % p for x in rows[top]]
        for k in range(n):
            if k != top and rows[k][c]:
                f = rows[k][c]
                rows[k] = [(x - f * y) % p for x, y in zip(rows[k], rows[top], strict=True)]
        pivots.append(c)
        top += 1
    out = [0] * n
    for k, c in enumerate(pivots):
        out[c] = rows[k][-1]
    return pivots, out


def rational_of(r: int, modulus: int) -> Fraction | None:
    """The fraction n / d with n and d below the root of half the modulus that r is modulo it; None if there is none."""
    most = math.isqrt(modulus // 2)
    a, b, s, t = modulus, r % modulus, 0, 1
    while b > most:
        q = a // b
        a, b, s, t = b, a - q * b, t, s - q * t
    return Fraction(b, t) if t and abs(t) <= most and math.gcd(b, abs(t)) == 1 else None


def table_polynomial(df: DataFrame, columns: dict[str, int], y: str, y_digits: int = 0, degree: int = 2) -> dict[str, Fraction] | None:
    """The polynomial that every row satisfies exactly: term -> coefficient; None where there is none.

    ``columns`` and ``y_digits`` give the decimals of each column, by which it is a whole number. One pass sums products of
    monomials modulo primes, a matrix for each; the normal equations are solved modulo each prime, put together, and read as
    fractions (numerators and denominators below 2**120). Two primes that had no part in it check that the sum of squared
    residuals is zero. Terms that depend on lower ones are left out; rows with a null don't take part.
    """
    names = list(columns)
    exps = sorted((e for e in product(range(degree + 1), repeat=len(names)) if sum(e) <= degree), key=lambda e: (sum(e), tuple(-k for k in e)))
    whole = lambda c, d: F.round(F.col(c).cast("double") * 10.0**d).cast("long")
    own = df.select(*[whole(c, d).alias(f"c{k}") for k, (c, d) in enumerate(columns.items())], whole(y, y_digits).alias("y")).na.drop()
    m = len(exps) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(MODULI), m, m), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for lo in range(0, len(batch), 1 << 20):
                part = batch.slice(lo, 1 << 20)
                base = [part.column(k).to_numpy() for k in range(len(names))]
                for k, p in enumerate(MODULI):
                    total[k] = (total[k] + products_modulo(np.stack([*_powers(base, exps, p), part.column(len(names)).to_numpy() % p]), p)) % p
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.r_[total.reshape(-1), rows])], ["k", "v"])

    sums = {r.k: int(r.v) for r in own.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    if not sums:
        return None
    products = [[[sums[(k * m + i) * m + j] % p for j in range(m)] for i in range(m)] for k, p in enumerate(MODULI)]
    solved = [solve_modulo([row[:-1] for row in g[:-1]], [row[-1] for row in g[:-1]], p) for g, p in zip(products[:-CHECKS], MODULI, strict=False)]
    pivots = solved[0][0]
    if any(own_pivots != pivots for own_pivots, _ in solved):
        return None
    found: list[Fraction] = []
    modulus = math.prod(MODULI[:-CHECKS])
    for c in range(m - 1):
        r = sum(x[c] * (modulus // p) * pow(modulus // p, -1, p) for (_, x), p in zip(solved, MODULI, strict=False)) % modulus
        value = rational_of(r, modulus)
        if value is None:
            return None
        found.append(value)
    for g, p in zip(products[-CHECKS:], MODULI[-CHECKS:], strict=True):
        b = [v.numerator * pow(v.denominator, -1, p) % p for v in found]
        left = g[-1][-1] - 2 * sum(x * g[i][-1] for i, x in enumerate(b)) + sum(x * z * g[i][j] for i, x in enumerate(b) for j, z in enumerate(b))
        if left % p:
            return None
    name = lambda e: "*".join(n if k == 1 else f"{n}^{k}" for n, k in zip(names, e, strict=True) if k) or "1"
    return {name(e): v * Fraction(10) ** sum(d * k for d, k in zip(columns.values(), e, strict=True)) / Fraction(10) ** y_digits for e, v in zip(exps, found, strict=True) if v}
