"""Differential equations from series: sparse identification and symbolic searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ast
from ..functions.compile import to_numpy
from ..functions.library import LIBRARY
from ..functions.parse import parse
from . import project, series
from .gram import Fit, gram
from .regress import stlsq

TIME_NAMES = ("t", "time", "Time", "T")


@dataclass
class Dynamics:
    """d<state>/dt = a formula of the states, for each."""

    states: list[str]
    fits: dict[str, Fit]

    def equations(self) -> list[str]:
        out = []
        for s in self.states:
            terms = []
            f = self.fits[s]
            for k, v in [*f.coefficients.items(), ("1", f.intercept)]:
                if abs(v) < 1e-4 * max([abs(u) for u in f.coefficients.values()], default=0.0) or abs(v) < 1e-9:
                    continue
                c = str(round(v)) if abs(v - round(v)) < 1e-4 else f"{v:.4g}"
                terms.append(c if k == "1" else k if c == "1" else f"-{k}" if c == "-1" else f"{c}*{k}")
            out.append(f"d{s}/dt = {' + '.join(terms).replace('+ -', '- ') or '0'}")
        return out

    def simulate(self, start: list[float], t: np.ndarray) -> np.ndarray:
        trees = {s: {k: parse(k) for k in self.fits[s].coefficients} for s in self.states}

        def rhs(x: np.ndarray) -> np.ndarray:
            at = dict(zip(self.states, x, strict=True))
            return np.array([self.fits[s].intercept + sum(v * float(np.real(to_numpy(trees[s][k], at))) for k, v in self.fits[s].coefficients.items()) for s in self.states])

        return np.array(list(series.rk4(rhs, np.array(start), t)))


def time_column(df: DataFrame) -> str:
    for name in TIME_NAMES:
        if name in df.columns:
            return name
    raise ValueError("no time column")


def sindy(df: DataFrame, t: str, states: list[str], keys: list[str], tie: str, degree: int = 2, threshold: float = 0.05, method: str = "savgol", trig: bool = False) -> Dynamics:
    """Derivatives by window, one library select, one Gram matrix a state, thresholded on the driver.

    Series that share a law are used together; each keeps its own derivative.
    """
    library = {k: v for k, v in project.sindy_library(states, degree, trig).items() if k != "1"}
    fits = {}
    for s in states:
        own = series.derivative(df, t, s, keys, tie, method).filter(project.is_finite(F.col("dx")))
        features = project.build_features(own, library, ["dx"])
        fits[s] = stlsq(gram(features, list(library), "dx"), threshold)
    return Dynamics(list(states), fits)


def sindy_score(df: DataFrame, model: Dynamics, t: str, keys: list[str], tie: str) -> dict[str, float]:
    """R2 of each state's derivative, from the same statistics."""
    return {s: model.fits[s].r2 for s in model.states}


# fixed values: left sides of common linear equations, y2 and y1 being the derivatives
LINEAR_FORMS = {"y'' + y": (1, 0, 1), "y' - y": (0, 1, -1), "y' + y": (0, 1, 1), "y'' - y": (1, 0, -1), "y''": (1, 0, 0), "y'": (0, 1, 0)}


def linear_ode(df: DataFrame, t: str, y: str, keys: list[str], tie: str) -> tuple[str, dict[str, float]]:
    """The common form that holds best (relative mean square of its left side), else y'' = a y' + b y fitted."""
    own = series.second_difference(series.finite_difference(df, t, y, keys, tie, 4), t, y, keys, tie)
    w = series.order(keys, t, tie)
    n = F.count("*").over(Window.partitionBy(*keys))
    inside = own.withColumn("__k", F.row_number().over(w)).withColumn("__n", n).filter("__k > 2 and __k < __n - 1")
    c = lambda a: F.col("d2x") * float(a[0]) + F.col("dx") * float(a[1]) + F.col(y) * float(a[2])
    scale = F.avg(F.col("d2x") ** 2 + F.col("dx") ** 2 + F.col(y) ** 2)
    row = inside.agg(*[F.try_divide(F.avg(c(a) * c(a)), scale).alias(f"f{k}") for k, a in enumerate(LINEAR_FORMS.values())]).first()
    k = min(range(len(LINEAR_FORMS)), key=lambda k: row[k] if row[k] is not None else np.inf)
    name = list(LINEAR_FORMS)[k]
    if row[k] is not None and row[k] < 1e-3:
        return f"{name} = 0", {"residual": row[k]}
    fit = gram(inside, ["dx", y], "d2x")
    from .gram import solve

    s = solve(fit)
    return f"y'' = {s.coefficients['dx']:.6g}*y' + {s.coefficients[y]:.6g}*y", {"r2": s.r2}


def autonomous(df: DataFrame, t: str, y: str, keys: list[str], tie: str, degree: int = 3) -> Fit:
    """y' = G(y), a sparse polynomial."""
    own = series.finite_difference(df, t, y, keys, tie, 4)
    library = {k: v for k, v in project.monomials([y], degree).items() if k != "1"}
    return stlsq(gram(project.build_features(own, library, ["dx"]), list(library), "dx"), 0.05)


def implicit_ode(df: DataFrame, t: str, y: str, keys: list[str], tie: str, degree: int = 2, small: float = 0.05) -> tuple[str, float]:
    """f(y, y', y'') = 0 as a sparse combination of monomials: the direction of least spread of their product matrix.

    Columns are scaled to unit size, so that the trivial combination is excluded; terms under ``small`` of the
    greatest go and the direction is found again. Returns the equation and its relative residual.
    """
    own = series.second_difference(series.finite_difference(df, t, y, keys, tie, 4), t, y, keys, tie)
    own = own.select(F.col(y).cast("double").alias("y0"), F.col("dx").alias("y1"), F.col("d2x").alias("y2"))
    own = project.finite_rows(own, "y0", "y1", "y2")
    library = list(project.monomials(["y0", "y1", "y2"], degree).values())
    names = [f"m{k}" for k in range(len(library))]
    g = gram(project.build_features(own, dict(zip(names, library, strict=True)), []).withColumn("one", F.lit(0.0)), names, "one")
    mean = g.mean[:-1]
    raw = (g.xx + g.n * np.outer(mean, mean)) / max(g.n, 1)
    size = np.sqrt(np.maximum(np.diag(raw), 1e-300))
    m = raw / np.outer(size, size)
    keep = np.arange(len(names))
    while True:
        values, vectors = np.linalg.eigh(m[np.ix_(keep, keep)])
        v = vectors[:, 0]
        strong = np.abs(v) >= small * np.abs(v).max()
        if strong.all() or strong.sum() < 2:
            break
        keep = keep[strong]
    c = v / size[keep]
    c = c / c[np.argmax(np.abs(v))]
    nice = {"y0": "y", "y1": "y'", "y2": "y''"}
    text = " + ".join(f"{a:.4g}*{library[k]}" if f"{a:.4g}" != "1" else library[k] for a, k in zip(c, keep, strict=True)).replace("+ -", "- ")
    for a, b in nice.items():
        text = text.replace(a, b)
    return f"{text} = 0", float(max(values[0], 0))


#: Least relative residual that differences of a series can show, in squares; worth of a term, in decades of it.
FLOOR, TERM = 1e-8, 1.0


@dataclass(frozen=True)
class Equation:
    """A sum of expressions of y, y' and y'' that is zero: its terms, their coefficients, its relative residual and the rows searched."""

    terms: tuple[str, ...]
    coefficients: tuple[float, ...]
    residual: float
    rows: int = 0

    @property
    def text(self) -> str:
        parts = []
        for t, c in zip(self.terms, self.coefficients, strict=True):
            near = round(c)
            n = str(near) if near and abs(c - near) < 5e-3 * max(1, abs(near)) else f"{c:.3g}"
            parts.append(t if n == "1" else f"-{t}" if n == "-1" else n if t == "1" else f"{n}*{t}")
        text = " + ".join(parts).replace("+ -", "- ")
        for name, sign in (("y2", "y''"), ("y1", "y'"), ("y0", "y")):
            text = text.replace(name, sign)
        return f"{text} = 0"


def ode_expressions(degree: int = 3, functions: tuple[str, ...] = ("sin", "cos", "exp")) -> list[str]:
    """Expressions that equations are sums of: monomials of y, y' and y'', and functions of y alone or times y'."""
    out = list(project.monomials(["y0", "y1", "y2"], degree).values())
    return out + [f"{f}(y0)" for f in functions] + [f"y1*{f}(y0)" for f in functions]


def derivatives(df: DataFrame, t: str, y: str, keys: list[str], tie: str) -> DataFrame:
    """y0, y1 and y2 inside each series, of every row: y and its central differences of fourth order, null near the ends.

    The mean step is taken over the same order, so that one sort and one pass over the windows serve all.
    """
    w = series.order(keys, t, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = F.try_divide(F.max(t).over(whole) - F.min(t).over(whole), F.count(t).over(whole) - 1)
    at = {k: F.lead(y, k).over(w) if k > 0 else F.lag(y, -k).over(w) for k in (-2, -1, 1, 2)}
    own = df.select(F.col(y).cast("double").alias("y0"), h.alias("h"), *[v.cast("double").alias(f"at{k + 2}") for k, v in at.items()])
    first = F.try_divide(F.expr("at0 - 8 * at1 + 8 * at3 - at4"), 12 * F.col("h"))
    second = F.try_divide(F.expr("-at0 + 16 * at1 - 30 * y0 + 16 * at3 - at4"), 12 * F.col("h") * F.col("h"))
    return own.select("y0", first.alias("y1"), second.alias("y2"))


def _values(x: ast.Node, at: dict[str, np.ndarray], seen: dict[ast.Node, np.ndarray]):
    """NumPy values of a tree; what several trees have in common is taken once."""
    if not isinstance(x, ast.Call):
        return to_numpy(x, at)
    if x not in seen:
        args = [_values(a, at, seen) for a in x.args]
        power = x.args[1].value if x.fn == "pow" and isinstance(x.args[1], ast.Num) else None
        seen[x] = args[0] * args[0] * args[0] if power == 3 else args[0] * args[0] if power == 2 else LIBRARY[x.fn].numpy(*args)
    return seen[x]


def second_moments(df: DataFrame, formulas: list[str]) -> tuple[np.ndarray, float, int]:
    """Mean products about zero of expressions of double columns, the rows that they are of, and all rows.

    Rows with a column that isn't finite, or an expression that has no value, have no part. One pass: tasks evaluate the
    expressions for a batch and sum its products, so only the columns reach them and one matrix a task leaves them.
    """
    cols, m = df.columns, len(formulas)
    trees = [parse(f) for f in formulas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, rows = np.zeros((m, m)), 0, 0
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(cols))])
            rows += x.shape[1]
            x = x[:, np.isfinite(x).all(axis=0)]
            at, seen = dict(zip(cols, x, strict=True)), {}
            with np.errstate(all="ignore"):
                v = np.stack([np.broadcast_to(_values(tree, at, seen), x.shape[1:]) for tree in trees])
                v = v[:, ~np.isnan(v).any(axis=0)]
                total += v @ v.T
            n += v.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m + 2)), pa.array(np.r_[total.reshape(-1), n, rows])], ["k", "v"])

    out = np.zeros(m * m + 2)
    for r in df.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out[:-2].reshape(m, m) / max(out[-2], 1), float(out[-2]), int(out[-1])


def _supports(count: int, most: int) -> Iterator[np.ndarray]:
    for k in range(2, most + 1):
        yield np.array(list(combinations(range(count), k)), np.int64)


def ode_front(moments: np.ndarray, expressions: list[str], most_terms: int = 4) -> list[Equation]:
    """For each number of terms the equation that holds best, from the products alone.

    A sum's residual is the least eigenvalue of its terms' products scaled to unit size, so that the empty sum is no
    answer. What holds without a derivative is an identity of the expressions and no equation; neither is a sum
    with a term that hardly counts.
    """
    size = np.sqrt(np.maximum(np.diag(moments), 1e-300))
    usable = np.nonzero(np.isfinite(size) & (size > 1e-12 * max(1.0, size.max(initial=0.0))))[0]
    unit = moments / np.outer(size, size)
    derived = np.array(["y1" in e or "y2" in e for e in expressions])
    weight = np.array([e.count("y") + e.count("^") + 2 * e.count("(") for e in expressions])
    out: list[Equation] = []
    for picks in _supports(len(usable), most_terms):
        at = usable[picks]
        at = at[derived[at].any(axis=1)]
        best: tuple[float, np.ndarray, np.ndarray, float] | None = None
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            values, vectors = np.linalg.eigh(unit[part[:, :, None], part[:, None, :]])
            v, low = vectors[:, :, 0], np.maximum(values[:, 0], 0)
            real = (np.abs(v) >= 0.02 * np.abs(v).max(axis=1, keepdims=True)).all(axis=1)
            cost = np.log10(np.maximum(low, FLOOR)) + 0.02 * weight[part].sum(axis=1)
            for k in np.argsort(np.where(real, cost, np.inf), kind="stable")[:20]:
                if not real[k] or best is not None and cost[k] >= best[0]:
                    break
                rest = part[k][~derived[part[k]]]
                plain = np.linalg.eigvalsh(unit[np.ix_(rest, rest)])[0] if len(rest) > 1 else 1.0
                if plain > 100 * max(low[k], FLOOR):
                    best = (cost[k], part[k], v[k], float(low[k]))
                    break
        if best:
            _, own, v, low = best
            c = v / size[own]
            order = sorted(range(len(own)), key=lambda k: (-("y2" in expressions[own[k]]), -("y1" in expressions[own[k]]), weight[own[k]], expressions[own[k]]))
            c = c / c[order[0]]
            out.append(Equation(tuple(expressions[own[k]] for k in order), tuple(float(c[k]) for k in order), low))
    return out


def search_ode(df: DataFrame, t: str, y: str, keys: list[str], tie: str, degree: int = 3, functions: tuple[str, ...] = ("sin", "cos", "exp"), most_terms: int = 4) -> Equation | None:
    """f(y, y', y'') = 0 that all series of a table share: every sum of a few expressions is judged, from one pass of products.

    A term must be worth a decade of the residual; None where there are too few rows.
    """
    expressions = ode_expressions(degree, functions)
    moments, n, rows = second_moments(derivatives(df, t, y, keys, tie), expressions)
    if n < len(expressions):
        return None
    front = ode_front(moments, expressions, most_terms)
    best = min(front, key=lambda e: np.log10(max(e.residual, FLOOR)) + TERM * len(e.terms), default=None)
    return best and replace(best, rows=rows)
