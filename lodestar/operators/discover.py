"""Discovery of a formula for y from samples: conflicts, a one-pass hypothesis ladder, sparse regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compile import to_column
from ..functions.parse import parse
from . import period, project
from .exact import recognise
from .gram import Fit, gram, solve
from .match import conflicts
from .regress import best_polyfit, best_subsets, lasso_path, omp, prune_refit, templates


@dataclass
class Found:
    formula: str
    mse: float
    r2: float
    n: int
    how: str

    @property
    def sure(self) -> bool:
        return self.r2 >= 0.5

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.formula, float(self.mse), float(self.r2), int(self.n), self.how)], "formula string, mse double, r2 double, n long, how string")


def number(v: float) -> str:
    """A recognised constant, else twelve digits."""
    known = recognise(v, 1e-7)
    return known if known is not None else f"{v:.10g}"


def _term(c: float, body: str) -> str:
    n = number(c)
    return body if n == "1" else f"-{body}" if n == "-1" else f"({n})*{body}" if "/" in n or "*" in n else f"{n}*{body}"


def _sum(*terms: str) -> str:
    return " + ".join(t for t in terms if t).replace("+ -", "- ") or "0"


def _constant(v: float) -> str:
    return "" if abs(v) < 1e-9 else number(v)


def score(df: DataFrame, formulas: dict[str, str], y: str) -> dict[str, tuple[float, float]]:
    """(mse, R2) of each formula, all in one job; NaN where it isn't defined on every row."""
    c = F.col(y).cast("double")
    aggs = [F.count(c).alias("__n"), F.var_pop(c).alias("__v")]
    for k, f in formulas.items():
        p = to_column(parse(f))
        aggs += [F.avg((c - p) * (c - p)).alias(f"m_{k}"), F.count_if(project.is_finite(p)).alias(f"k_{k}")]
    row = df.agg(*aggs).first()
    out = {}
    for k in formulas:
        ok = row[f"k_{k}"] == row["__n"] and row[f"m_{k}"] is not None
        m = float(row[f"m_{k}"]) if ok else math.nan
        out[k] = (m, 1 - m / row["__v"] if ok and row["__v"] else float(m == 0))
    return out


def periodic(df: DataFrame, x: str, y: str) -> list[tuple[str, str]]:
    """(template, formula) of y over a period of x: a sawtooth that nine rows in ten are on, and waves of the clearest periods.

    Gaps, uneven steps and outliers don't hide a period.
    """
    out: list[tuple[str, str]] = []
    found = period.periods(df, x, y)
    for p in found[:2]:
        for length in (p.length, None):
            # as it was found, then as its cycles say
            length = length or period.cycle_length(df, x, y, p.length)
            fit = period.sawtooth(df, x, y, length)
            if fit:
                return [("modulo", _sum(_constant(fit[0]), _term(fit[1], f"mod({x}, {number(length)})")))]
    for p in found[:2]:
        k = 2 * math.pi / p.length
        wave = solve(gram(df.select(F.sin(k * F.col(x)).alias("s"), F.cos(k * F.col(x)).alias("c"), F.col(y).alias("v")), ["s", "c"], "v"))
        out.append(("wave", _sum(_term(wave.coefficients["s"], f"sin({k:.12g}*{x})"), _term(wave.coefficients["c"], f"cos({k:.12g}*{x})"), _constant(wave.intercept))))
    return out


def on_curve(df: DataFrame, formula: str, y: str) -> tuple[int, float, float]:
    """How many rows a formula gives to nine digits, and its mse and R2 over those."""
    c, p = F.col(y).cast("double"), to_column(parse(formula))
    scale = df.agg(F.max(F.abs(p)).alias("m")).first().m or 1.0
    row = df.filter(F.abs(c - p) <= 1e-9 * max(1.0, scale)).agg(F.count("*").alias("n"), F.avg((c - p) * (c - p)).alias("m"), F.var_pop(c).alias("v")).first()
    return int(row.n), row.m or 0.0, 1 - row.m / row.v if row.v else 1.0


def ladder(df: DataFrame, x: str, y: str) -> list[tuple[str, str]]:
    """(template, formula) in the order in which they are believed."""
    s = df.agg(*[c.alias(k) for k, c in templates(x, y).items()]).first()
    out: list[tuple[str, str]] = []
    if s.hi - s.lo <= 1e-9 * max(1.0, abs(s.hi)):
        return [("constant", number(s.lo))]
    if s.lin_a is not None:
        out.append(("linear", _sum(_term(s.lin_a, x), _constant(s.lin_b))))
    if s.quad_a is not None:
        out.append(("quadratic", _sum(_term(s.quad_a, f"{x}^2"), _constant(s.quad_b))))
    if s.pow_n == s.n and s.pow_b is not None:
        out.append(("power", _term(s.pow_a, f"{x}^({number(round(s.pow_b, 9))})")))
    if s.exp_n == s.n and s.exp_b is not None:
        out.append(("exponential", _term(s.exp_a, f"exp({number(round(s.exp_b, 9))}*{x})")))
    if s.log_n == s.n and s.log_a is not None:
        out.append(("logarithmic", _sum(_term(s.log_a, f"log({x})"), _constant(s.log_b))))
    # one-term laws with an offset, each by its own regression in one aggregate
    shapes = [f"sin({x})", f"cos({x})", f"sin(2*{x})", f"abs({x})", f"floor({x})", f"{x}^3"] + ([f"sqrt({x})"] if s.x_lo >= 0 else []) + ([f"1/{x}"] if s.x_lo > 0 or s.x_hi < 0 else []) + ([f"cosh({x})", f"sinh({x})"] if max(abs(s.x_lo), abs(s.x_hi)) < 50 else []) + [f"sigmoid({x})", f"softplus({x})", f"exp(-{x}^2)"] + ([f"{x}*log({x})"] if s.x_lo > 0 else [])
    # all of them from one matrix of products, with the line plus sine
    names = [f"f{k}" for k in range(len(shapes))]
    g = gram(project.build_features(df, {**dict(zip(names, shapes, strict=True)), "u": x, "s": f"sin({x})"}, [F.col(y).cast("double").alias("__y")]), [*names, "u", "s"], "__y")
    for k, f in enumerate(shapes):
        xx, xy = g.xx[k, k], g.xy[k]
        # a law explains all but a hundredth of the variance at least
        if xx > 0 and xy * xy >= 0.99 * xx * g.yy:
            out.append(("template", _sum(_term(xy / xx, f), _constant(g.mean[-1] - xy / xx * g.mean[k]))))
    mix = solve(g, ["u", "s"])
    if mix.r2 >= 0.99:
        out.append(("line plus sine", _sum(_term(mix.coefficients["u"], x), _term(mix.coefficients["s"], f"sin({x})"), _constant(mix.intercept))))
    return out


def ladder_by_key(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """The best template of every key in one job: how, a, b, r2 and the formula's text.

    y = a x + b, a x^2 + b, a x^b, a exp(b x) or a log(x) + b; power and exponential laws need
    every y positive, power and logarithm every x. Ties go to the first named.
    """
    c = templates(x, y)
    own = df.groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()])
    shapes = (("linear", "lin", "%s*X + %s", None), ("quadratic", "quad", "%s*X^2 + %s", None), ("power", "pow", "%s*X^(%s)", "pow_n"), ("exponential", "exp", "%s*exp(%s*X)", "exp_n"), ("logarithmic", "log", "%s*log(X) + %s", "log_n"))
    options = []
    for k, (name, p, text, count) in enumerate(shapes):
        ok = F.col(f"{p}_r2").isNotNull() & ~F.isnan(f"{p}_r2")
        ok = ok & (F.col(count) == F.col("n")) if count else ok
        a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
        shown = F.format_string(text.replace("X", x), F.round(a, 8).cast("string"), F.round(b, 8).cast("string"))
        options.append(F.when(ok, F.struct(F.round(F.col(f"{p}_r2"), 9).alias("r2"), F.lit(-k).alias("k"), F.lit(name).alias("how"), a.alias("a"), b.alias("b"), shown.alias("formula"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return own.select(*keys, "n", best.alias("best")).select(*keys, "n", "best.how", "best.a", "best.b", "best.r2", "best.formula")


def sparse(df: DataFrame, variables: list[str], y: str, stage: int, poles: dict[str, list[float]] | None = None) -> Found | None:
    """Best subsets or a pursuit over the candidate library, from one Gram matrix; few terms are preferred."""
    formulas = {k: v for k, v in project.admissible_features(df, variables, stage, y, poles).items() if k != "1"}
    names = list(formulas)
    wide = df.select(*[to_column(parse(f)).alias(f"f{k}") for k, f in enumerate(formulas.values())], F.col(y).cast("double").alias("__y"))
    cols = project.finite_columns(wide, [f"f{k}" for k in range(len(names))])
    if not cols:
        return None
    g = gram(wide, cols, "__y")
    if g.yy <= 0:
        return None
    choices: list[Fit] = []
    sub = best_subsets(g, 40, 12) if g.n <= 1000 or len(cols) <= 60 else None
    if sub:
        choices.append(sub)
    pursued = omp(g, 3 if g.n < 15 else 6)
    choices.append(prune_refit(g, list(pursued.coefficients)) if pursued.coefficients else pursued)
    if len(cols) <= 120:
        choices.append(min(lasso_path(g, 20), key=lambda r: r[2])[1])
    tv = g.yy / g.n
    best = min(choices, key=lambda f: (math.log10(max(f.mse / tv, 1e-13)) + 1.0 * len(f.coefficients), len(f.coefficients)))
    formula = _sum(*[_term(v, names[int(k[1:])]) for k, v in best.coefficients.items()], _constant(best.intercept if abs(best.intercept) > 1e-7 * math.sqrt(tv) else 0.0))
    return Found(formula, best.mse, best.r2, int(best.n), f"stage {stage}")


def _rank(f: Found) -> float:
    """Unexplained share in decades, and a decade for each term."""
    return math.log10(max(1 - f.r2, 1e-13)) + f.formula.count(" + ") + f.formula.count(" - ")


def find(df: DataFrame, variables: list[str], y: str, exact: float = 1e-9) -> Found:
    """The first hypothesis that holds: ladder, algebraic then transcendental sparse regression, polynomial.

    Rows that aren't finite are left out; conflicting points are an error.
    """
    own = project.finite_rows(df.select(*[F.col(c).cast("double").alias(c) for c in [*variables, y]]), *variables, y)
    if clash := conflicts(own, variables, y).limit(1).collect():
        raise ValueError(f"one point has values {clash[0].spread:g} apart")
    best: Found | None = None
    if len(variables) == 1:
        n = own.count()
        spread = own.agg(F.var_pop(y).alias("v")).first().v or 0.0
        # periods take several passes, so they are looked for where no law without one holds
        for laws in (ladder, periodic):
            steps = laws(own, variables[0], y)
            scores = score(own, {str(k): f for k, (_, f) in enumerate(steps)}, y)
            for k, (name, f) in enumerate(steps):
                mse, r2 = scores[str(k)]
                if mse <= exact * max(spread, 1e-30) or name == "constant":
                    return Found(f, mse, r2, n, name)
        for name, f in steps:
            if name == "modulo":
                kept, mse, r2 = on_curve(own, f, y)
                return Found(f, mse, r2, kept, f"modulo, {n - kept} rows aside")
    # rows that aren't finite are left out of fits, but show where poles are
    poles = {v: project.detected_poles(df, v, y) for v in variables}
    for stage in (1, 2):
        got = sparse(own, variables, y, stage, poles)
        if got and (best is None or _rank(got) < _rank(best)):
            best = got
        if best and best.r2 > 1 - 1e-10:
            break
    if best is None or best.r2 < 0.95 and len(variables) == 1:
        p = best_polyfit(own, variables[0], y)
        if p and (best is None or p.r2 > best.r2):
            best = Found(p.formula(), p.mse, p.r2, int(p.n), "polynomial")
    return best or Found("0", math.nan, 0.0, 0, "none")


def from_points(spark: SparkSession, points: list[tuple], variables: list[str], y: str = "y") -> DataFrame:
    """Literal points as a table; text values are evaluated as formulas."""
    from ..functions.compile import evaluate

    value = lambda v: float(evaluate(parse(v))) if isinstance(v, str) else float(v)
    rows = [(*[value(a) for a in (args if isinstance(args, (list, tuple)) else [args])], value(v)) for args, v in points]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*variables, y]))


def infer_symbols(spark: SparkSession, points: list[tuple], variables: list[str], y: str = "y") -> dict[str, str]:
    """Values of symbols among literal points: a formula is found for the numeric ones, the others are solved by it.

    f(1) = 1, f(2) = 4, f(a) = 9 gives a; f(3) = b gives b.
    """
    from ..functions import ast
    from ..functions.compile import evaluate
    from .solve import solve_equation

    names = lambda v: ast.symbols(parse(v)) if isinstance(v, str) else []
    listed = lambda a: list(a) if isinstance(a, (list, tuple)) else [a]
    numeric = [(a, v) for a, v in points if not any(names(q) for q in [*listed(a), v])]
    found = find(from_points(spark, numeric, variables, y), variables, y)
    out: dict[str, str] = {}
    for args, v in points:
        if (args, v) in numeric:
            continue
        at = {k: parse(str(q)) for k, q in zip(variables, listed(args), strict=True)}
        left = ast.substitute(parse(found.formula), at)
        if not ast.symbols(left):
            out[str(v)] = number(float(evaluate(left)))
        else:
            for name in ast.symbols(left):
                got = solve_equation(f"{ast.text(left)} = {v}", name)
                out[name] = ", ".join(got.exact)
    return out
