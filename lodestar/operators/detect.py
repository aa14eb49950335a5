"""Pattern detectors: what one aggregate over one sorted window says about y(x), as hints for a search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compile import to_column
from ..functions.parse import parse

#: Formulas in x that are tried as they are: share of rows on which y equals them.
SHAPES = {
    "floor": "floor({x})", "ceil": "ceil({x})", "round": "round({x})", "self power": "{x}^{x}", "relu": "relu({x})", "sign": "sign({x})", "abs sine": "abs(sin({x}))", "softsign": "{x}/(1+abs({x}))",
    "bessel": "besselj0({x})", "gamma": "gamma({x})", "prime count": "primepi({x})", "chirp": "sin({x}^2)", "fibonacci": "fibonacci({x})", "lucas": "lucas({x})", "square": "{x}^2", "factorial": "factorial({x})", "frac": "frac({x})", "heaviside": "heaviside({x})", "lambert": "lambertw({x})",
}


def _close(y: Column, p: Column) -> Column:
    return F.coalesce(F.abs(y - p) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(y)), F.lit(False))


def detect(df: DataFrame, x: str, y: str, tie: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """A row for each key: match rates of the shapes, structure and bit facts, from one pass over sorted rows.

    Without keys the table is one series, which one task sorts.
    """
    keys = keys or []
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    own = df.select(*keys, cx.alias("x"), cy.alias("y"), *([F.col(tie)] if tie and tie not in (x, y) else []))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("x", *([tie] if tie and tie not in (x, y) else []))
    own = own.withColumn("py", F.lag("y").over(w)).withColumn("px", F.lag("x").over(w)).withColumn("p2", F.lag("y", 2).over(w)).withColumn("ny", F.lead("y").over(w))
    y_, x_ = F.col("y"), F.col("x")
    aggs = {f"is_{k.replace(' ', '_')}": F.avg(_close(y_, to_column(parse(f.format(x="x")))).cast("double")) for k, f in SHAPES.items()}
    lx, ly = F.expr("CASE WHEN x = floor(x) AND abs(x) < 1e15 THEN CAST(x AS BIGINT) END"), F.expr("CASE WHEN y = floor(y) AND abs(y) < 1e15 THEN CAST(y AS BIGINT) END")
    aggs |= {
        "n": F.count("*"), "whole": F.count(lx + ly), "or_y": F.bit_or(ly), "and_y": F.bit_and(ly), "xor_lo": F.min(lx.bitwiseXOR(ly)), "xor_hi": F.max(lx.bitwiseXOR(ly)),
        "and_all": F.bool_and(F.coalesce(lx.bitwiseAND(ly) == ly, F.lit(False))), "or_all": F.bool_and(F.coalesce(lx.bitwiseOR(ly) == ly, F.lit(False))),
        "bonacci2": F.avg(F.when(F.col("p2").isNotNull(), _close(y_, F.col("py") + F.col("p2")).cast("double"))),
        "monotone": F.bool_and(F.coalesce(y_ >= F.col("py"), F.lit(True))), "jumps": F.count_if(F.abs(y_ - F.col("py")) > 0.5),
        "first_jump": F.min(F.when(F.abs(y_ - F.col("py")) > 0.5, (x_ + F.col("px")) / 2)), "last_jump": F.max(F.when(F.abs(y_ - F.col("py")) > 0.5, (x_ + F.col("px")) / 2)),
        "poles": F.count_if(~(F.abs(y_) < float("inf")) | F.isnan(y_)), "near_poles": F.count_if((F.abs(F.try_divide(y_, F.col("py"))) > 10) & (F.abs(y_) > 10)),
        "cusps": F.count_if((F.abs(y_) < 0.01) & (F.abs(F.col("py")) > 0.01) & (F.abs(F.col("ny")) > 0.01)), "flips": F.count_if(F.signum(y_) * F.signum(F.col("py")) < 0),
        "y_lo": F.min(y_), "y_hi": F.max(y_), "x_lo": F.min(x_), "x_hi": F.max(x_), "at_hi": F.count_if(F.col("y") == F.col("py")),
        "layer_asin": F.regr_r2(F.when(F.abs(y_) <= 1, F.asin(y_)), x_), "layer_log": F.regr_r2(F.when(y_ > 0, F.ln(y_)), x_), "layer_log_square": F.regr_r2(F.when(y_ > 0, F.ln(y_)), x_ * x_),
    }
    return own.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])


def seeds(df: DataFrame, x: str, y: str) -> list[str]:
    """Formulas that the facts suggest, the surest first."""
    r = detect(df, x, y).first().asDict()
    out: list[str] = []
    exact = [k for k in SHAPES if (r[f"is_{k.replace(' ', '_')}"] or 0) >= 0.999]
    out += [SHAPES[k].format(x=x) for k in exact]
    if r["n"] and r["whole"] == r["n"]:
        if r["xor_lo"] == r["xor_hi"] and r["xor_lo"]:
            out.append(f"bitwise_xor({x}, {r['xor_lo']})")
        if r["and_all"] and r["or_y"]:
            out.append(f"bitwise_and({x}, {r['or_y']})")
        if r["or_all"] and r["and_y"]:
            out.append(f"bitwise_or({x}, {r['and_y']})")
    if (r["bonacci2"] or 0) >= 0.999:
        out += [f"fibonacci({x})", f"lucas({x})"]
    if r["jumps"] == 2:
        out.append(f"heaviside({x} - {r['first_jump']:g}) - heaviside({x} - {r['last_jump']:g})")
    if r["y_hi"] is not None and r["at_hi"] and not r["jumps"] and r["monotone"]:
        out.append(f"min({x}, {r['y_hi']:g})")
    if r["cusps"] and r["y_lo"] is not None and r["y_lo"] >= -0.01:
        out += [f"abs({x})", f"abs(sin({x}))"]
    if r["y_lo"] is not None and -1.0001 <= r["y_lo"] and r["y_hi"] <= 1.0001 and r["flips"] > 1:
        out += [f"sin({x})", f"cos({x})", f"sin({x}^2)"]
    if (r["layer_log"] or 0) > 0.999:
        out.append(f"exp({x})")
    if (r["layer_log_square"] or 0) > 0.999:
        out.append(f"exp(-{x}^2)")
    if (r["layer_asin"] or 0) > 0.999:
        out.append(f"sin({x})")
    out += confirmed(df, x, y)
    rational = rational_from_zeros(df, x, y)
    return list(dict.fromkeys([*out, rational] if rational else out))


#: Outer and inner functions of compositions, and constants that laws are made of.
OUTER = ("sin({})", "cos({})", "exp({})", "log({})", "sqrt({})", "abs({})", "tanh({})", "({})^2")
INNER = ("{x}^2", "sin({x})", "cos({x})", "exp({x})", "exp(-{x})", "abs({x})", "1/{x}", "log({x})", "sqrt({x})")
ANCHORS = ("pi", "e", "sqrt(2)", "sqrt(3)", "sqrt(5)", "sqrt(6)", "sqrt(7)", "sqrt(10)", "(1+sqrt(5))/2")


def hypotheses(x: str) -> dict[str, str]:
    """Closed formulas to try: compositions, laws with a constant as factor, base or power, and sums of ever faster cosines."""
    out = {f"{o.format(i.format(x=x))}": "composition" for o in OUTER for i in INNER}
    for c in ANCHORS:
        out |= {f: "constant" for f in (f"({c})*{x}", f"{x}/({c})", f"({c})*{x}^2", f"({c})^{x}", f"{x}^({c})", f"{x} + {c}", f"({c})*sin({x})", f"sin(({c})*{x})")}
    for a in ("0.3", "0.5", "0.7"):
        for b in (3, 5, 7):
            for n in (5, 10):
                out[" + ".join(f"{a}^{k}*cos({b ** k}*pi*{x})" for k in range(n))] = "fractal"
    # through the points 0 and 1
    return out | {f: "anchors" for f in (x, f"{x}^3", f"1 - {x}", f"1/(1 + {x})", f"1/(1 + {x}^2)", f"2^{x} - 1", f"(exp({x}) - 1)/(e - 1)", f"sin(pi*{x}/2)", f"cos(pi*{x}/2)")}


def confirmed(df: DataFrame, x: str, y: str, kinds: tuple[str, ...] = ("anchors", "constant", "composition", "fractal")) -> list[str]:
    """The hypotheses that hold on all rows, in one aggregate, by kind as listed and shortest first."""
    tried = {f: k for f, k in hypotheses(x).items() if k in kinds}
    cy = F.col(y).cast("double")
    own = df.select(F.col(x).cast("double").alias(x), cy.alias(y))
    row = own.agg(*[F.min(F.coalesce(_close(F.col(y), to_column(parse(f))), F.lit(False))).alias(f"h{k}") for k, f in enumerate(tried)]).first()
    held = [f for k, f in enumerate(tried) if row[k]]
    return sorted(held, key=lambda f: (kinds.index(tried[f]), len(f), f))


def point_anchors(df: DataFrame, x: str, y: str) -> dict[str, float | None]:
    """The values at 0 and 1 and at the ends, in one aggregate (None where the table has no such row)."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    row = df.agg(F.max(F.when(cx == 0, cy)).alias("f0"), F.max(F.when(cx == 1, cy)).alias("f1"), F.min_by(cy, cx).alias("first"), F.max_by(cy, cx).alias("last")).first()
    return row.asDict()


def rational_from_zeros(df: DataFrame, x: str, y: str, most: int = 4) -> str | None:
    """c (x - z1) (x - z2) ... / ((x - p1) ...) from the zeros of y and the places where it isn't finite, if that holds everywhere."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    finite = cy.isNotNull() & ~F.isnan(cy) & (F.abs(cy) < float("inf"))
    rows = df.select(cx.alias("x"), F.coalesce(finite, F.lit(False)).alias("ok"), cy.alias("y"))
    marks = rows.filter(~F.col("ok") | (F.abs("y") < 1e-9)).select("x", "ok").distinct().orderBy("x").limit(2 * most + 1).collect()
    zeros, poles = ([r.x for r in marks if r.ok is ok] for ok in (True, False))
    if not zeros or max(len(zeros), len(poles)) > most:
        return None
    number = lambda v: f"{v:.10g}"
    product = lambda vs: "*".join(f"({x} - ({number(v)}))" for v in vs)
    body = product(zeros) + (f"/({product(poles)})" if poles else "")
    own = rows.filter("ok").select(F.col("x").alias(x), "y").withColumn("b", to_column(parse(body)))
    scale = own.filter(F.abs("b") > 1e-9).agg(F.avg(F.col("y") / F.col("b")).alias("c")).first().c
    if scale is None:
        return None
    held = own.agg(F.min(F.coalesce(_close(F.col("y"), scale * F.col("b")), F.lit(False))).alias("h")).first().h
    return (body if abs(scale - 1) < 1e-9 else f"{number(scale)}*{body}") if held else None


def modulo(df: DataFrame, x: str, y: str) -> float | None:
    """The period of y = x mod m from the distances of its zeros: whole multiples of the most frequent one."""
    from .loss import modal_gap

    zeros = df.filter(F.abs(F.col(y)) < 1e-9).select(F.lit(1).alias("k"), F.col(x).cast("double").alias("x"))
    r = modal_gap(zeros, "x", ["k"]).first()
    if r is None or r.gap is None or r.gap <= 0:
        return None
    m = float(r.gap)
    held = df.agg(F.avg(_close(F.col(y).cast("double"), F.col(x) - m * F.floor(F.col(x) / m)).cast("double")).alias("s")).first().s
    return m if held and held > 0.9 else None


def integer_ratio(df: DataFrame, x: str, y: str) -> str | None:
    """y = (x^a + b) / (x^c + d) for small a, c and b, d of -1, 0 and 1, all tried in one aggregate."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    tries = {(a, b, c, d): _close(cy, F.try_divide(F.pow(cx, F.lit(a)) + b, F.pow(cx, F.lit(c)) + d)) for a in range(4) for b in (-1, 0, 1) for c in range(1, 4) for d in (-1, 0, 1) if (a, b) != (c, d) and (a or b)}
    row = df.agg(*[F.avg(v.cast("double")).alias(f"t{k}") for k, v in enumerate(tries.values())]).first()
    k = max(range(len(tries)), key=lambda k: row[k] or 0)
    a, b, c, d = list(tries)[k]
    return f"({x}^{a} + {b})/({x}^{c} + {d})" if (row[k] or 0) > 0.999 else None


def residual_amplified(df: DataFrame, formula: str, y: str, least: float = 1e-12) -> DataFrame:
    """Rows of what a near-perfect formula leaves, scaled to unit size, for another search."""
    p = to_column(parse(formula))
    own = df.withColumn("residual", F.col(y) - p)
    size = own.agg(F.max(F.abs("residual")).alias("m")).first().m or 0.0
    return own.withColumn("residual", F.col("residual") / size) if size > least else own.withColumn("residual", F.lit(0.0))


def rosenbrock(df: DataFrame, x: str, y: str, z: str) -> tuple[float, float] | None:
    """a and b of (a - x)^2 + b (y - x^2)^2, by least squares on its expanded terms."""
    from .gram import gram, solve

    own = df.select(*[e.cast("double").alias(n) for n, e in (("x", F.col(x)), ("x2", F.col(x) ** 2), ("x4", F.col(x) ** 4), ("x2y", F.col(x) ** 2 * F.col(y)), ("y2", F.col(y) ** 2), ("z", F.col(z)))])
    f = solve(gram(own, ["x", "x2", "x4", "x2y", "y2"], "z"))
    a, b = -f.coefficients["x"] / 2, f.coefficients["y2"]
    fits = f.r2 > 1 - 1e-9 and math.isclose(f.coefficients["x4"], b, rel_tol=1e-4, abs_tol=1e-6) and math.isclose(f.coefficients["x2y"], -2 * b, rel_tol=1e-4, abs_tol=1e-6)
    return (a, b) if fits else None
