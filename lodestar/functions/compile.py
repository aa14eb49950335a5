"""Trees to Spark columns, SQL of either dialect, NumPy values, complex columns and Python text."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ast
from .library import CONSTANTS, LIBRARY


def _number(v: Fraction | float, dialect: str) -> str:
    x = float(v)
    if np.isnan(x) or np.isinf(x):
        name = "NaN" if np.isnan(x) else "Infinity" if x > 0 else "-Infinity"
        return f"CAST('{name}' AS DOUBLE)"
    return f"CAST({x!r} AS DOUBLE)"


def to_sql(x: ast.Node, dialect: str = "spark", names: dict[str, str] | None = None) -> str:
    """SQL over DOUBLE columns; ``names`` maps symbols to SQL."""
    names = names or {}
    if isinstance(x, ast.Num):
        return _number(x.value, dialect)
    if isinstance(x, ast.Sym):
        if x.name in names:
            return names[x.name]
        if x.name in CONSTANTS:
            return _number(CONSTANTS[x.name], dialect)
        return f"CAST({'`' if dialect == 'spark' else chr(34)}{x.name}{'`' if dialect == 'spark' else chr(34)} AS DOUBLE)"
    args = [to_sql(a, dialect, names) for a in x.args]
    if x.fn == "pow" and isinstance(x.args[1], ast.Num) and x.args[1].value in (2, 3):
        return "(" + " * ".join([args[0]] * int(x.args[1].value)) + ")"
    fn = LIBRARY[x.fn]
    return "(" + (fn.spark if dialect == "spark" else fn.duck).format(*args) + ")"


def scrubbed_sql(x: ast.Node, dialect: str = "spark", names: dict[str, str] | None = None) -> str:
    """SQL whose every node gives 0 for NaN and null, and 1e10 for what is infinite: a tree walk that can't fail."""
    if not isinstance(x, ast.Call):
        own = to_sql(x, dialect, names)
    else:
        parts = {f"__{k}": scrubbed_sql(a, dialect, names) for k, a in enumerate(x.args)}
        own = to_sql(ast.Call(x.fn, tuple(ast.Sym(k) for k in parts)), dialect, parts)
    inf = "CAST('Infinity' AS DOUBLE)"
    rule = f"CASE WHEN v IS NULL OR isnan(v) THEN CAST(0 AS DOUBLE) WHEN v = {inf} THEN CAST(1e10 AS DOUBLE) WHEN v = -{inf} THEN CAST(-1e10 AS DOUBLE) ELSE v END"
    # bound once by a lambda: the text grows with the tree, not with its depth
    if dialect == "spark":
        return f"element_at(transform(array(CAST({own} AS DOUBLE)), v -> {rule}), 1)"
    return f"list_transform([CAST({own} AS DOUBLE)], lambda v: {rule})[1]"


def to_column(x: ast.Node, names: dict[str, str] | None = None) -> Column:
    return F.expr(to_sql(x, "spark", names))


def finite(sql: str, digits: int | None = None, dialect: str = "spark") -> str:
    """NULL for what isn't finite; rounded, and without negative zero, if digits are given."""
    inf = "CAST('Infinity' AS DOUBLE)"
    value = sql if digits is None else f"(round({sql}, {digits}) + 0.0{'D' if dialect == 'spark' else ''})"
    return f"CASE WHEN isnan({sql}) OR abs({sql}) = {inf} THEN NULL ELSE {value} END"


def to_numpy(x: ast.Node, values: dict[str, np.ndarray]):
    """Vectorised evaluation; unknown symbols raise KeyError."""
    if isinstance(x, ast.Num):
        return np.float64(float(x.value))
    if isinstance(x, ast.Sym):
        return values[x.name] if x.name in values else 1j if x.name == "I" else np.float64(CONSTANTS[x.name])
    return LIBRARY[x.fn].numpy(*[to_numpy(a, values) for a in x.args])


def evaluate(x: ast.Node, /, **values: float) -> float | complex:
    out = to_numpy(x, values)
    return complex(out) if np.iscomplexobj(out) and abs(np.imag(out)) > 0 else float(np.real(out))


def to_python(name: str, params: list[str], x: ast.Node) -> str:
    """A Python function; math is imported if its text needs it."""

    def text(n: ast.Node) -> str:
        if isinstance(n, ast.Num):
            return str(n.value) if isinstance(n.value, Fraction) and n.value.denominator == 1 else f"({n.value})" if isinstance(n.value, Fraction) else repr(n.value)
        if isinstance(n, ast.Sym):
            return {"pi": "math.pi", "e": "math.e", "E": "math.e", "oo": "math.inf"}.get(n.name, n.name)
        template = LIBRARY[n.fn].python
        if not template:
            raise ValueError(f"{n.fn} has no Python form")
        return template.format(*[text(a) for a in n.args])

    body = text(x)
    head = "import math\n\n\n" if "math." in body else ""
    return f"{head}def {name}({', '.join(params)}):\n    return {body}\n"


# complex values as structs of re and im


def c_pair(re: str, im: str) -> tuple[str, str]:
    return f"({re})", f"({im})"


def complex_sql(x: ast.Node, dialect: str = "spark", names: dict[str, tuple[str, str]] | None = None) -> tuple[str, str]:
    """Real and imaginary parts of a tree over complex columns (symbol -> its two parts)."""
    names = names or {}
    if isinstance(x, ast.Num):
        return _number(x.value, dialect), "CAST(0 AS DOUBLE)"
    if isinstance(x, ast.Sym):
        if x.name == "I":
            return "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
        if x.name in names:
            return names[x.name]
        return to_sql(x, dialect), "CAST(0 AS DOUBLE)"
    a = [complex_sql(y, dialect, names) for y in x.args]
    divide = (lambda n, d: f"try_divide({n}, {d})") if dialect == "spark" else (lambda n, d: f"({n} / nullif({d}, 0))")
    (p, q), (r, s) = a[0], a[1] if len(a) > 1 else ("", "")
    match x.fn:
        case "add":
            return c_pair(f"{p} + {r}", f"{q} + {s}")
        case "sub":
            return c_pair(f"{p} - {r}", f"{q} - {s}")
        case "neg":
            return c_pair(f"-{p}", f"-{q}")
        case "mul":
            return c_pair(f"{p} * {r} - {q} * {s}", f"{p} * {s} + {q} * {r}")
        case "div":
            d = f"({r} * {r} + {s} * {s})"
            return divide(f"({p} * {r} + {q} * {s})", d), divide(f"({q} * {r} - {p} * {s})", d)
        case "exp":
            return c_pair(f"exp({p}) * cos({q})", f"exp({p}) * sin({q})")
        case "log":
            n = f"({p} * {p} + {q} * {q})"
            return f"(CASE WHEN {n} > 0 THEN 0.5 * ln({n}) END)", f"atan2({q}, {p})"
        case "sqrt":
            m = f"sqrt({p} * {p} + {q} * {q})"
            return f"sqrt(greatest(({m} + {p}) / 2.0, 0.0))", f"(CASE WHEN {q} < 0 THEN -1.0 ELSE 1.0 END * sqrt(greatest(({m} - {p}) / 2.0, 0.0)))"
        case "abs":
            return f"sqrt({p} * {p} + {q} * {q})", "CAST(0 AS DOUBLE)"
        case "sin":
            return c_pair(f"sin({p}) * cosh({q})", f"cos({p}) * sinh({q})")
        case "cos":
            return c_pair(f"cos({p}) * cosh({q})", f"-(sin({p}) * sinh({q}))")
        case "pow":
            return complex_sql(ast.Call("exp", (ast.Call("mul", (x.args[1], ast.Call("log", (x.args[0],)))),)), dialect, names)
    raise ValueError(f"{x.fn} has no complex form")
