"""The public functions: evaluate, solve, differentiate, discover; results as dataclasses."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import ast, cas
from .functions.cache import EvaluationCache
from .functions.compile import evaluate as value_of
from .functions.exactness import text_number
from .functions.parse import FormulaError, parse
from .functions.registry import Registry
from .operators.solve import Result, solve_equation, solve_inequality, solve_system


@dataclass
class Evaluation:
    ok: bool
    result: str | None = None
    approx: str | None = None
    free_symbols: list[str] | None = None
    error: str | None = None
    error_code: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


#: Functions and variables of the session, and its evaluations.
session = Registry()
cache = EvaluationCache()


def _structural(x: ast.Node) -> ast.Node:
    """Carries out diff, integrate, limit, expand, factor, simplify and det inside a formula."""

    def step(n: ast.Node) -> ast.Node | None:
        if not isinstance(n, ast.Call):
            return None
        a = n.args
        name = a[1].name if len(a) > 1 and isinstance(a[1], ast.Sym) else (ast.symbols(a[0]) or ["x"])[0] if a else "x"
        match n.fn:
            case "diff":
                out = a[0]
                for _ in range(int(a[2].value) if len(a) > 2 else 1):
                    out = cas.simplify(cas.diff(out, name))
                return out
            case "integrate":
                f = cas.simplify(cas.integrate(a[0], name))
                if len(a) == 4:
                    return ast.substitute(f, {name: a[3]}) - ast.substitute(f, {name: a[2]})
                return f
            case "limit":
                v = cas.limit(a[0], name, float(np.real(value_of(a[2]))) if len(a) > 2 else 0.0)
                return ast.Sym("oo") if v == math.inf else ast.neg(ast.Sym("oo")) if v == -math.inf else ast.wrap(int(v) if v == int(v) else v) if v == v else ast.Sym("nan")
            case "expand":
                return cas.expand(a[0])
            case "factor":
                return cas.factor(a[0], name)
            case "simplify":
                return cas.simplify(a[0])
            case "det":
                return cas.simplify(_det(_rows(a[0])))
        return None

    return ast.rebuild(x, step)


def _rows(m: ast.Node) -> list[list[ast.Node]]:
    while isinstance(m, ast.Call) and m.fn == "matrix":
        m = m.args[0]
    rows = [list(r.args) for r in m.args if isinstance(r, ast.Call) and r.fn == "row"]
    if not rows or any(len(r) != len(rows) for r in rows):
        raise FormulaError("FORBIDDEN_TYPE", "a determinant needs a square matrix")
    return rows


def _det(m: list[list[ast.Node]]) -> ast.Node:
    if len(m) == 1:
        return m[0][0]
    out: ast.Node = ast.ZERO
    for j, c in enumerate(m[0]):
        minor = c * _det([[*r[:j], *r[j + 1 :]] for r in m[1:]])
        out = out - minor if j % 2 else out + minor
    return out


def evaluate(text: str) -> Evaluation:
    """The simplified formula, its value if it has no free symbols, and those symbols."""
    if isinstance(text, str) and (known := cache.get(text, session)) is not None:
        return Evaluation(**known)
    out = _evaluate(text)
    if out.ok:
        cache.put(text, session, out.to_dict())
    return out


def _evaluate(text: str) -> Evaluation:
    try:
        tree = session.expand(text)
        x = _structural(tree)
        if not (isinstance(tree, ast.Call) and tree.fn in ("factor", "expand")):
            x = cas.simplify(x)
        free = ast.symbols(x)
        approx = None
        if not free:
            v = value_of(x)
            approx = text_number(v) if isinstance(v, float) else f"{v:.12g}"
        return Evaluation(True, ast.text(x), approx, free)
    except FormulaError as e:
        return Evaluation(False, error=str(e), error_code=e.code)
    except (ValueError, KeyError, ZeroDivisionError, OverflowError) as e:
        return Evaluation(False, error=str(e), error_code="EVALUATION_ERROR")


def validate(text: str) -> tuple[bool, str | None]:
    try:
        parse(text, set(session.functions))
        return True, None
    except FormulaError as e:
        return False, e.code


def diff(text: str, name: str = "x") -> Evaluation:
    return evaluate(f"diff({text}, {name})")


def integrate(text: str, name: str = "x") -> Evaluation:
    return evaluate(f"integrate({text}, {name})")


def det(text: str) -> Evaluation:
    return evaluate(f"det({text})")


def equation(text: str, name: str | None = None) -> Result:
    return solve_equation(text, name)


def inequality(text: str, name: str | None = None) -> Result:
    return solve_inequality(text, name)


def system(text: str) -> Result:
    return solve_system(text)


_EVALUATION = T.StructType([T.StructField(k, t) for k, t in (("ok", T.BooleanType()), ("result", T.StringType()), ("approx", T.StringType()), ("free_symbols", T.ArrayType(T.StringType())), ("error", T.StringType()), ("error_code", T.StringType()))])


def evaluate_column(df: DataFrame, col: str, out: str = "evaluation") -> DataFrame:
    """Adds the evaluation of a column of formula texts, by Arrow batches; equal texts of a batch are read once."""
    import pandas as pd

    @F.pandas_udf(_EVALUATION)
    def run(texts: pd.Series) -> pd.DataFrame:
        known = {t: evaluate(t).to_dict() if t is not None else Evaluation(False, error_code="EMPTY_INPUT").to_dict() for t in texts.unique()}
        return pd.DataFrame([known[t] for t in texts])

    return df.withColumn(out, run(F.col(col)))


def formula(text: str) -> Column:
    """A formula over a table's columns as a Spark column."""
    from .functions.compile import to_column

    return to_column(_structural(session.expand(text)))
