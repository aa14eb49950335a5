"""User functions: defined as text, inlined into formulas, registered as SQL functions, saved as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from . import ast
from .compile import to_python, to_sql
from .parse import FormulaError, parse, split_top_level

_DEFINITION = re.compile(r"\s*([A-Za-z_]\w*)\s*\(([^()]*)\)\s*=\s*(.+)", re.S)
_VALUE = re.compile(r"\s*([A-Za-z_]\w*)\s*=\s*([^=].*)", re.S)


class Registry:
    """Functions by name: parameters and body; variables are functions without parameters."""

    def __init__(self) -> None:
        self.functions: dict[str, tuple[list[str], str]] = {}

    def define(self, text: str) -> str:
        """From f(x, y) = body, or a = value; returns the name."""
        m = _DEFINITION.fullmatch(text)
        if m:
            name, params, body = m[1], [p.strip() for p in m[2].split(",") if p.strip()], m[3].strip()
        else:
            m = _VALUE.fullmatch(text)
            if not m:
                raise FormulaError("SYNTAX_ERROR", "a definition is name(parameters) = formula")
            name, params, body = m[1], [], m[2].strip()
        parse(body, set(self.functions) | {name})
        self.functions[name] = (params, body)
        return name

    def expand(self, text: str, depth: int = 20) -> ast.Node:
        """The tree with user functions and variables replaced by their bodies."""
        if depth == 0:
            raise FormulaError("TOO_DEEP", "functions call each other without end")
        tree = parse(text, set(self.functions))

        def step(n: ast.Node) -> ast.Node | None:
            if isinstance(n, ast.Sym) and n.name in self.functions and not self.functions[n.name][0]:
                return self.expand(self.functions[n.name][1], depth - 1)
            if isinstance(n, ast.Call) and n.fn in self.functions:
                params, body = self.functions[n.fn]
                if len(params) != len(n.args):
                    raise FormulaError("WRONG_ARGUMENT_COUNT", f"{n.fn} takes {len(params)}, not {len(n.args)}")
                return ast.substitute(self.expand(body, depth - 1), dict(zip(params, n.args, strict=True)))
            return None

        return ast.rebuild(tree, step)

    def register(self, spark: SparkSession, name: str) -> None:
        """As a temporary SQL function, which the optimizer inlines."""
        params, body = self.functions[name]
        sql = to_sql(self.expand(body), "spark", {p: p for p in params})
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} DOUBLE' for p in params)}) RETURNS DOUBLE RETURN {sql}")

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({k: {"params": p, "body": b} for k, (p, b) in self.functions.items()}, f, indent=1)

    def load(self, path: str) -> list[str]:
        """Returns the names that couldn't be read."""
        bad = []
        with open(path, encoding="utf-8") as f:
            for name, v in json.load(f).items():
                try:
                    self.define(f"{name}({', '.join(v['params'])}) = {v['body']}" if v["params"] else f"{name} = {v['body']}")
                except (FormulaError, KeyError, TypeError):
                    bad.append(name)
        return bad

    def export(self, name: str) -> str:
        """Python source of a function."""
        params, body = self.functions[name]
        return to_python(name, params, self.expand(body))

    def clear(self) -> None:
        self.functions.clear()


def points(text: str, name: str) -> list[tuple[list[str], str]]:
    """The literal points f(1, 2) = 3 of a comma list."""
    out = []
    for part in split_top_level(text):
        m = re.fullmatch(rf"{re.escape(name)}\s*\((.*)\)\s*=\s*([^=]+)", part.strip())
        if m:
            out.append((split_top_level(m[1]), m[2].strip()))
    return out
