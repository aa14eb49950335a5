"""Formula text to trees: a preprocessor for calculator notation and a precedence parser.

Errors carry a code: EMPTY_INPUT, TOO_LONG, TOO_DEEP, TOO_COMPLEX, FORBIDDEN_TOKEN,
FORBIDDEN_FUNCTION, UNBALANCED_PARENS, UNMATCHED_QUOTES, WRONG_ARGUMENT_COUNT, SYNTAX_ERROR.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

from . import ast
from .library import LIBRARY

# fixed values: limits of accepted input
MAX_LENGTH, MAX_DEPTH, MAX_NODES = 10_000, 100, 5_000
FORBIDDEN = ("__", "import", "lambda", "eval", "exec", "open(", "os.", "sys.", "subprocess", ";", "\\", "`", "@")
SUPERSCRIPTS = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+", strict=True))
SIGNS = {"−": "-", "–": "-", "—": "-", "×": "*", "·": "*", "⋅": "*", "÷": "/", "π": "pi", "∞": "oo", "≤": "<=", "≥": ">=", "≠": "!=", "∧": "&", "Δ": "Delta"}
#: Functions of one or more arguments that the tree knows beyond the library.
STRUCTURAL = {"diff": (1, 3), "integrate": (1, 4), "limit": (2, 3), "factor": (1, 1), "expand": (1, 1), "simplify": (1, 1), "det": (1, 1), "matrix": (1, 99), "row": (1, 99), "piecewise": (2, 99), "minimum": (1, 99), "maximum": (1, 99)}
ALIASES = {"Matrix": "matrix", "Piecewise": "piecewise", "Max": "max", "Min": "min", "besselj": "besselj", "Eq": "eq", "Ne": "ne", "Lt": "lt", "Le": "le", "Gt": "gt", "Ge": "ge", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh", "W": "lambertw"}


class FormulaError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def preprocess(text: str) -> str:
    """Calculator notation to plain operators: comments, unicode signs, powers, per cent, hex, implicit products."""
    if text is None or not text.strip():
        raise FormulaError("EMPTY_INPUT", "nothing to parse")
    if len(text) > MAX_LENGTH:
        raise FormulaError("TOO_LONG", f"over {MAX_LENGTH} characters")
    s = text.split("#", 1)[0].strip()
    if not s:
        raise FormulaError("EMPTY_INPUT", "nothing but a comment")
    for bad in FORBIDDEN:
        if bad in s:
            raise FormulaError("FORBIDDEN_TOKEN", f"{bad!r} isn't allowed")
    if s.count('"') % 2 or s.count("'") % 2:
        raise FormulaError("UNMATCHED_QUOTES", "a quote isn't closed")
    for a, b in SIGNS.items():
        s = s.replace(a, b)
    s = re.sub(f"[{''.join(SUPERSCRIPTS)}]+", lambda m: "^" + (d if len(d := "".join(SUPERSCRIPTS[c] for c in m[0])) == 1 else f"({d})"), s)
    s = re.sub(r"\b0[xX]([0-9a-fA-F]+)\b", lambda m: str(int(m[1], 16)), s)
    s = re.sub(r"√\s*\(", "sqrt(", s)
    s = re.sub(r"√\s*([A-Za-z0-9.]+)", r"sqrt(\1)", s)
    s = s.replace("**", "^")
    s = re.sub(r"(\d+(?:\.\d+)?|\))\s*%(?!\s*[\w(.])", lambda m: f"({m[1]}/100)" if m[1] != ")" else ")/100", s)
    s = re.sub(r"\bmod\b(?!\s*\()", "%", s)
    opens = 0
    for c in s:
        opens += (c in "([{") - (c in ")]}")
        if opens < 0:
            raise FormulaError("UNBALANCED_PARENS", "a bracket closes that wasn't opened")
        if opens > MAX_DEPTH:
            raise FormulaError("TOO_DEEP", f"over {MAX_DEPTH} brackets deep")
    if opens:
        raise FormulaError("UNBALANCED_PARENS", "a bracket isn't closed")
    return s


_LEX = re.compile(r"\s*(?:(\d++(?:\.\d*+)?+(?:[eE][+-]?\d++(?![A-Za-z_(]))?|\.\d++(?:[eE][+-]?\d++)?)|([A-Za-z_]\w*)|(<=|>=|!=|==|[-+*/^%(),<>=\[\]!|&]))")


def tokens(s: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(s):
        m = _LEX.match(s, at)
        if not m or m.end() == at:
            if s[at:].isspace():
                break
            raise FormulaError("SYNTAX_ERROR", f"{s[at:at + 12]!r} isn't understood")
        kind = "num" if m[1] else "name" if m[2] else "op"
        out.append((kind, m[1] or m[2] or m[3]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, toks: list[tuple[str, str]], allowed: frozenset[str]):
        self.t, self.i, self.allowed, self.level = toks, 0, allowed, 0

    def peek(self) -> tuple[str, str]:
        return self.t[self.i] if self.i < len(self.t) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        tok = self.peek()
        if value is not None and tok[1] != value:
            raise FormulaError("SYNTAX_ERROR", f"expected {value!r}, found {tok[1] or 'the end'!r}")
        self.i += 1
        return tok

    def relation(self) -> ast.Node:
        left = self.sum()
        names = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "=": "eq", "==": "eq", "!=": "ne"}
        out = None
        while self.peek()[0] == "op" and self.peek()[1] in names:
            fn = names[self.take()[1]]
            right = self.sum()
            part = ast.Call(fn, (left, right))
            # a chain a < b < c holds if each part does
            out = part if out is None else ast.Call("mul", (out, part))
            left = right
        return left if out is None else out

    def sum(self) -> ast.Node:
        left = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            left = ast.add(left, self.product()) if self.take()[1] == "+" else ast.sub(left, self.product())
        return left

    def product(self) -> ast.Node:
        left = self.unary()
        while True:
            kind, v = self.peek()
            if (kind, v) in (("op", "*"), ("op", "/"), ("op", "%")):
                self.take()
                right = self.unary()
                left = ast.mul(left, right) if v == "*" else ast.div(left, right) if v == "/" else ast.call("mod", left, right)
            elif kind in ("num", "name") or (kind, v) == ("op", "("):
                left = ast.mul(left, self.factor())  # 2x, 3(x + 1), x y
            else:
                return left

    def unary(self) -> ast.Node:
        kind, v = self.peek()
        if kind == "op" and v in "+-":
            self.take()
            self.level += 1
            if self.level > MAX_DEPTH:
                raise FormulaError("TOO_DEEP", "too many signs in a row")
            x = self.unary()
            self.level -= 1
            return ast.neg(x) if v == "-" else x
        return self.factor()

    def factor(self) -> ast.Node:
        base = self.atom()
        while self.peek() == ("op", "!"):
            self.take()
            base = ast.call("factorial", base)
        if self.peek() == ("op", "^"):
            self.take()
            return ast.power(base, self.unary())
        return base

    def arguments(self, close: str) -> list[ast.Node]:
        out = []
        if self.peek() != ("op", close):
            out.append(self.relation())
            while self.peek() == ("op", ","):
                self.take()
                out.append(self.relation())
        self.take(close)
        return out

    def atom(self) -> ast.Node:
        kind, v = self.take()
        self.level += 1
        if self.level > 4 * MAX_DEPTH:
            raise FormulaError("TOO_DEEP", "nested too deeply")
        try:
            if kind == "num":
                return ast.Num(Fraction(v) if "e" not in v.lower() else float(v))
            if (kind, v) == ("op", "("):
                inner = self.arguments(")")
                return inner[0] if len(inner) == 1 else ast.Call("row", tuple(inner))
            if (kind, v) == ("op", "["):
                return ast.Call("row", tuple(self.arguments("]")))
            if (kind, v) == ("op", "|"):
                inner = self.sum()
                self.take("|")
                return ast.call("abs", inner)
            if kind == "name":
                if self.peek() == ("op", "("):
                    return self.called(v)
                return ast.Sym(v)
        finally:
            self.level -= 1
        raise FormulaError("SYNTAX_ERROR", f"{v or 'the end'!r} isn't expected")

    def called(self, name: str) -> ast.Node:
        name = ALIASES.get(name, name)
        if name in LIBRARY or name in STRUCTURAL or name in self.allowed or name == "besselj":
            self.take("(")
            args = self.arguments(")")
            if name == "log" and len(args) == 2:
                return ast.div(ast.call("log", args[0]), ast.call("log", args[1]))
            if name == "besselj" and len(args) == 2:
                return ast.call("besselj0" if ast.is_num(args[0], 0) else "besselj1", args[1])
            if name in ("min", "max") and len(args) > 2:
                out = args[0]
                for a in args[1:]:
                    out = ast.call(name, out, a)
                return out
            if name in LIBRARY and len(args) != LIBRARY[name].arity:
                raise FormulaError("WRONG_ARGUMENT_COUNT", f"{name} takes {LIBRARY[name].arity}, not {len(args)}")
            if name in STRUCTURAL and not STRUCTURAL[name][0] <= len(args) <= STRUCTURAL[name][1]:
                raise FormulaError("WRONG_ARGUMENT_COUNT", f"{name} doesn't take {len(args)}")
            if name == "piecewise":
                out = ast.Sym("nan")
                for pair in reversed(args):
                    value, cond = pair.args
                    out = value if isinstance(cond, ast.Sym) and cond.name == "True" else ast.Call("if", (cond, value, out))
                return out
            return ast.call(name, *args)
        if len(name) == 1 or name in ("pi", "oo"):
            return ast.Sym(name)  # x(y + 1) is a product
        raise FormulaError("FORBIDDEN_FUNCTION", f"{name} isn't known")


@lru_cache(maxsize=4096)
def _parsed(text: str, allowed: frozenset[str]) -> ast.Node:
    p = _Parser(tokens(preprocess(text)), allowed)
    out = p.relation()
    if p.peek()[0] != "end":
        raise FormulaError("SYNTAX_ERROR", f"{p.peek()[1]!r} isn't expected")
    if ast.size(out) > MAX_NODES:
        raise FormulaError("TOO_COMPLEX", f"over {MAX_NODES} nodes")
    if ast.depth(out) > MAX_DEPTH:
        raise FormulaError("TOO_DEEP", f"over {MAX_DEPTH} levels")
    return out


def parse(text: str, allowed: set[str] | frozenset[str] = frozenset()) -> ast.Node:
    """The tree of a formula; ``allowed`` names further functions."""
    if not isinstance(text, str):
        raise FormulaError("FORBIDDEN_TYPE", f"{type(text).__name__} isn't text")
    return _parsed(text, frozenset(allowed))


def split_top_level(text: str, by: str = ",") -> list[str]:
    """Splits at separators outside brackets."""
    out, level, start = [], 0, 0
    for k, c in enumerate(text):
        level += (c in "([{") - (c in ")]}")
        if c == by and level == 0:
            out.append(text[start:k].strip())
            start = k + 1
    return [*out, text[start:].strip()]
