"""Expression trees: numbers, symbols and calls, with folding, substitution, size and depth."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction


class Node:
    __slots__ = ()

    def __add__(self, other): return add(self, wrap(other))
    def __radd__(self, other): return add(wrap(other), self)
    def __sub__(self, other): return sub(self, wrap(other))
    def __rsub__(self, other): return sub(wrap(other), self)
    def __mul__(self, other): return mul(self, wrap(other))
    def __rmul__(self, other): return mul(wrap(other), self)
    def __truediv__(self, other): return div(self, wrap(other))
    def __rtruediv__(self, other): return div(wrap(other), self)
    def __pow__(self, other): return power(self, wrap(other))
    def __neg__(self): return neg(self)


@dataclass(frozen=True, slots=True)
class Num(Node):
    value: Fraction | float


@dataclass(frozen=True, slots=True)
class Sym(Node):
    name: str


@dataclass(frozen=True, slots=True)
class Call(Node):
    fn: str
    args: tuple[Node, ...]


def wrap(x) -> Node:
    if isinstance(x, Node):
        return x
    return Num(Fraction(x) if isinstance(x, (int, Fraction)) else float(x))


ZERO, ONE, TWO = Num(Fraction(0)), Num(Fraction(1)), Num(Fraction(2))


def is_num(x: Node, value=None) -> bool:
    return isinstance(x, Num) and (value is None or x.value == value)


def _fold(a: Node, b: Node, op: Callable) -> Node | None:
    if isinstance(a, Num) and isinstance(b, Num):
        try:
            return Num(op(a.value, b.value))
        except (ZeroDivisionError, OverflowError, ValueError):
            return None
    return None


def add(a: Node, b: Node) -> Node:
    if is_num(a, 0):
        return b
    if is_num(b, 0):
        return a
    return _fold(a, b, lambda x, y: x + y) or Call("add", (a, b))


def sub(a: Node, b: Node) -> Node:
    if is_num(b, 0):
        return a
    if a == b:
        return ZERO
    return _fold(a, b, lambda x, y: x - y) or Call("sub", (a, b))


def mul(a: Node, b: Node) -> Node:
    if is_num(a, 0) or is_num(b, 0):
        return ZERO
    if is_num(a, 1):
        return b
    if is_num(b, 1):
        return a
    return _fold(a, b, lambda x, y: x * y) or Call("mul", (a, b))


def div(a: Node, b: Node) -> Node:
    if is_num(b, 1):
        return a
    if is_num(a, 0) and not is_num(b, 0):
        return ZERO
    return _fold(a, b, lambda x, y: x / y) or Call("div", (a, b))


def power(a: Node, b: Node) -> Node:
    if is_num(b, 1):
        return a
    if is_num(b, 0):
        return ONE
    if isinstance(a, Num) and isinstance(b, Num) and isinstance(a.value, Fraction) and isinstance(b.value, Fraction):
        if b.value.denominator == 1 and abs(b.value) <= 64 and (a.value != 0 or b.value > 0):
            return Num(a.value ** int(b.value))
        return Call("pow", (a, b))
    return Call("pow", (a, b))


def neg(a: Node) -> Node:
    if isinstance(a, Num):
        return Num(-a.value)
    if isinstance(a, Call) and a.fn == "neg":
        return a.args[0]
    return Call("neg", (a,))


def call(fn: str, *args) -> Node:
    a = tuple(wrap(x) for x in args)
    builders = {"add": add, "sub": sub, "mul": mul, "div": div, "pow": power, "neg": neg}
    return builders[fn](*a) if fn in builders else Call(fn, a)


def rebuild(x: Node, fn: Callable[[Node], Node | None]) -> Node:
    """Replaces nodes bottom up; fn returns None to keep one."""
    if isinstance(x, Call):
        x = call(x.fn, *[rebuild(a, fn) for a in x.args])
    out = fn(x)
    return x if out is None else out


def substitute(x: Node, by: dict[str, Node]) -> Node:
    return rebuild(x, lambda n: by.get(n.name) if isinstance(n, Sym) else None)


def walk(x: Node) -> Iterator[Node]:
    yield x
    if isinstance(x, Call):
        for a in x.args:
            yield from walk(a)


def symbols(x: Node) -> list[str]:
    """Names in order of first appearance, without constants."""
    return list(dict.fromkeys(n.name for n in walk(x) if isinstance(n, Sym) and n.name not in ("pi", "e", "E", "I", "oo", "nan", "zoo")))


def size(x: Node) -> int:
    return sum(1 for _ in walk(x))


def depth(x: Node) -> int:
    return 1 + max((depth(a) for a in x.args), default=0) if isinstance(x, Call) else 1


#: Weights of weighted complexity; others count 1.
WEIGHTS = {"mul": 1, "div": 2, "pow": 2, "sin": 2, "cos": 2, "tan": 3, "exp": 2, "log": 2, "sqrt": 2, "gamma": 3, "besselj0": 4, "besselj1": 4, "lambertw": 4, "erf": 3}


def complexity(x: Node, weighted: bool = False) -> float:
    return sum(WEIGHTS.get(n.fn, 1) if weighted and isinstance(n, Call) else 1 for n in walk(x))


def text(x: Node) -> str:
    """Formula text: ^ for powers, shortest decimals, parentheses only where needed."""
    return _text(x, 0)


def number(v) -> str:
    if isinstance(v, Fraction):
        return str(v.numerator) if v.denominator == 1 else f"{v.numerator}/{v.denominator}"
    if math.isfinite(v) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return repr(float(f"{v:.12g}"))


def _text(x: Node, outer: int) -> str:
    if isinstance(x, Num):
        s = number(x.value)
        prec = 1 if s.startswith("-") else 2 if "/" in s else 9
    elif isinstance(x, Sym):
        return x.name
    else:
        a = x.args
        match x.fn:
            case "add":
                right = a[1]
                if isinstance(right, Call) and right.fn == "neg":
                    s, prec = f"{_text(a[0], 1)} - {_text(right.args[0], 2)}", 1
                elif isinstance(right, Num) and right.value < 0:
                    s, prec = f"{_text(a[0], 1)} - {number(-right.value)}", 1
                else:
                    s, prec = f"{_text(a[0], 1)} + {_text(right, 1)}", 1
            case "sub":
                s, prec = f"{_text(a[0], 1)} - {_text(a[1], 2)}", 1
            case "mul":
                s, prec = f"{_text(a[0], 2)}*{_text(a[1], 3)}", 2
            case "div":
                s, prec = f"{_text(a[0], 2)}/{_text(a[1], 3)}", 2
            case "neg":
                s, prec = f"-{_text(a[0], 2)}", 1
            case "pow":
                s, prec = f"{_text(a[0], 5)}^{_text(a[1], 4)}", 4
            case "lt" | "le" | "gt" | "ge" | "eq" | "ne":
                sign = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "!="}[x.fn]
                s, prec = f"{_text(a[0], 1)} {sign} {_text(a[1], 1)}", 0
            case _:
                return f"{x.fn}({', '.join(_text(y, 0) for y in a)})"
    return f"({s})" if prec < outer else s
