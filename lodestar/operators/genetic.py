"""Formula search: a genetic programme whose islands breed on executors, scored by all rows.

This module has the trees' construction and variation, losses and the search's outer loop;
``islands`` has the population's table, its breeding and its scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ast
from ..functions.ast import Call, Node, Num, Sym
from ..functions.cas import simplify
from ..functions.compile import to_column, to_numpy
from ..functions.library import BINARY, UNARY
from ..functions.parse import parse
from ..functions.precise import precise


@dataclass
class Config:
    population: int = 500
    islands: int = 4
    generations: int = 100
    tournament: int = 5
    crossover: float = 0.7
    mutation: float = 0.1
    parsimony: float = 0.01
    depth: int = 8
    seconds: float = 60.0
    stop: float = 1e-10
    patience: int = 10
    migration_every: int = 10
    migration_share: float = 0.1
    elite: int = 5
    delta: float = 1.35
    most_complex: int = 100
    #: Rows that an island breeds on, in expectation, drawn anew at each migration.
    sample: int = 2000
    #: Share of a table of up to that size that breeding doesn't see, from 20 rows on.
    validation: float = 0.2
    #: Searches one after the other, each on what the sum of those before leaves.
    boosting: int = 1
    #: Tournaments go by error first and size second, errors within this share counting as equal; None: by penalised loss.
    lexicographic: float | None = None
    seed: int = 42
    unary: tuple[str, ...] = ("sin", "cos", "exp", "log", "sqrt", "square", "neg", "inv")
    binary: tuple[str, ...] = ("add", "sub", "mul", "div", "pow")
    seeds: tuple[str, ...] = field(default_factory=tuple)


class Breeder:
    """Seeded construction and variation of trees."""

    def __init__(self, variables: list[str], config: Config):
        self.v, self.c = variables, config
        self.rng = np.random.default_rng(config.seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def leaf(self) -> Node:
        if self.rng.random() < 0.7:
            return Sym(self.pick(self.v))
        return Num(Fraction(int(self.rng.integers(-5, 6)))) if self.rng.random() < 0.6 else Num(float(np.round(self.rng.normal(0, 3), 3)))

    def tree(self, depth: int, full: bool) -> Node:
        if depth <= 1 or (not full and self.rng.random() < 0.3):
            return self.leaf()
        if self.rng.random() < 0.35 and self.c.unary:
            return Call(UNARY[self.pick(self.c.unary)], (self.tree(depth - 1, full),))
        return Call(BINARY[self.pick(self.c.binary)], (self.tree(depth - 1, full), self.tree(depth - 1, full)))

    def initial(self) -> list[Node]:
        """Ramped half and half; up to half of it seeds and mutated copies of them."""
        seeds = [parse(s) for s in self.c.seeds]
        out = list(seeds)
        while seeds and len(out) < self.c.population // 2:
            out.append(self.mutate(self.pick(seeds)))
        while len(out) < self.c.population:
            out.append(self.tree(2 + len(out) % 4, bool(len(out) % 2)))
        return out[: self.c.population]

    def places(self, x: Node) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()]
        if isinstance(x, Call):
            for k, a in enumerate(x.args):
                out += [(k, *p) for p in self.places(a)]
        return out

    @staticmethod
    def at(x: Node, path: tuple[int, ...]) -> Node:
        for k in path:
            x = x.args[k]
        return x

    def put(self, x: Node, path: tuple[int, ...], new: Node) -> Node:
        if not path:
            return new
        return Call(x.fn, tuple(self.put(a, path[1:], new) if k == path[0] else a for k, a in enumerate(x.args)))

    def mutate(self, x: Node) -> Node:
        """Point, subtree, hoist or shrink mutation, or a nudge of a constant."""
        kind, path = self.rng.random(), self.pick(self.places(x))
        n = self.at(x, path)
        if kind < 0.35:
            if isinstance(n, Num):
                v = float(n.value)
                return self.put(x, path, Num(Fraction(round(v))) if self.rng.random() < 0.2 else Num(v * (1 + float(self.rng.normal(0, 0.2))) + float(self.rng.normal(0, 0.05))))
            if isinstance(n, Sym):
                return self.put(x, path, self.leaf())
            if len(n.args) == 1 and self.c.unary:
                return self.put(x, path, Call(UNARY[self.pick(self.c.unary)], n.args))
            if n.fn == "gp_pow" and self.rng.random() < 0.3:
                return self.put(x, path, Call(n.fn, (n.args[0], Call("inv", (n.args[1],)))))
            return self.put(x, path, Call(BINARY[self.pick(self.c.binary)], n.args)) if len(n.args) == 2 else x
        if kind < 0.65:
            return self.put(x, path, self.tree(3, False))
        if kind < 0.8:
            return n
        return self.put(x, path, self.leaf())

    def cross(self, a: Node, b: Node) -> Node:
        new = self.put(a, self.pick(self.places(a)), self.at(b, self.pick(self.places(b))))
        return new if ast.depth(new) <= self.c.depth + 2 else a


def fitness(df: DataFrame, variables: list[str], y: str, trees: list[Node], delta: float = 1.35) -> list[tuple[float, float]]:
    """(mean Huber loss, mse) of each tree over the table, by one pass; inf where any value isn't finite."""
    own = df.select(*[F.col(c).cast("double") for c in [*variables, y]]).na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), 3))
        for b in batches:
            x = {v: b.column(k).to_numpy() for k, v in enumerate(variables)}
            total += _losses(trees, x, b.column(len(variables)).to_numpy(), delta)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), *[pa.array(total[:, k]) for k in range(3)]], ["tree", "n", "huber", "sse"])

    out = [(math.inf, math.inf)] * len(trees)
    for r in own.mapInArrow(run, "tree long, n double, huber double, sse double").groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n", "huber", "sse")]).collect():
        if r.n and math.isfinite(r.sse):
            out[r.tree] = (r.huber / r.n, r.sse / r.n)
    return out


def _losses(trees: list[Node], x: dict[str, np.ndarray], y: np.ndarray, delta: float) -> np.ndarray:
    out = np.zeros((len(trees), 3))
    out[:, 0] = len(y)
    with np.errstate(all="ignore"):
        for k, t in enumerate(trees):
            p = np.broadcast_to(np.asarray(to_numpy(t, x), float), y.shape)
            e = np.abs(y - p)
            bad = not np.isfinite(e).all()
            out[k, 1:] = (math.inf, math.inf) if bad else (np.where(e <= delta, 0.5 * e * e, delta * (e - 0.5 * delta)).sum(), min(float(e @ e), 1e100))
    return out


def constants(x: Node) -> list[tuple[int, ...]]:
    """Paths of the numbers in a tree."""
    if isinstance(x, Num):
        return [()]
    return [(k, *p) for k, a in enumerate(x.args) for p in constants(a)] if isinstance(x, Call) else []


def polish(tree: Node, x: dict[str, np.ndarray], y: np.ndarray, breeder: Breeder, rounds: int = 30) -> Node:
    """Hill-climbs a tree's constants, then snaps each to a whole number if that is at most a twentieth worse."""
    mse = lambda ts: _losses(ts, x, y, 1.35)[:, 2] / max(len(y), 1)
    best, low = tree, float(mse([tree])[0])
    paths, step = constants(tree), 0.2
    for _ in range(rounds if paths else 0):
        tries = [breeder.put(best, p, Num(float(breeder.at(best, p).value) * (1 + s * step) + s * step * 0.01)) for p in paths for s in (-1, 1)]
        scores = mse(tries)
        k = int(np.nanargmin(scores))
        if scores[k] < low:
            best, low = tries[k], float(scores[k])
        else:
            step /= 2
    for p in paths:
        v = float(breeder.at(best, p).value)
        if abs(v) < 1e9 and v != round(v):
            snapped = breeder.put(best, p, Num(Fraction(round(v))))
            if (m := float(mse([snapped])[0])) <= low * 1.05 + 1e-15:
                best, low = snapped, m
    return best


@dataclass
class Search:
    """Results of a search: the front of (formula, mse, complexity), best and knee."""

    front: list[tuple[str, float, int]]
    generations: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.front, "formula string, mse double, complexity int")

    @property
    def best(self) -> tuple[str, float, int]:
        return min(self.front, key=lambda r: (r[1], r[2]))

    @property
    def knee(self) -> tuple[str, float, int]:
        perfect = [r for r in self.front if r[1] < 1e-9]
        if perfect:
            return min(perfect, key=lambda r: r[2])
        c = [math.log10(max(r[1], 1e-30)) for r in self.front]
        s = [r[2] for r in self.front]
        norm = lambda v, xs: (v - min(xs)) / ((max(xs) - min(xs)) or 1)
        return max(self.front, key=lambda r: 1 - norm(math.log10(max(r[1], 1e-30)), c) - norm(r[2], s))


def winner(entrants: list[tuple[float, int]], margin: float | None) -> int:
    """Which of (loss or error, size) wins a tournament: the least loss; or with a margin, of those within it of the least error the smallest."""
    least = min(e for e, _ in entrants)
    if margin is None or not math.isfinite(least):
        return min(range(len(entrants)), key=lambda k: (entrants[k][0], k))
    return min((k for k, (e, _) in enumerate(entrants) if e <= least * (1 + margin) + 1e-15), key=lambda k: (entrants[k][1], entrants[k][0], k))


def search(df: DataFrame, variables: list[str], y: str, config: Config | None = None) -> Search:
    """Islands that breed apart and trade their best; ends by time, patience or a perfect fit.

    Each island breeds on its own rows; every tree is scored by all rows of the table at each migration. With boosting,
    later rounds search what is left.
    """
    from .islands import evolve

    c = config or Config()
    cols = [*variables, y]
    rows = df.select(*[F.col(k).cast("double").alias(k) for k in cols]).na.drop()
    found, made = evolve(rows, variables, y, c)
    for _ in range(1, c.boosting):
        if not found or min(m for _, m in found) < c.stop:
            break
        best = min(found, key=lambda r: (r[1], ast.size(r[0])))[0]
        left = rows.withColumn(y, F.col(y) - to_column(best)).filter(F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
        more, again = evolve(left, variables, y, c)
        made += again
        sums = [Call("add", (best, t)) for t, _ in more]
        found += [(t, m) for t, (_, m) in zip(sums, fitness(rows, variables, y, sums, c.delta) if sums else [], strict=True) if math.isfinite(m)]
    front: dict[int, tuple[Node, float]] = {}
    for t, m in found:
        if ast.size(t) not in front or m < front[ast.size(t)][1]:
            front[ast.size(t)] = (t, m)
    kept, low = [], math.inf
    for size in sorted(front):
        if front[size][1] < low:
            low = front[size][1]
            kept.append((ast.text(plain(front[size][0])), low, size))
    return Search(kept, made)


def plain(x: Node) -> Node:
    """Guarded search functions by their plain names, simplified."""
    names = {v: k for k, v in {**UNARY, **BINARY}.items() if v.startswith("gp_")}

    def step(n: Node) -> Node | None:
        if not isinstance(n, Call):
            return None
        if n.fn == "square":
            return n.args[0] ** 2
        if n.fn == "cube":
            return n.args[0] ** 3
        if n.fn == "inv":
            return 1 / n.args[0]
        return ast.call(names[n.fn], *n.args) if n.fn in names else None

    return simplify(ast.rebuild(x, step))


def search_transformed(df: DataFrame, variables: list[str], y: str, config: Config | None = None) -> tuple[str, str, float]:
    """(transform, formula, mse on the original target) of the best of the direct, log and inverse targets."""
    from .project import target_transforms

    best = ("direct", "0", math.inf)
    back = {"direct": lambda f: f, "log": lambda f: f"exp({f})", "inverse": lambda f: f"1/({f})"}
    for name, own in target_transforms(df, y).items():
        formula = back[name](search(own, variables, y, config).best[0])
        mse = fitness(df, variables, y, [parse(formula)])[0][1]
        if mse < best[2]:
            best = (name, formula, mse)
        if best[2] < 1e-9:
            break
    return best


def precise_mse(df: DataFrame, formula: str, variables: list[str], y: str, digits: int = 50, rows: int = 1000) -> Decimal:
    """Mean squared error in decimal arithmetic of ``digits`` digits, over up to ``rows`` rows (a check of a finished formula, not of the search)."""
    x = parse(formula)
    with localcontext() as c:
        c.prec = digits
        total, n = Decimal(0), 0
        for r in df.select(*variables, y).na.drop().limit(rows).collect():
            e = Decimal(r[-1]) - precise(x, {v: Decimal(r[k]) for k, v in enumerate(variables)})
            total, n = total + e * e, n + 1
        return total / n if n else Decimal("NaN")


def discover_equation(df: DataFrame, variables: list[str], y: str, config: Config | None = None) -> str:
    """The knee of the front, or the best where that is perfect."""
    found = search(df, variables, y, config)
    return (found.best if found.best[1] < 1e-9 else found.knee)[0]
