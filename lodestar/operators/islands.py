"""Islands of a formula search on executors: the population is a table, and one task breeds an island.

An epoch has three jobs. Each island breeds for some generations on rows of its own, drawn anew from the table each time
and of bounded number. All trees of all islands are then scored on all rows of the table: every distinct subexpression
is evaluated once for a batch, and what leaves a task is one sum a tree. By these losses the best of each island move on
to the next one, a shuffle by island. The driver sees the front alone, one formula for each size.

A seed, an island and an epoch fix every choice, so a table and a seed have one front (unless time runs out).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ast
from ..functions.ast import Call, Node, Num, Sym
from ..functions.library import CONSTANTS, LIBRARY
from .genetic import Breeder, Config, polish, winner
from .quantile import shared_folder

TABLE = "island int, id int, tree string, size int"
#: Numbers that the values of all subexpressions may take at once in a task.
MOST_VALUES = 4_000_000


def encode(x: Node) -> str:
    def step(n: Node):
        if isinstance(n, Num):
            return ["q", str(n.value)] if isinstance(n.value, Fraction) else ["f", n.value]
        return n.name if isinstance(n, Sym) else [n.fn, *map(step, n.args)]

    return json.dumps(step(x), separators=(",", ":"))


def decode(text: str) -> Node:
    def step(n) -> Node:
        if isinstance(n, str):
            return Sym(n)
        if n[0] in ("q", "f"):
            return Num(Fraction(n[1]) if n[0] == "q" else float(n[1]))
        return Call(n[0], tuple(map(step, n[1:])))

    return step(json.loads(text))


class Shared:
    """Distinct subexpressions of trees, each after those it is made of."""

    def __init__(self, trees: list[Node]):
        self.steps: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.roots = [self._add(t) for t in trees]
        #: Which values no later step needs.
        last = {k: n for n, s in enumerate(self.steps) if s[0] == "call" for k in s[2]}
        kept = set(self.roots)
        self.free: list[list[int]] = [[] for _ in self.steps]
        for k, n in last.items():
            if k not in kept:
                self.free[n].append(k)

    def _add(self, x: Node) -> int:
        step = ("number", float(x.value)) if isinstance(x, Num) else ("name", x.name) if isinstance(x, Sym) else ("call", x.fn, tuple(self._add(a) for a in x.args))
        if step not in self.known:
            self.known[step] = len(self.steps)
            self.steps.append(step)
        return self.known[step]

    def losses(self, x: dict[str, np.ndarray], y: np.ndarray, delta: float) -> np.ndarray:
        """(rows, sum of Huber losses, sum of squares) of each tree; infinite where a value isn't finite."""
        at: dict[int, list[int]] = {}
        for tree, root in enumerate(self.roots):
            at.setdefault(root, []).append(tree)
        out = np.zeros((len(self.roots), 3))
        out[:, 0] = len(y)
        values: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for n, step in enumerate(self.steps):
                values[n] = np.float64(step[1]) if step[0] == "number" else (x[step[1]] if step[1] in x else np.float64(CONSTANTS[step[1]])) if step[0] == "name" else LIBRARY[step[1]].numpy(*[values[k] for k in step[2]])
                if n in at:
                    e = np.abs(y - np.broadcast_to(np.asarray(values[n], float), y.shape))
                    good = np.isfinite(e).all()
                    out[at[n], 1:] = (np.where(e <= delta, 0.5 * e * e, delta * (e - 0.5 * delta)).sum(), min(float(e @ e), 1e100)) if good else (math.inf, math.inf)
                    if self.steps[n][0] == "call" and n not in self._used:
                        del values[n]
                for k in self.free[n]:
                    values.pop(k, None)
        return out

    @property
    def _used(self) -> set[int]:
        if not hasattr(self, "_inner"):
            self._inner = {k for s in self.steps if s[0] == "call" for k in s[2]}
        return self._inner


def scored(rows: DataFrame, variables: list[str], y: str, trees: list[str], delta: float) -> DataFrame:
    """tree, huber and mse of encoded trees over all rows (infinite where a value isn't finite), by one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Shared([decode(t) for t in trees])
        total = np.zeros((len(trees), 3))
        most = max(64, MOST_VALUES // max(1, len(shared.steps)))
        for b in batches:
            for lo in range(0, len(b), most):
                part = b.slice(lo, most)
                x = {v: part.column(k).to_numpy() for k, v in enumerate(variables)}
                total += shared.losses(x, part.column(len(variables)).to_numpy(), delta)
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), *[pa.array(total[:, k]) for k in range(3)]], ["tree", "n", "huber", "sse"])

    sums = rows.select(*variables, y).mapInArrow(run, "tree string, n double, huber double, sse double").groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n", "huber", "sse")])
    return sums.filter("n > 0").select("tree", (F.col("huber") / F.col("n")).alias("huber"), (F.col("sse") / F.col("n")).alias("mse"))


def loss_of(huber: float, mse: float, size: int, c: Config) -> float:
    return math.inf if size > c.most_complex or not math.isfinite(mse) else huber + (0 if mse < 1e-12 else c.parsimony * size)


def bred(trees: list[Node], x: dict[str, np.ndarray], y: np.ndarray, breeder: Breeder, c: Config, generations: int) -> list[Node]:
    """The population after some generations on the given rows, the best first, a few of them polished."""

    def ranked(pop: list[Node]) -> list[tuple[tuple[float, float], Node]]:
        sums = Shared(pop).losses(x, y, c.delta)
        scores = [(loss_of(h / n, s / n, ast.size(t), c), s / n) if n else (math.inf, math.inf) for t, (n, h, s) in zip(pop, sums.tolist(), strict=True)]
        order = sorted(range(len(pop)), key=lambda k: (scores[k][0], ast.size(pop[k]), k))
        return [(scores[k], pop[k]) for k in order]

    own = ranked(trees)
    for _ in range(generations):
        if own[0][0][1] < c.stop:
            break
        entry = [((loss if c.lexicographic is None else mse), ast.size(t)) for (loss, mse), t in own]

        def chosen(own=own, entry=entry) -> Node:
            at = breeder.rng.integers(0, len(own), c.tournament)
            return own[int(at[winner([entry[i] for i in at], c.lexicographic)])][1]

        new = [t for _, t in own[: c.elite]]
        while len(new) < c.population:
            a, r = chosen(), breeder.rng.random()
            new.append(breeder.cross(a, chosen()) if r < c.crossover else breeder.mutate(a) if r < c.crossover + max(c.mutation, 0.2) else a)
        own = ranked(new)
    out = [t for _, t in own]
    sizes: set[int] = set()
    for k, t in enumerate(out[: 4 * c.elite]):
        if ast.size(t) not in sizes and len(sizes) < c.elite:
            sizes.add(ast.size(t))
            out.append(polish(t, x, y, breeder))
    return out


def drawn(rows: DataFrame, n: int, c: Config, epoch: int) -> DataFrame:
    """Rows for each island: all but the unseen share of a small table, else about ``sample`` of its own."""
    if n <= c.sample:
        kept = rows.filter(F.rand(c.seed) >= c.validation) if n >= 20 and c.validation else rows
        return kept.withColumn("__island", F.explode(F.array(*[F.lit(k) for k in range(c.islands)])))
    own = rows.filter(F.rand(c.seed + 2 * epoch) < min(1.0, c.islands * c.sample / n))
    return own.withColumn("__island", F.floor(F.rand(c.seed + 2 * epoch + 1) * c.islands).cast("int"))


def evolve(rows: DataFrame, variables: list[str], y: str, c: Config) -> tuple[list[tuple[Node, float]], int]:
    """One search over finite rows: its front as (tree, mse on all rows), and how many generations were made."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/islands-{uuid.uuid4().hex}"
    names = [*variables, y]
    n = rows.count()
    if not n:
        return [], 0

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def breeding(epoch: int, generations: int):
        def breed(key, trees: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            breeder = Breeder(variables, c)
            breeder.rng = np.random.default_rng([c.seed, island, epoch])
            now = [decode(t) for t in trees.sort_values("id")["tree"] if t] or breeder.initial()
            x = {v: own[v].to_numpy(float) for v in variables}
            # the order of rows is the shuffle's: sorted, so that sums are alike each time
            order = np.lexsort([own[v].to_numpy(float) for v in names]) if len(own) else np.zeros(0, int)
            after = bred(now, {v: a[order] for v, a in x.items()}, own[y].to_numpy(float)[order], breeder, c, generations) if len(own) else now
            return pd.DataFrame({"island": island, "id": range(len(after)), "tree": [encode(t) for t in after], "size": [ast.size(t) for t in after]})

        return breed

    front: dict[int, tuple[Node, float]] = {}
    start, best, made, stale, epoch = time.monotonic(), math.inf, 0, 0, 0
    population = spark.range(c.islands).select(F.col("id").cast("int").alias("island"), F.lit(0).alias("id"), F.lit("").alias("tree"), F.lit(0).alias("size"))
    while made < c.generations:
        generations = min(c.migration_every, c.generations - made)

        rows_by = drawn(rows, n, c, epoch).groupBy("__island")
        after = written(population.groupBy("island").cogroup(rows_by).applyInPandas(breeding(epoch, generations), TABLE), f"bred-{epoch}")
        made += generations
        # all trees of all islands over all rows: as many as the islands hold, whatever the table's size
        trees = sorted({r.tree for r in after.filter(F.col("size") <= c.most_complex).select("tree").distinct().collect()})
        losses = written(scored(rows, variables, y, trees, c.delta), f"scored-{epoch}")
        top = after.join(losses, "tree").groupBy("size").agg(F.min(F.struct("mse", "tree")).alias("b")).select("size", "b.*").collect()
        for r in top:
            if math.isfinite(r.mse) and (r.size not in front or r.mse < front[r.size][1]):
                front[r.size] = (decode(r.tree), r.mse)
        now = min((v for _, v in front.values()), default=math.inf)
        stale = 0 if now < best * 0.99 else stale + generations
        best = min(best, now)
        if best < c.stop or stale >= max(c.patience, c.migration_every) or time.monotonic() - start > c.seconds:
            break
        # the best move one island on, and take the place of the worst
        move = max(1, int(c.population * c.migration_share))
        loss = F.when(F.col("mse") < 1e-12, F.col("huber")).otherwise(F.col("huber") + c.parsimony * F.col("size"))
        place = F.row_number().over(Window.partitionBy("island").orderBy(F.col("loss").asc_nulls_last(), "size", "id"))
        ranks = after.join(losses, "tree", "left").withColumn("loss", loss).withColumn("place", place)
        stay = ranks.filter(F.col("place") <= c.population - move).select("island", F.col("place").alias("id"), "tree", "size")
        moved = ranks.filter(F.col("place") <= move).select(F.pmod(F.col("island") + 1, F.lit(c.islands)).alias("island"), (F.col("place") + c.population).alias("id"), "tree", "size")
        population = written(stay.unionByName(moved), f"moved-{epoch}")
        epoch += 1
    kept, low = [], math.inf
    for size in sorted(front):
        if front[size][1] < low:
            low = front[size][1]
            kept.append(front[size])
    return kept, made
