"""Causal skeletons and effects: correlations from one covariance pass, the search on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_cdf
from .gram import gram, solve
from .quantile import percentiles


def correlations(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, float]:
    g = gram(df, cols[:-1], cols[-1])
    sd = np.sqrt(np.maximum(np.diag(g.product), 1e-300))
    return g.product / np.outer(sd, sd), g.n


def partial_correlation(corr: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """From the inverse of the sub-matrix of the two and the given ones."""
    at = [i, j, *given]
    p = np.linalg.pinv(corr[np.ix_(at, at)])
    return float(-p[0, 1] / math.sqrt(max(p[0, 0] * p[1, 1], 1e-300)))


def fisher_z(r: float, n: float, k: int) -> float:
    """Two-sided p-value that a (partial) correlation is zero."""
    r = min(max(r, -1 + 1e-15), 1 - 1e-15)
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - k - 3, 1))
    return 2 * (1 - normal_cdf(abs(z)))


def quantile_edges(df: DataFrame, cols: list[str], bins: int = 5) -> dict[str, list[float]]:
    """The inner edges of equally full bins, of all columns in one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), F.col(c).cast("double").alias("__x")) for k, c in enumerate(cols)])).alias("e")
    found = {r["__k"]: r["__q"] for r in percentiles(df.select(each).select("e.*"), F.col("__x"), [k / bins for k in range(1, bins)], ["__k"]).collect()}
    return {c: found.get(k) or [] for k, c in enumerate(cols)}


def cube(df: DataFrame, cols: list[str], bins: int = 5) -> DataFrame:
    """Counts (o) of every combination of the columns' bins (b_<column>): one pass, from which any test between them follows."""
    edges = quantile_edges(df, cols, bins)
    below = lambda c: sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges[c]), F.lit(0))
    return df.select(*[below(c).alias(f"b_{c}") for c in cols]).groupBy(*[f"b_{c}" for c in cols]).agg(F.count("*").alias("o"))


def g_tests(cells: DataFrame, tests: list[tuple[str, str, tuple[str, ...]]], bins: int = 5, least: int = 10) -> DataFrame:
    """test (its place in the list), g2 and dof of many independence tests, in one pass over a cube's cells.

    A test's G2 is summed over the strata of its given columns' bins, those of ``least`` rows or more.
    """
    stratum = lambda given: sum((F.col(f"b_{c}").cast("long") * bins**k for k, c in enumerate(given)), F.lit(0).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("test"), F.col(f"b_{a}").alias("i"), F.col(f"b_{b}").alias("j"), stratum(given).alias("z")) for k, (a, b, given) in enumerate(tests)])).alias("c")
    counts = cells.select("o", each).groupBy("c.test", "c.i", "c.j", "c.z").agg(F.sum("o").alias("o"))
    total = lambda *by: F.sum("o").over(Window.partitionBy("test", "z", *by))
    own = counts.select("test", "z", "o", (total("i") * total("j") / total()).alias("e"), total().alias("n")).filter(F.col("n") >= least)
    return own.groupBy("test").agg((2 * F.sum(F.col("o") * F.ln(F.col("o") / F.col("e")))).alias("g2"), ((bins - 1) ** 2 * F.count_distinct("z")).cast("int").alias("dof"))


def g_squared(df: DataFrame, a: str, b: str, given: list[str] | None = None, bins: int = 5, least: int = 10) -> DataFrame:
    """G2 statistic and degrees of freedom over quantile bins, summed over strata of the given columns' bins."""
    given = tuple(given or ())
    found = g_tests(cube(df, [a, b, *given], bins), [(a, b, given)], bins, least)
    return found.agg(F.sum("g2").alias("g2"), F.coalesce(F.sum("dof"), F.lit((bins - 1) ** 2)).cast("int").alias("dof"))


def g_test(df: DataFrame, a: str, b: str, given: list[str] | None = None, bins: int = 5) -> float:
    r = g_squared(df, a, b, given, bins).first()
    return chi2_sf(r.g2 or 0.0, r.dof)


@dataclass
class Graph:
    nodes: list[str]
    directed: set[tuple[str, str]] = field(default_factory=set)
    undirected: set[tuple[str, str]] = field(default_factory=set)

    def frame(self, spark) -> DataFrame:
        rows = [(a, b, True) for a, b in sorted(self.directed)] + [(a, b, False) for a, b in sorted(self.undirected)]
        return spark.createDataFrame(rows, "src string, dst string, directed boolean")


def _fisher_split(df: DataFrame, cols: list[str], alpha: float) -> tuple[dict[int, set[int]], dict[frozenset[int], tuple[int, ...]]]:
    corr, n = correlations(df, cols)
    near = {i: {j for j in range(len(cols)) if j != i} for i in range(len(cols))}
    split: dict[frozenset[int], tuple[int, ...]] = {}
    for k in range(len(cols) - 1):
        if all(len(v) - 1 < k for v in near.values()):
            break
        for i in range(len(cols)):
            for j in sorted(near[i]):
                if i < j:
                    for given in [*combinations(sorted(near[i] - {j}), k), *combinations(sorted(near[j] - {i}), k)]:
                        if fisher_z(partial_correlation(corr, i, j, given), n, k) > alpha:
                            near[i].discard(j)
                            near[j].discard(i)
                            split[frozenset((i, j))] = given
                            break
    return near, split


def _cube_split(df: DataFrame, cols: list[str], alpha: float, bins: int) -> tuple[dict[int, set[int]], dict[frozenset[int], tuple[int, ...]]]:
    """The skeleton by G2 tests: the table is counted once, and each size of conditioning sets is one pass over the counts.

    All tests of a size go by the neighbours before it, so their order doesn't matter.
    """
    cells = cube(df, cols, bins).cache()
    near = {i: {j for j in range(len(cols)) if j != i} for i in range(len(cols))}
    split: dict[frozenset[int], tuple[int, ...]] = {}
    try:
        for k in range(len(cols) - 1):
            tests = [(i, j, given) for i in near for j in sorted(near[i]) if i < j for given in dict.fromkeys([*combinations(sorted(near[i] - {j}), k), *combinations(sorted(near[j] - {i}), k)])]
            if not tests:
                break
            found = {r.test: chi2_sf(r.g2, r.dof) for lo in range(0, len(tests), 200) for r in g_tests(cells, [(cols[i], cols[j], tuple(cols[g] for g in given)) for i, j, given in tests[lo : lo + 200]], bins).withColumn("test", F.col("test") + lo).collect()}
            for t, (i, j, given) in enumerate(tests):
                if found.get(t, 1.0) > alpha and frozenset((i, j)) not in split:
                    split[frozenset((i, j))] = given
            for pair in split:
                i, j = sorted(pair)
                near[i].discard(j)
                near[j].discard(i)
    finally:
        cells.unpersist()
    return near, split


def pc(df: DataFrame, cols: list[str], alpha: float = 0.05, test: str = "fisher", bins: int = 5) -> Graph:
    """The PC algorithm: skeleton by conditional independence, v-structures, then propagation without new ones or cycles.

    ``test``: "fisher" (partial correlations, for what is linear) or "g2" (counts in bins, for any dependence).
    """
    near, split = _fisher_split(df, cols, alpha) if test == "fisher" else _cube_split(df, cols, alpha, bins)
    arrows: set[tuple[int, int]] = set()
    for m in range(len(cols)):
        for i, j in combinations(sorted(near[m]), 2):
            if j not in near[i] and m not in split.get(frozenset((i, j)), ()):
                arrows |= {(i, m), (j, m)}
    free = {(i, j) for i in near for j in near[i] if i < j and (i, j) not in arrows and (j, i) not in arrows}

    def reaches(a: int, b: int) -> bool:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += [q for p, q in arrows if p == x]
        return False

    changed = True
    while changed:
        changed = False
        for i, j in sorted(free):
            for a, b in ((i, j), (j, i)):
                if (i, j) in free and any(q == a and p not in near[b] for p, q in arrows) and not reaches(b, a):
                    arrows.add((a, b))
                    free.discard((i, j))
                    changed = True
    name = lambda e: (cols[e[0]], cols[e[1]])
    both = {e for e in arrows if (e[1], e[0]) in arrows}
    return Graph(list(cols), {name(e) for e in arrows - both}, {name(e) for e in free} | {name(e) for e in both if e[0] < e[1]})


def effect(df: DataFrame, graph: Graph, treatment: str, outcome: str) -> float:
    """Back-door estimate: least squares on the treatment and its parents."""
    parents = sorted(a for a, b in graph.directed if b == treatment and a != outcome)
    return solve(gram(df, [treatment, *parents], outcome)).coefficients[treatment]
