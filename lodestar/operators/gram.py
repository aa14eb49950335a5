"""Sufficient statistics: every least-squares operator needs only X'X, X'y and y'y.

Up to ``SQL_FEATURES`` features they are sums in one SQL aggregate (by key, if wanted); more go by Arrow
batches, each task summing its own products, so that what leaves a task doesn't grow with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which sums of products go as SQL (measured: equal at 10, Arrow 6 times faster at 20).
SQL_FEATURES = 10


@dataclass
class Gram:
    """Of the columns and then y: n, sums of products about the means, and the means."""

    names: list[str]
    n: float
    mean: np.ndarray
    product: np.ndarray

    @property
    def xx(self) -> np.ndarray:
        return self.product[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.product[:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.product[-1, -1])

    def part(self, names: list[str]) -> Gram:
        at = [self.names.index(k) for k in names] + [len(self.names)]
        return Gram(list(names), self.n, self.mean[at], self.product[np.ix_(at, at)])


def gram(df: DataFrame, names: list[str], y: str, weight: str | None = None) -> Gram:
    """Statistics of double columns; rows with a null among them are left out."""
    cols = [*names, y]
    own = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).na.drop()
    m = len(cols)
    if m <= SQL_FEATURES + 1:
        # shifted by a first look at the means, which keeps the sums well-conditioned
        first = own.agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(m)]).first()
        shift = np.array([first[k] if first[k] is not None else 0.0 for k in range(m)])
        d = [F.col(f"c{k}") - float(shift[k]) for k in range(m)]
        w = F.col("w")
        aggs = [F.sum(w)] + [F.sum(w * x) for x in d] + [F.sum(w * d[i] * d[j]) for i in range(m) for j in range(i, m)]
        row = [x or 0.0 for x in own.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()]
        n, s = row[0], np.array(row[1 : m + 1])
        p = np.zeros((m, m))
        p[np.triu_indices(m)] = row[m + 1 :]
        p = p + np.triu(p, 1).T
    else:
        first = own.agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(m)]).first()
        shift = np.array([first[k] if first[k] is not None else 0.0 for k in range(m)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m + 1, m + 1))
            for b in batches:
                x = np.stack([b.column(k).to_numpy() for k in range(m)], 1) - shift
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                total += x.T @ (x * b.column(m).to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((m + 1) ** 2)), pa.array(total.reshape(-1))], ["k", "v"])

        total = np.zeros((m + 1) ** 2)
        for r in own.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            total[r.k] = r.v
        total = total.reshape(m + 1, m + 1)
        n, s, p = total[-1, -1], total[-1, :-1], total[:-1, :-1]
    if not n:
        return Gram(list(names), 0.0, np.zeros(m), np.zeros((m, m)))
    return Gram(list(names), float(n), s / n + shift, p - np.outer(s, s) / n)


@dataclass
class Fit:
    """y = intercept + sum of coefficient times feature."""

    coefficients: dict[str, float]
    intercept: float
    mse: float
    r2: float
    n: float

    def formula(self, digits: int = 10) -> str:
        terms = [f"{v:.{digits}g}*{k}" if k != "1" else f"{v:.{digits}g}" for k, v in self.coefficients.items() if v]
        if abs(self.intercept) > 1e-12 or not terms:
            terms.append(f"{self.intercept:.{digits}g}")
        return " + ".join(terms).replace("+ -", "- ")


def solve(g: Gram, names: list[str] | None = None, ridge: float = 0.0) -> Fit:
    """Least squares with an intercept from centred statistics; collinear features share by least norm."""
    own = g if names is None else g.part(names)
    scale = np.sqrt(np.maximum(np.diag(own.xx), 1e-300))
    a = own.xx / np.outer(scale, scale) + ridge * np.eye(len(scale))
    beta = np.linalg.lstsq(a, own.xy / scale, rcond=1e-12)[0] / scale if len(scale) else np.zeros(0)
    sse = max(0.0, own.yy - 2 * beta @ own.xy + beta @ own.xx @ beta)
    r2 = 1 - sse / own.yy if own.yy > 0 else float(sse == 0)
    return Fit(dict(zip(own.names, beta.tolist(), strict=True)), float(own.mean[-1] - beta @ own.mean[:-1]), sse / own.n if own.n else float("nan"), r2, own.n)
