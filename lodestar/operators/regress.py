"""Model selection on sufficient statistics: none of these reads the rows again."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Fit, Gram, gram, solve


def ols_by_group(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.count("*").alias("n"))


def ols_two(df: DataFrame, a: str, b: str, y: str, keys: list[str]) -> DataFrame:
    """y = c0 + c1 a + c2 b within each key, by Cramer's rule on centred sums."""
    p, q, r = F.col(a), F.col(b), F.col(y)
    own = df.groupBy(*keys).agg(*[f(u, v).alias(n) for n, f, u, v in (("saa", F.covar_pop, p, p), ("sbb", F.covar_pop, q, q), ("sab", F.covar_pop, p, q), ("say", F.covar_pop, p, r), ("sby", F.covar_pop, q, r))], F.avg(p).alias("ma"), F.avg(q).alias("mb"), F.avg(r).alias("my"))
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    c1 = F.try_divide(F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab"), det)
    c2 = F.try_divide(F.col("sby") * F.col("saa") - F.col("say") * F.col("sab"), det)
    return own.select(*keys, c1.alias("c1"), c2.alias("c2"), (F.col("my") - c1 * F.col("ma") - c2 * F.col("mb")).alias("c0"))


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> Fit:
    """Powers of x by centred sums; names are x, x^2, ..."""
    names = [x if k == 1 else f"{x}^{k}" for k in range(1, degree + 1)]
    own = df.select(*[F.pow(F.col(x).cast("double"), F.lit(float(k))).alias(n) for k, n in enumerate(names, 1)], F.col(y).alias("__y"))
    return solve(gram(own, names, "__y"))


def best_polyfit(df: DataFrame, x: str, y: str, degrees: tuple[int, ...] = (5, 4, 3), least_r2: float = 0.9999, most: float = 1e6) -> Fit | None:
    """The highest degree of ``degrees`` whose lower ones don't fit alike: accepted by R2 and coefficient size."""
    best = None
    for d in degrees:
        f = polyfit(df, x, y, d)
        if f.r2 > least_r2 and max(map(abs, f.coefficients.values())) <= most:
            best = f
    return best


def log_linear(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = A exp(B x) and y = A x^B as one row: exp_a, exp_b, exp_r2, pow_a, pow_b, pow_r2."""
    ly = F.when(F.col(y) > 0, F.ln(y))
    lx = F.when(F.col(x) > 0, F.ln(x))
    cx = F.col(x)
    return df.agg(*[c.alias(n) for n, c in (("exp_a", F.exp(F.regr_intercept(ly, cx))), ("exp_b", F.regr_slope(ly, cx)), ("exp_r2", F.regr_r2(ly, cx)), ("pow_a", F.exp(F.regr_intercept(ly, lx))), ("pow_b", F.regr_slope(ly, lx)), ("pow_r2", F.regr_r2(ly, lx)))])


def information(fit: Fit, k: int, kind: str = "bic") -> float:
    if fit.mse <= 0:
        return -math.inf
    return fit.n * math.log(fit.mse) + (k * math.log(fit.n) if kind == "bic" else 2 * k)


def omp(g: Gram, most: int = 6, stop: float = 1e-10) -> Fit:
    """Orthogonal matching pursuit: the feature that the residual is most correlated with, refit, again."""
    chosen: list[str] = []
    fit = solve(g, [])
    scale = np.sqrt(np.maximum(np.diag(g.xx), 1e-300))
    while len(chosen) < min(most, len(g.names)):
        beta = np.array([fit.coefficients.get(k, 0.0) for k in g.names])
        r = np.abs(g.xy - g.xx @ beta) / scale
        r[[g.names.index(k) for k in chosen]] = -1
        k = int(r.argmax())
        if r[k] <= stop * max(1.0, math.sqrt(max(g.yy, 0))):
            break
        chosen.append(g.names[k])
        fit = solve(g, chosen)
        if fit.mse <= stop * max(1.0, g.yy / max(g.n, 1)):
            break
    return fit


def lasso(g: Gram, alpha: float, rounds: int = 1000, tolerance: float = 1e-10) -> Fit:
    """Coordinate descent on (1/2n)|y - Xb|^2 + alpha |b|_1, columns scaled to unit deviation."""
    sd = np.sqrt(np.maximum(np.diag(g.xx) / g.n, 1e-300))
    a, b = g.xx / g.n / np.outer(sd, sd), g.xy / g.n / sd
    beta = np.zeros(len(b))
    for _ in range(rounds):
        old = beta.copy()
        for j in range(len(b)):
            rho = b[j] - a[j] @ beta + a[j, j] * beta[j]
            beta[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / max(a[j, j], 1e-300)
        if np.abs(beta - old).max(initial=0) < tolerance:
            break
    own = beta / sd
    sse = max(0.0, g.yy - 2 * own @ g.xy + own @ g.xx @ own)
    return Fit(dict(zip(g.names, own.tolist(), strict=True)), float(g.mean[-1] - own @ g.mean[:-1]), sse / g.n, 1 - sse / g.yy if g.yy else 1.0, g.n)


def lasso_path(g: Gram, steps: int = 50, eps: float = 1e-4) -> list[tuple[float, Fit, float]]:
    """(alpha, refitted model, BIC) along the path from the alpha that zeroes all."""
    sd = np.sqrt(np.maximum(np.diag(g.xx) / g.n, 1e-300))
    top = float(np.abs(g.xy / g.n / sd).max(initial=0)) or 1.0
    out = []
    for alpha in np.geomspace(top, top * eps, steps):
        used = [k for k, v in lasso(g, float(alpha)).coefficients.items() if abs(v) > 1e-12]
        fit = solve(g, used)
        out.append((float(alpha), fit, information(fit, len(used) + 1)))
    return out


def best_subsets(g: Gram, top_two: int = 60, top_three: int = 25, accept: float = 0.05) -> Fit | None:
    """All subsets of one, two and three of the best-correlated features, by a size-penalised error."""
    scale = np.sqrt(np.maximum(np.diag(g.xx) * max(g.yy, 1e-300), 1e-300))
    ranked = [g.names[k] for k in np.argsort(-np.abs(g.xy) / scale, kind="stable")]
    best, score = None, math.inf
    for k, names in ((1, ranked), (2, ranked[:top_two]), (3, ranked[:top_three])):
        for own in combinations(names, k):
            fit = solve(g, list(own))
            if (s := fit.mse * (1 + 0.1 * (k - 1)) + 1e-15 * k * g.yy / max(g.n, 1)) < score:
                best, score = fit, s
    return best if best and g.yy and best.mse / (g.yy / g.n) < accept else None


def stlsq(g: Gram, threshold: float = 0.1, rounds: int = 10, prune: float = 0.1) -> Fit:
    """Sequentially thresholded least squares on columns of unit length, then small terms go."""
    names = list(g.names)
    norm = dict(zip(g.names, np.sqrt(np.diag(g.xx) + g.n * g.mean[:-1] ** 2), strict=True))
    fit = solve(g, names)
    for _ in range(rounds):
        keep = [k for k in names if abs(fit.coefficients[k]) * norm[k] >= threshold]
        if keep == names or not keep:
            names = keep
            break
        names, fit = keep, solve(g, keep)
    fit = solve(g, names)
    if names:
        most = max(abs(v) for v in fit.coefficients.values())
        fit = solve(g, [k for k in names if abs(fit.coefficients[k]) >= prune * most])
    return fit


def prune_refit(g: Gram, names: list[str], share: float = 0.01, rounds: int = 3) -> Fit:
    """Drops terms whose contribution is under a share of the greatest, and fits again."""
    fit = solve(g, names)
    for _ in range(rounds):
        size = {k: abs(v) * math.sqrt(max(g.part([k]).xx[0, 0], 0)) for k, v in fit.coefficients.items()}
        keep = [k for k in fit.coefficients if size[k] >= share * max(size.values())]
        if len(keep) == len(fit.coefficients):
            break
        fit = solve(g, keep)
    return fit


def templates(x: str, y: str) -> dict[str, Column]:
    """Aggregates of the hypothesis ladder in one variable, all in one job: what each template needs."""
    cx, cy = F.col(x), F.col(y)
    lx, ly = F.when(cx > 0, F.ln(cx)), F.when(cy > 0, F.ln(cy))
    return {
        "n": F.count("*"), "lo": F.min(cy), "hi": F.max(cy), "x_lo": F.min(cx), "x_hi": F.max(cx),
        "lin_a": F.regr_slope(cy, cx), "lin_b": F.regr_intercept(cy, cx), "lin_r2": F.regr_r2(cy, cx),
        "quad_a": F.regr_slope(cy, cx * cx), "quad_b": F.regr_intercept(cy, cx * cx), "quad_r2": F.regr_r2(cy, cx * cx),
        "pow_a": F.exp(F.regr_intercept(ly, lx)), "pow_b": F.regr_slope(ly, lx), "pow_r2": F.regr_r2(ly, lx), "pow_n": F.count(ly + lx),
        "exp_a": F.exp(F.regr_intercept(ly, cx)), "exp_b": F.regr_slope(ly, cx), "exp_r2": F.regr_r2(ly, cx), "exp_n": F.count(ly),
        "log_a": F.regr_slope(cy, lx), "log_b": F.regr_intercept(cy, lx), "log_r2": F.regr_r2(cy, lx), "log_n": F.count(lx),
    }
