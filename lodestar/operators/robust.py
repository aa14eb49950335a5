"""Robust regression and uncertainty: reweighting, consensus, resampling, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_ppf, t_sf2
from .gram import Fit, Gram, gram, solve
from .quantile import median, percentiles


def predicted(fit: Fit) -> Column:
    out = F.lit(fit.intercept)
    for k, v in fit.coefficients.items():
        out = out + F.lit(v) * F.col(f"`{k}`")
    return out


def irls(df: DataFrame, names: list[str], y: str, loss: str = "huber", rounds: int = 50, tolerance: float = 1e-6) -> Fit:
    """Iteratively reweighted least squares: a median and a weighted Gram matrix a round.

    huber (1.345), tukey (4.685) or cauchy (2.385), by residuals over MAD / 0.6745.
    """
    fit = solve(gram(df, names, y))
    for _ in range(rounds):
        r = F.col(y) - predicted(fit)
        scale = (median(df, F.abs(r - F.lit(median(df, r)))) or 0.0) / 0.6745
        if scale < 1e-12:
            break
        u = F.abs(r) / F.lit(scale)
        weight = {"huber": F.least(F.lit(1.0), 1.345 / F.greatest(u, F.lit(1e-12))), "tukey": F.when(u < 4.685, F.pow(1 - F.pow(u / 4.685, 2), 2)).otherwise(0.0), "cauchy": 1 / (1 + F.pow(u / 2.385, 2))}[loss]
        new = solve(gram(df.withColumn("__w", F.greatest(F.least(weight, F.lit(1.0)), F.lit(1e-6))), names, y, "__w"))
        change = max([abs(new.coefficients[k] - v) for k, v in fit.coefficients.items()] + [abs(new.intercept - fit.intercept)])
        fit = new
        if change < tolerance:
            break
    return fit


def irls_weights(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """One reweighting step within keys: residual scale and mean Huber weight."""
    r = F.col(y) - F.col(p)
    med = percentiles(df, r, [0.5], keys).withColumn("__m", F.col("__q")[0]).drop("__q")
    dev = df.join(med, keys).withColumn("__r", r).withColumn("__d", F.abs(r - F.col("__m")))
    scale = percentiles(dev, F.col("__d"), [0.5], keys).withColumn("scale", F.col("__q")[0] / 0.6745).drop("__q")
    own = dev.join(scale, keys).filter("scale > 0")
    w = F.least(F.lit(1.0), F.try_divide(F.lit(1.345) * F.col("scale"), F.abs("__r")))
    return own.groupBy(*keys).agg(F.max("scale").alias("scale"), F.avg(F.coalesce(w, F.lit(1.0))).alias("mean_weight"))


#: Rows of the sample that hypotheses are drawn from; hypotheses at most; chance that a dropped one was the best.
SAMPLE, MOST_TRIALS, DOUBT = 2000, 2000, 1e-6


def _margin(n: float, models: int) -> float:
    """Hoeffding's bound on how far the shares of ``models`` hypotheses over n rows are off."""
    return (np.log(2 * max(models, 1) / DOUBT) / (2 * max(n, 1))) ** 0.5


def ransac(df: DataFrame, names: list[str], y: str, row_id: str, trials: int = 100, seed: int = 7) -> tuple[Fit, float]:
    """Consensus of fits on small hashed samples, refitted on its inliers; and the share of rows within the threshold.

    At least ``trials`` hypotheses are drawn, and more until one without outliers is all but sure, given the share of
    inliers seen so far. They are scored on growing blocks of rows - the sample, a hundredth, a tenth, all - and those go
    on that may still be the best by the bounds of their shares. The threshold is three times the median residual of the
    plain fit, or of the best hypothesis on the sample where that is less.
    """
    base = solve(gram(df, names, y))
    plain = 3 * (median(df, F.abs(F.col(y) - predicted(base))) or 0.0)
    need = len(names) + 1
    n = df.count()
    place = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1_000_000))
    sample = df.filter(place < min(1.0, 40 * need / max(n, 1) + 0.05) * 1_000_000).orderBy(F.xxhash64(row_id, F.lit(seed))).limit(SAMPLE).select(*names, y).collect()
    rng = np.random.default_rng(seed)
    rows = np.array([[float(v) for v in r] for r in sample]).reshape(-1, need)
    x = np.c_[rows[:, :-1], np.ones(len(rows))]
    betas = [np.array([*base.coefficients.values(), base.intercept])]
    limit, wanted = plain, trials if len(rows) >= need else 0
    floor = 1e-9 * float(np.abs(rows[:, -1]).max(initial=0.0))
    while len(betas) <= min(wanted, MOST_TRIALS):
        for _ in range(min(100, max(1, wanted + 1 - len(betas)))):
            own = rng.choice(len(rows), need, replace=False)
            betas.append(np.linalg.lstsq(x[own], rows[own, -1], rcond=None)[0])
        off = np.abs(rows[:, -1] - np.array(betas) @ x.T)
        limit = max(floor, min(plain, 3 * float(np.median(off, axis=1).min())))
        share = float((off <= limit).mean(axis=1).max())
        # so many that one drawn from inliers alone is missed once in ten thousand times
        sure = np.log(1e-4) / np.log(max(1e-12, 1 - min(share, 0.999999) ** need))
        wanted = max(trials, int(min(MOST_TRIALS, sure)))
    models = [Fit(dict(zip(names, beta[:-1].tolist(), strict=True)), float(beta[-1]), 0.0, 0.0, 0.0) for beta in betas]
    if len(rows):
        shares = (np.abs(rows[:, -1] - np.array(betas) @ x.T) <= limit).mean(axis=1)
        able = shares + 2 * _margin(len(rows), len(models)) >= shares.max()
        order = np.argsort(-shares, kind="stable")
        models = [models[k] for k in order if able[k]]
    for part in (10_000, 100_000, 1_000_000):
        if part < 1_000_000 and (len(models) <= 3 or n * part < 20_000 * 1_000_000):
            continue
        # columns of counts, so many that a plan stays small
        block = df if part == 1_000_000 else df.filter(place < part)
        counts: list[int] = []
        for lo in range(0, len(models), 200):
            some = models[lo : lo + 200]
            row = block.agg(F.count("*").alias("n"), *[F.count_if(F.abs(F.col(y) - predicted(m)) <= limit).alias(f"m{k}") for k, m in enumerate(some)]).first()
            counts += [row[f"m{k}"] for k in range(len(some))]
        most = max(counts)
        if part == 1_000_000:
            best, held = models[counts.index(most)], most
        else:
            slack = 2 * _margin(row["n"], len(models)) * row["n"]
            models = [m for m, c in zip(models, counts, strict=True) if c + slack >= most]
    inside = df.filter(F.abs(F.col(y) - predicted(best)) <= limit)
    return solve(gram(inside, names, y)), held / max(n, 1)


def auto(df: DataFrame, names: list[str], y: str, row_id: str) -> tuple[str, Fit]:
    """ransac, huber or ols, by the share of rows over 3.5 deviations from the plain fit."""
    base = solve(gram(df, names, y))
    r = F.abs(F.col(y) - predicted(base))
    mad = median(df, r) or 0.0
    share = df.agg(F.avg((r > 3.5 * mad / 0.6745).cast("double")).alias("s")).first().s or 0.0
    if share > 0.2:
        return "ransac", ransac(df, names, y, row_id)[0]
    return ("huber", irls(df, names, y)) if share > 0.05 else ("ols", base)


def _replicates(df: DataFrame, names: list[str], y: str, row_id: str, n: int, seed: int, sigma: str | None) -> list[Gram]:
    """Gram matrices of n replicates in one pass: Poisson(1) weights, or noise on y, from hashes of the row."""
    cols = [*names, y]
    own = df.select(*[F.col(c).cast("double") for c in cols], F.xxhash64(row_id, F.lit(seed)).alias("__h"), (F.col(sigma).cast("double") if sigma else F.lit(0.0)).alias("__s")).na.drop()
    m = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, m + 1, m + 1))
        for b in batches:
            x = np.stack([b.column(k).to_numpy() for k in range(m)] + [np.ones(len(b))], 1)
            h = b.column(m).to_numpy().view(np.uint64)
            for rep in range(n):
                salt = np.full(1, rep, np.uint64) * np.uint64(0xD1B54A32D192ED03)
                z = h * np.uint64(0x9E3779B97F4A7C15) + salt
                z ^= z >> np.uint64(31)
                z *= np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                u = (z >> np.uint64(11)).astype(float) / 2**53
                if sigma:
                    v = ((z * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)).astype(float) / 2**53
                    own_x = x.copy()
                    own_x[:, m - 1] += b.column(m + 1).to_numpy() * np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * v)
                    total[rep] += own_x.T @ own_x
                else:
                    w = np.searchsorted(np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040.0])), u).astype(float)
                    total[rep] += x.T @ (x * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["k", "v"])

    flat = np.zeros(n * (m + 1) ** 2)
    for r in own.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        flat[r.k] = r.v
    out = []
    for t in flat.reshape(n, m + 1, m + 1):
        c, s = t[-1, -1], t[-1, :-1]
        out.append(Gram(list(names), float(c), s / max(c, 1e-300), t[:-1, :-1] - np.outer(s, s) / max(c, 1e-300)))
    return out


def bootstrap(df: DataFrame, names: list[str], y: str, row_id: str, n: int = 1000, level: float = 0.95, seed: int = 7) -> dict[str, tuple[float, float, float]]:
    """(estimate, low, high) of each coefficient and the intercept."""
    fits = [solve(g) for g in _replicates(df, names, y, row_id, n, seed, None)]
    base = solve(gram(df, names, y))
    get = lambda f, k: f.intercept if k == "intercept" else f.coefficients[k]
    return {k: (get(base, k), *np.quantile([get(f, k) for f in fits], ((1 - level) / 2, (1 + level) / 2)).tolist()) for k in [*names, "intercept"]}


def monte_carlo(df: DataFrame, names: list[str], y: str, sigma: str, row_id: str, n: int = 200, seed: int = 7) -> dict[str, tuple[float, float]]:
    """(mean, deviation) of each coefficient under Gaussian noise of the rows' own sigma."""
    fits = [solve(g) for g in _replicates(df, names, y, row_id, n, seed, sigma)]
    return {k: (float(np.mean(v)), float(np.std(v))) for k in [*names, "intercept"] for v in [[f.intercept if k == "intercept" else f.coefficients[k] for f in fits]]}


def significance(g: Gram) -> dict[str, tuple[float, float, float]]:
    """(standard error, t, two-sided p) of each coefficient."""
    fit, k = solve(g), len(g.names) + 1
    dof = max(g.n - k, 1)
    inverse = np.linalg.pinv(g.xx + 1e-12 * np.eye(len(g.names)) * max(1.0, np.trace(g.xx)))
    se = np.sqrt(np.maximum(np.diag(inverse) * fit.mse * g.n / dof, 0))
    return {name: (float(s), t := (fit.coefficients[name] / s if s else float("inf")), t_sf2(t, dof) if s else 0.0) for name, s in zip(g.names, se, strict=True)}


def prediction_interval(df: DataFrame, g: Gram, level: float = 0.95) -> DataFrame:
    """Adds prediction, lower and upper, by leverage."""
    fit, k = solve(g), len(g.names) + 1
    dof = max(g.n - k, 1)
    t, s = t_ppf((1 + level) / 2, dof), (fit.mse * g.n / dof) ** 0.5
    inv = np.linalg.pinv(g.xx)
    d = [F.col(f"`{c}`") - float(g.mean[i]) for i, c in enumerate(g.names)]
    lever = F.lit(1 / g.n)
    for i in range(len(d)):
        for j in range(len(d)):
            lever = lever + float(inv[i, j]) * d[i] * d[j]
    half = F.lit(t * s) * F.sqrt(1 + F.greatest(lever, F.lit(0.0)))
    p = predicted(fit)
    return df.withColumns({"prediction": p, "lower": p - half, "upper": p + half})
