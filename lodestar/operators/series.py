"""Order-dependent operators over windows: derivatives, crossings, differences, edges, recurrences.

Every function takes the series' key columns and an order with a tie-break, so that one job
serves many series; operators of one order share one Window, hence one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def order(keys: list[str], *by: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def _step(t: str, keys: list[str]) -> Column:
    """Mean step of a series."""
    all_ = Window.partitionBy(*keys)
    return F.try_divide(F.max(t).over(all_) - F.min(t).over(all_), F.count(t).over(all_) - 1)


def finite_difference(df: DataFrame, t: str, x: str, keys: list[str], tie: str, accuracy: int = 2) -> DataFrame:
    """Adds dx: central differences (of order 2 or 4), one-sided at the ends, by the mean step."""
    w, h = order(keys, t, tie), _step(t, keys)
    v = F.col(x)
    nxt, prv = F.lead(x).over(w), F.lag(x).over(w)
    two = F.try_divide(nxt - prv, 2 * h)
    out = F.coalesce(two, F.try_divide(nxt - v, h), F.try_divide(v - prv, h))
    if accuracy == 4:
        four = F.try_divide(-F.lead(x, 2).over(w) + 8 * nxt - 8 * prv + F.lag(x, 2).over(w), 12 * h)
        out = F.coalesce(four, out)
    return df.withColumn("dx", out)


def second_difference(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Adds d2x inside; the ends copy their neighbour."""
    w, h = order(keys, t, tie), _step(t, keys)
    own = df.withColumn("__d2", F.try_divide(F.lead(x).over(w) - 2 * F.col(x) + F.lag(x).over(w), h * h))
    return own.withColumn("d2x", F.coalesce("__d2", F.lead("__d2").over(w), F.lag("__d2").over(w))).drop("__d2")


def savgol_derivative(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Adds dx: window 5, cubic. Inside, taps (1, -8, 0, 8, -1) / 12h; the ends from the cubic of the end windows."""
    w, h = order(keys, t, tie), _step(t, keys)
    at = lambda k: F.lead(x, k).over(w) if k >= 0 else F.lag(x, -k).over(w)
    inside = (at(-2) - 8 * at(-1) + 8 * at(1) - at(2)) / 12
    grid = np.arange(-2.0, 3.0)
    fit = np.linalg.pinv(np.vander(grid, 4, increasing=True))
    slope = lambda z: fit[1] + 2 * z * fit[2] + 3 * z * z * fit[3]
    taps = lambda z, first: sum((float(c) * at(first + k) for k, c in enumerate(slope(z))), F.lit(0.0))
    ends = [taps(-2.0, 0), taps(-1.0, -1), taps(1.0, -3), taps(2.0, -4)]
    return df.withColumn("dx", F.try_divide(F.coalesce(inside, *ends), h))


def _per_series(df: DataFrame, t: str, x: str, keys: list[str], tie: str, fn) -> DataFrame:
    """Global transforms of a series need all of it: one pandas call for each key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, tie], kind="stable")
        ts, xs = pdf[t].to_numpy(float), pdf[x].to_numpy(float)
        h = (ts[-1] - ts[0]) / (len(ts) - 1) if len(ts) > 1 else np.nan
        return pdf.assign(dx=fn(xs, h) if len(ts) > 1 and h else np.full(len(ts), np.nan))

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.groupBy(*keys).applyInPandas(run, StructType([*df.schema.fields, StructField("dx", DoubleType())]))


def spectral_derivative(df: DataFrame, t: str, x: str, keys: list[str], tie: str, order_: int = 1) -> DataFrame:
    return _per_series(df, t, x, keys, tie, lambda v, h: np.real(np.fft.ifft(np.fft.fft(v) * (2j * np.pi * np.fft.fftfreq(len(v), h)) ** order_)))


def tv_derivative(df: DataFrame, t: str, x: str, keys: list[str], tie: str, alpha: float = 0.01, rounds: int = 100) -> DataFrame:
    """Total-variation regularised derivative by proximal gradient steps."""

    def fn(v: np.ndarray, h: float) -> np.ndarray:
        n = len(v)
        u = np.gradient(v, h)
        base = v - v[0]
        rate = 1.0 / (h * h * n * n)
        for _ in range(rounds):
            residual = np.cumsum(u) * h - base
            g = np.cumsum(residual[::-1])[::-1] * h
            new = u - rate * g
            d = np.diff(new)
            d = np.sign(d) * np.maximum(np.abs(d) - alpha * rate, 0)
            new = np.concatenate([[new[0]], new[0] + np.cumsum(d)])
            if np.max(np.abs(new - u)) < 1e-10:
                return new
            u = new
        return u

    return _per_series(df, t, x, keys, tie, fn)


def derivative(df: DataFrame, t: str, x: str, keys: list[str], tie: str, method: str = "savgol") -> DataFrame:
    return {"finite": finite_difference, "savgol": savgol_derivative, "spectral": spectral_derivative, "tv": tv_derivative}[method](df, t, x, keys, tie)


def even_spacing(df: DataFrame, t: str, keys: list[str], tie: str) -> DataFrame:
    """Per series: mean step, greatest relative deviation, and whether that is within 1e-6."""
    w = order(keys, t, tie)
    gaps = df.withColumn("__g", F.col(t) - F.lag(t).over(w)).filter("__g is not null")
    mean = gaps.groupBy(*keys).agg(F.avg("__g").alias("mean_step"), F.min("__g").alias("__lo"), F.max("__g").alias("__hi"))
    off = F.try_divide(F.greatest(F.col("__hi") - F.col("mean_step"), F.col("mean_step") - F.col("__lo")), F.abs(F.col("mean_step")))
    return mean.select(*keys, "mean_step", off.alias("deviation"), F.coalesce(off <= 1e-6, F.lit(False)).alias("even"))


def zero_crossings(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Per series, of x less its linear trend: sign changes, and the median gap between them."""
    trend = df.groupBy(*keys).agg(F.regr_slope(F.col(x), F.col(t)).alias("__s"), F.regr_intercept(F.col(x), F.col(t)).alias("__i"))
    w = order(keys, t, tie)
    flat = df.join(trend, keys).withColumn("__r", F.col(x) - F.coalesce("__s", F.lit(0.0)) * F.col(t) - F.coalesce("__i", F.lit(0.0)))
    flips = flat.withColumn("__f", F.signum("__r") * F.signum(F.lag("__r").over(w)) < 0).filter("__f")
    gaps = flips.withColumn("__g", F.col(t) - F.lag(t).over(w))
    return gaps.groupBy(*keys).agg(F.count("*").alias("crossings"), F.percentile("__g", 0.5).alias("median_gap"))


def local_slopes(df: DataFrame, x: str, y: str, keys: list[str], tie: str) -> DataFrame:
    """Log-log slopes between neighbours, rounded to halves, and how often each occurs (power-law exponents)."""
    pos = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, tie, F.ln(x).alias("__lx"), F.ln(y).alias("__ly"))
    w = order(keys, "__lx", tie)
    s = F.try_divide(F.col("__ly") - F.lag("__ly").over(w), F.col("__lx") - F.lag("__lx").over(w))
    return pos.withColumn("s", s).filter("s is not null").groupBy((F.floor(F.col("s") * 2 + 0.5) / 2).alias("exponent")).agg(F.count("*").alias("n"))


def curvature(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Per series: mean and deviation of d2x, of d2x / dx (exponential) and of x-weighted d2x (logarithmic)."""
    w = order(keys, t, tie)
    d1 = (F.lead(x).over(w) - F.lag(x).over(w)) / 2
    d2 = F.lead(x).over(w) - 2 * F.col(x) + F.lag(x).over(w)
    own = df.select(*keys, d2.alias("d2"), F.try_divide(d2, d1).alias("ratio")).filter("d2 is not null")
    return own.groupBy(*keys).agg(F.avg("d2").alias("d2_mean"), F.stddev_pop("d2").alias("d2_std"), F.avg("ratio").alias("ratio_mean"))


def saturation(df: DataFrame, t: str, x: str, keys: list[str], tie: str) -> DataFrame:
    """Per series: share of the variance in the first and last third, and whether x never falls."""
    w = order(keys, t, tie)
    n = F.count("*").over(Window.partitionBy(*keys))
    own = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", n).withColumn("__d", F.col(x) - F.lag(x).over(w))
    third = F.floor(F.col("__n") / 3)
    first, last = F.when(F.col("__k") < third, F.col(x)), F.when(F.col("__k") >= F.col("__n") - third, F.col(x))
    total = F.var_pop(x)
    return own.groupBy(*keys).agg(F.try_divide(F.var_pop(first), total).alias("first_share"), F.try_divide(F.var_pop(last), total).alias("last_share"), F.coalesce(F.min("__d") >= 0, F.lit(True)).alias("monotone"))


def newton_differences(df: DataFrame, t: str, x: str, keys: list[str], tie: str, levels: int = 4) -> DataFrame:
    """Per series: the leading forward differences d0 to d<levels>, and the greatest size of the last."""
    w = order(keys, t, tie)
    own = df.withColumn("d0", F.col(x)).withColumn("__k", F.row_number().over(w))
    for k in range(1, levels + 1):
        own = own.withColumn(f"d{k}", F.lead(f"d{k - 1}").over(w) - F.col(f"d{k - 1}"))
    head = F.col("__k") == 1
    return own.groupBy(*keys).agg(*[F.max(F.when(head, F.col(f"d{k}"))).alias(f"d{k}") for k in range(levels + 1)], F.max(F.abs(F.col(f"d{levels}"))).alias("last_size"))


def pulse_edges(df: DataFrame, t: str, x: str, keys: list[str], tie: str, jump: float = 0.5) -> DataFrame:
    """Per series: number of jumps, and the midpoints of the first and the last."""
    w = order(keys, t, tie)
    own = df.withColumn("__j", F.abs(F.col(x) - F.lag(x).over(w)) > jump).withColumn("__m", (F.col(t) + F.lag(t).over(w)) / 2).filter("__j")
    return own.groupBy(*keys).agg(F.count("*").alias("edges"), F.min("__m").alias("first_edge"), F.max("__m").alias("last_edge"))


def clamp_runs(df: DataFrame, t: str, x: str, keys: list[str], tie: str, tolerance: float = 1e-6) -> DataFrame:
    """Per series: lengths of the equal runs at its head and tail."""
    w = order(keys, t, tie)
    ends = df.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = ends.withColumn("__h", F.abs(F.col(x) - F.first(x).over(full)) > tolerance).withColumn("__t", F.abs(F.col(x) - F.last(x).over(full)) > tolerance)
    return own.groupBy(*keys).agg((F.coalesce(F.min(F.when(F.col("__h"), F.col("__k"))) - 1, F.max("__n"))).alias("head_run"), (F.max("__n") - F.coalesce(F.max(F.when(F.col("__t"), F.col("__k"))), F.lit(0))).alias("tail_run"))


def cusps(df: DataFrame, t: str, x: str, keys: list[str], tie: str, low: float = 0.01) -> DataFrame:
    """Rows that are near zero between neighbours that are not."""
    w = order(keys, t, tie)
    return df.withColumn("__p", F.lag(x).over(w)).withColumn("__n", F.lead(x).over(w)).filter((F.abs(F.col(x)) < low) & (F.abs(F.col("__p")) > low) & (F.abs(F.col("__n")) > low)).drop("__p", "__n")


def near_poles(df: DataFrame, t: str, x: str, keys: list[str], tie: str, ratio: float = 10.0, size: float = 10.0) -> DataFrame:
    """Midpoints between neighbours whose sizes differ by over ``ratio`` times and reach ``size``."""
    w = order(keys, t, tie)
    a, b = F.abs(F.col(x)), F.abs(F.lead(x).over(w))
    r = F.try_divide(b, a)
    out = df.select(*keys, ((F.col(t) + F.lead(t).over(w)) / 2).alias("pole"), r.alias("ratio"), F.greatest(a, b).alias("peak"))
    return out.filter(((F.col("ratio") > ratio) | (F.col("ratio") < 1 / ratio)) & (F.col("peak") > size))


def k_bonacci(df: DataFrame, n: str, x: str, keys: list[str], k: int, tolerance: float = 0.01) -> DataFrame:
    """Per series: how many terms were checked against the sum of the k before, and how many hold."""
    w = order(keys, n)
    total = sum((F.lag(x, j).over(w) for j in range(1, k + 1)), F.lit(0.0))
    dense = F.col(n) - F.lag(n, k).over(w) == k
    own = df.withColumn("__s", F.when(dense, total)).filter("__s is not null")
    return own.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(F.abs(F.col(x) - F.col("__s")) <= tolerance).alias("held"))


def prime_steps(df: DataFrame, n: str, x: str, keys: list[str]) -> DataFrame:
    """Per series of x over integers: shares of primes where x rises by one, and of composites where it stays."""
    from .match import is_prime

    w = order(keys, n)
    own = df.withColumn("__d", F.col(x) - F.lag(x).over(w)).withColumn("__p", is_prime(F.col(n))).filter("__d is not null")
    return own.groupBy(*keys).agg(F.avg(F.when(F.col("__p"), (F.col("__d") == 1).cast("double"))).alias("rises"), F.avg(F.when(~F.col("__p"), (F.col("__d") == 0).cast("double"))).alias("stays"))


def tournament(df: DataFrame, keys: list[str], fitness: str, size: str, tie: str, top: int = 1) -> DataFrame:
    """The best of each group: least fitness to 1e-6, then least size, then the tie column."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(fitness), 6), size, tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def rk4(rhs, x0: np.ndarray, t: np.ndarray) -> Iterator[np.ndarray]:
    """Classical Runge-Kutta states at t."""
    x = np.asarray(x0, float)
    yield x
    for a, b in zip(t[:-1], t[1:], strict=True):
        h = b - a
        k1 = rhs(x)
        k2 = rhs(x + h / 2 * k1)
        k3 = rhs(x + h / 2 * k2)
        k4 = rhs(x + h * k3)
        x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        yield x
