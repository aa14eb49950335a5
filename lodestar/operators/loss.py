"""Losses and goodness of fit as aggregate columns; all generalise to ``groupBy``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import median


def mse(y: Column, p: Column, weight: Column | None = None) -> Column:
    e = (y - p) * (y - p)
    return F.avg(e) if weight is None else F.sum(weight * e) / F.sum(weight)


def huber(y: Column, p: Column, delta: float = 1.0) -> Column:
    e = F.abs(y - p)
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def r2(y: Column, p: Column) -> Column:
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), total)


def adjusted_r2(y: Column, p: Column, k: int) -> Column:
    n = F.count(y)
    return 1 - (1 - r2(y, p)) * F.try_divide(n - 1, n - k - 1)


def aic(y: Column, p: Column, k: int, perfect: float = float("-inf")) -> Column:
    """n ln(mse) + 2 k; ``perfect`` where the fit is exact."""
    m = mse(y, p)
    return F.when(m > 0, F.count(y) * F.ln(m) + 2 * k).otherwise(F.lit(perfect))


def bic(y: Column, p: Column, k: int, perfect: float = float("-inf")) -> Column:
    m = mse(y, p)
    return F.when(m > 0, F.count(y) * F.ln(m) + k * F.ln(F.count(y))).otherwise(F.lit(perfect))


def exact_fit(y: Column, p: Column) -> Column:
    """Is every row within 1e-10, or within 1e-8 of its size?"""
    e = F.abs(y - p)
    return F.bool_and((e < 1e-10) | (e < 1e-8 * F.abs(y)))


def max_residual(y: Column, p: Column) -> Column:
    return F.max(F.abs(y - p))


def relative_mse(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean of ((y - p) / (|y| + eps))^2 with eps from the median size."""
    eps = max((median(df, F.abs(F.col(y))) or 0.0) * 1e-10, 1e-100)
    e = (F.col(y) - F.col(p)) / (F.abs(F.col(y)) + F.lit(eps))
    return df.agg(F.avg(e * e).alias("relative_mse"))


def anchor_weights(df: DataFrame, x: str) -> DataFrame:
    """Adds weight: 5 for the rows nearest to the origin, 3 at integers, else 1."""
    nearest = F.broadcast(df.agg(F.min(F.abs(F.col(x))).alias("__near")))
    a = F.col(x)
    return df.crossJoin(nearest).withColumn("weight", F.when(F.abs(a) == F.col("__near"), 5.0).when(a == F.floor(a), 3.0).otherwise(1.0)).drop("__near")


def skew_ratio(df: DataFrame, y: str) -> DataFrame:
    a = F.abs(F.col(y))
    return df.agg((F.max(a) / F.lit(median(df, a))).alias("skew_ratio"), (F.max(y) - F.min(y)).alias("y_range"))


def slope_histogram(df: DataFrame, x: str, y: str, keys: list[str], tie: str, least: int = 2) -> DataFrame:
    """Local slopes rounded to halves and how often each occurs."""
    w = Window.partitionBy(*keys).orderBy(x, tie)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    steps = df.select(*keys, F.try_divide(dy, dx).alias("__slope")).filter(F.col("__slope").isNotNull())
    return steps.groupBy((F.floor(F.col("__slope") * 2 + 0.5) / 2).alias("slope")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def modal_gap(df: DataFrame, value: str, keys: list[str], digits: int = 3) -> DataFrame:
    """The most frequent gap between successive values of a key (ties: the smaller gap) and how often it occurs."""
    w = Window.partitionBy(*keys).orderBy(value)
    gaps = df.select(*keys, F.round(F.col(value) - F.lag(value).over(w), digits).alias("gap")).filter("gap is not null")
    counts = gaps.groupBy("gap").agg(F.count("*").alias("n"))
    return counts.groupBy().agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("gap"), F.max("n").alias("n"))


def bit_reduce(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Bit reductions and whether x ^ y, x & k or x | k explains y."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    a, b = F.col(x).cast("long"), F.col(y).cast("long")
    return g.agg(F.bit_or(b).alias("or_y"), F.bit_and(b).alias("and_y"), F.min(a.bitwiseXOR(b)).alias("xor_lo"), F.max(a.bitwiseXOR(b)).alias("xor_hi"))


def match_rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def benchmark_rollup(results: DataFrame) -> DataFrame:
    """Success rate, exact rate and mean R2 by method and noise, with subtotals."""
    ok = (F.col("exact") | (F.col("r2") > 0.999)).cast("double")
    return results.rollup("method", "noise").agg(F.count("*").alias("n"), F.avg(ok).alias("success_rate"), F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.avg("r2").alias("mean_r2"))
