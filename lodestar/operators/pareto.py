"""Pareto fronts of (mse, complexity) and choices from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def front(df: DataFrame, cost: str = "mse", size: str = "complexity", keys: list[str] | None = None) -> DataFrame:
    """Rows that no other beats in both: a running minimum over sizes, by one aggregate a size first."""
    keys = keys or []
    best = df.groupBy(*keys, size).agg(F.min(cost).alias(cost))
    w = Window.partitionBy(*keys).orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("__m", F.min(cost).over(w)).filter(F.col("__m").isNull() | (F.col(cost) < F.col("__m"))).drop("__m")
    return df.join(kept, [*keys, size, cost], "left_semi")


def trim(df: DataFrame, most: int = 100, size: str = "complexity") -> DataFrame:
    """At most ``most`` rows of a front, evenly spaced by size, ends kept."""
    n = F.count("*").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy(size)) - 1
    own = df.withColumn("__k", k).withColumn("__n", n)
    slot = F.floor(F.col("__k") * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    nxt = F.floor((F.col("__k") - 1) * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    return own.filter((F.col("__n") <= most) | (F.col("__k") == 0) | (slot > nxt)).drop("__k", "__n")


def knee(df: DataFrame, cost: str = "mse", size: str = "complexity") -> DataFrame:
    """The row farthest from the chord between the ends of the front, on scaled axes; a perfect fit wins."""
    ends = df.agg(F.min(cost).alias("__c0"), F.max(cost).alias("__c1"), F.min(size).alias("__s0"), F.max(size).alias("__s1"))
    own = df.crossJoin(F.broadcast(ends))
    x = F.coalesce(F.try_divide(F.col(size) - F.col("__s0"), F.col("__s1") - F.col("__s0")), F.lit(0.0))
    y = F.coalesce(F.try_divide(F.col(cost) - F.col("__c0"), F.col("__c1") - F.col("__c0")), F.lit(0.0))
    rank = F.struct((F.col(cost) < 1e-9).cast("int"), (1 - x - y), -F.col(size))
    return own.agg(F.max_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def within_budget(df: DataFrame, most: float, cost: str = "mse", size: str = "complexity") -> DataFrame:
    return df.filter(F.col(size) <= most).agg(F.min_by(F.struct(*df.columns), F.struct(cost, size)).alias("r")).select("r.*")


def simplest(df: DataFrame, cost: str = "mse", size: str = "complexity") -> DataFrame:
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(size, cost)).alias("r")).select("r.*")


def most_accurate(df: DataFrame, cost: str = "mse", size: str = "complexity") -> DataFrame:
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(cost, size)).alias("r")).select("r.*")
