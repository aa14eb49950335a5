"""Join patterns: self-joins by key, band joins by bucket, as-of lookups, generated tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import primes

# fixed values: constants that results are compared with
CONSTANTS = (("pi", math.pi), ("e", math.e), ("sqrt(2)", math.sqrt(2)), ("sqrt(3)", math.sqrt(3)), ("sqrt(5)", math.sqrt(5)), ("phi", (1 + math.sqrt(5)) / 2), ("log(2)", math.log(2)), ("log(3)", math.log(3)), ("log(10)", math.log(10)), ("pi/2", math.pi / 2), ("pi/4", math.pi / 4), ("2*pi", 2 * math.pi), ("pi^2", math.pi**2), ("exp(-1)", math.exp(-1)))


def parity(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Pairs of rows at x and -x: number, and shares where y is even and where it is odd.

    Rows are counted by key and y before they meet, and pairs are products of counts: equal rows aren't expanded, and
    differing y meet those within the tolerance alone.
    """
    side = lambda rows, k, v: df.filter(rows).select(k.alias("__k"), F.col(y).alias(v)).groupBy("__k", v).agg(F.count("*").alias(f"{v}n"))
    a = side(F.col(x) > 0, F.round(x, digits) + 0.0, "__a")
    b = side(F.col(x) < 0, -F.round(x, digits), "__b")
    sums = lambda d, v: d.groupBy("__k").agg(F.sum(f"{v}n").alias(v), F.sum(F.when(F.col(v).isNotNull(), F.col(f"{v}n")).otherwise(0)).alias(f"{v}v"))
    pairs = sums(a, "__a").join(sums(b, "__b"), "__k").agg(F.coalesce(F.sum(F.col("__a") * F.col("__b")), F.lit(0)).alias("pairs"), F.sum(F.col("__av") * F.col("__bv")).alias("__whole"))

    def near(sign: int, name: str) -> DataFrame:
        """How many pairs have a y within a millionth of the other's, or of its negative: by buckets four times as wide."""
        at = lambda v: v.cast("double") / 4e-6
        # beyond 2^53 neighbouring doubles are further apart than the tolerance: they are their own buckets
        bucket = lambda q: F.when(F.abs(q) < 2.0**53, F.floor(q).cast("double")).otherwise(q)
        here = bucket(at(F.col("__a")))
        probe = a.filter(F.col("__a").isNotNull()).withColumn("__at", F.explode(F.array_distinct(F.array(here - 1, here, here + 1))))
        build = b.filter(F.col("__b").isNotNull()).withColumn("__at", bucket(at(F.col("__b") * sign)))
        met = probe.join(build, ["__k", "__at"]).filter(F.abs(F.col("__a") - F.col("__b") * sign) < 1e-6)
        return met.agg(F.coalesce(F.sum(F.col("__an") * F.col("__bn")), F.lit(0)).alias(name))

    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("__whole"))
    return pairs.crossJoin(near(1, "__even")).crossJoin(near(-1, "__odd")).select("pairs", share("__even").alias("even_share"), share("__odd").alias("odd_share"))


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, offset: float, tolerance: float) -> DataFrame:
    """Rows with |b - (a + offset)| < tolerance, by an equi-join on buckets of the tolerance.

    Each left row looks into its own bucket and the two beside it, so no pair is missed and the
    join is a hash or merge join of any size.
    """
    want = F.col(a) + offset
    probe = left.withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(want / tolerance) + d)))
    build = right.withColumn("__bucket", F.floor(F.col(b) / tolerance))
    return probe.join(build, "__bucket").filter(F.abs(F.col(b) - want) < tolerance).drop("__bucket")


def gamma_recursion(df: DataFrame, x: str, y: str, tolerance: float = 0.01) -> DataFrame:
    """Pairs with x2 near x + 1: how many, and how many satisfy y2 = x y within a hundredth."""
    nxt = df.select(F.col(x).alias("__x2"), F.col(y).alias("__y2"))
    pairs = band_join(df.select(x, y), nxt, x, "__x2", 1.0, tolerance)
    fits = F.abs(F.col("__y2") - F.col(x) * F.col(y)) <= 0.01 * F.greatest(F.abs(F.col("__y2")), F.lit(1.0))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(fits).alias("held"))


def symmetric_zeros(zeros: DataFrame, z: str, tolerance: float = 0.01) -> DataFrame:
    """Zeros a > 0 that have one near -a."""
    minus = zeros.filter(F.col(z) < 0).select((-F.col(z)).alias("__m"))
    return band_join(zeros.filter(F.col(z) > 0).select(z), minus, z, "__m", 0.0, tolerance).select(z).distinct()


def pole_neighbours(df: DataFrame, poles: DataFrame, x: str, p: str, width: float = 2.0) -> DataFrame:
    """Rows within ``width`` of a pole, with the distance."""
    return band_join(df, poles, x, p, 0.0, width).withColumn("distance", F.abs(F.col(x) - F.col(p)))


def compositions(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Every outer function of every inner formula: columns outer and inner, each pair being a result."""
    return outer.select("outer").crossJoin(inner.select("inner")).select(F.concat("outer", F.lit("("), "inner", F.lit(")")).alias("formula"))


def integer_grid(spark: SparkSession, condition: str, reach: int = 10) -> DataFrame:
    """Integer x and y up to ``reach`` in size that satisfy a condition in SQL."""
    axis = spark.range(-reach, reach + 1)
    return axis.select(F.col("id").alias("x")).crossJoin(F.broadcast(axis.select(F.col("id").alias("y")))).filter(condition)


def integer_solutions(df: DataFrame, value: str, expression: str, reach: int = 10) -> DataFrame:
    """value, x and y: integers up to ``reach`` in size at which an expression in SQL is a value of the table (an equi-join)."""
    grid = integer_grid(df.sparkSession, "true", reach).withColumn(value, F.expr(expression).cast("long"))
    return df.select(F.col(value).cast("long").alias(value)).distinct().join(grid, value).select(value, "x", "y")


def conflicts(df: DataFrame, keys: list[str], y: str, tolerance: float = 1e-7) -> DataFrame:
    """Keys (rounded to 9 decimals) whose y differ by more than the tolerance."""
    rounded = [F.round(k, 9).alias(k) for k in keys]
    return df.groupBy(*rounded).agg((F.max(y) - F.min(y)).alias("spread"), F.count("*").alias("n")).filter(F.col("spread") > tolerance)


def constant_lookup(df: DataFrame, value: str, tolerance: float = 1e-3) -> DataFrame:
    """Adds constant, the nearest known constant within the tolerance (null: none; ties: the first by name)."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in CONSTANTS])
    near = F.filter(known, lambda k: F.abs(F.col(value) - k["value"]) < tolerance)
    best = F.array_min(F.transform(near, lambda k: F.struct(F.abs(F.col(value) - k["value"]).alias("gap"), k["name"].alias("name"))))
    return df.withColumn("constant", best["name"])


#: Numbers of a sieve's segment.
SEGMENT = 1 << 20


def sieve(lo: int, hi: int) -> np.ndarray:
    """The primes p with lo <= p < hi, by crossing out multiples of primes up to the root."""
    lo = max(lo, 2)
    if hi <= lo:
        return np.zeros(0, np.int64)
    keep = np.ones(hi - lo, bool)
    root = math.isqrt(hi - 1)
    for p in (primes(max(4, root)) if root <= 1_000_000 else sieve(2, root + 1)).tolist():
        if p * p >= hi:
            break
        keep[max(p * p, -(-lo // p) * p) - lo :: p] = False
    return np.nonzero(keep)[0] + lo


def segment_counts(spark: SparkSession, last: int, width: int = SEGMENT) -> DataFrame:
    """segment and before: how many primes are below each segment of the numbers up to ``last``; tasks sieve segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([len(sieve(k * width, (k + 1) * width)) for k in own], pa.int64())], ["segment", "n"])

    counts = spark.range(last // width + 1).mapInArrow(run, "segment long, n long")
    # one row for each segment; prefix sums of groups of segments first, so that no task orders them all
    group = F.floor(F.col("segment") / 1024).cast("long")
    own = counts.withColumn("g", group).withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = counts.groupBy(group.alias("g")).agg(F.sum("n").alias("n"))
    starts = sums.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return own.join(starts, "g").select("segment", (F.col("start") + F.col("inside")).alias("before"))


def prime_count(df: DataFrame, x: str, width: int = SEGMENT) -> DataFrame:
    """Adds prime_count, the exact number of primes up to x (null for null).

    The numbers up to the greatest x are sieved in segments, each by one task, whose primes are counted up by prefix sums;
    a segment that holds keys is sieved with them, and each row meets its key's count by a join of equal keys.
    """
    key = F.floor(F.greatest(F.col(x).cast("double"), F.lit(0.0))).cast("long")
    own = df.withColumn("__key", F.when(F.col(x).isNotNull(), key))
    last = own.agg(F.max("__key").alias("m")).first().m
    if last is None:
        return own.withColumn("prime_count", F.lit(None).cast("long")).drop("__key")
    keys = own.select("__key").filter("__key is not null").distinct().withColumn("segment", F.floor(F.col("__key") / width).cast("long"))

    def inside(rows: pa.Table) -> pa.Table:
        at = np.asarray(rows.column("__key").combine_chunks())
        segment = int(rows.column("segment")[0].as_py())
        found = np.searchsorted(sieve(segment * width, (segment + 1) * width), at, side="right")
        return pa.table({"__key": pa.array(at), "segment": pa.array(np.full(len(at), segment)), "inside": pa.array(found)})

    counted = keys.groupBy("segment").applyInArrow(inside, "__key long, segment long, inside long").join(segment_counts(df.sparkSession, last, width), "segment")
    return own.join(counted.select("__key", (F.col("before") + F.col("inside")).alias("prime_count")), "__key", "left").drop("__key")


def is_prime(n: Column, below: int = 1000) -> Column:
    """Primality of n below a million, by trial division with the primes below ``below``."""
    small = F.array(*[F.lit(int(p)) for p in primes() if p < below])
    return (n >= 2) & ~F.exists(small, lambda p: (p * p <= n) & (n % p == 0))


def resample(df: DataFrame, t: str, x: str, keys: list[str], step: float, tie: str) -> DataFrame:
    """Linear interpolation at multiples of ``step`` inside each series: an as-of join in both directions."""
    own = df.groupBy(*keys, t).agg(F.min_by(x, tie).alias(x))
    w = Window.partitionBy(*keys).orderBy(t)
    pairs = own.withColumn("__t2", F.lead(t).over(w)).withColumn("__x2", F.lead(x).over(w)).filter("__t2 is not null")
    lo, hi = F.ceil(F.col(t) / step), F.floor(F.col("__t2") / step)
    # each gap between neighbours makes the grid points in it, but its end
    grid = pairs.filter(lo <= hi).withColumn("__k", F.explode(F.sequence(lo, hi))).withColumn("grid", F.col("__k") * step)
    grid = grid.filter(F.col("grid") < F.col("__t2"))
    share = (F.col("grid") - F.col(t)) / (F.col("__t2") - F.col(t))
    return grid.select(*keys, "grid", (F.col(x) + share * (F.col("__x2") - F.col(x))).alias(x))
