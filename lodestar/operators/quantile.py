"""Exact quantiles in bounded memory, of whole tables and within keys.

A group of up to ``LIMIT`` values is sorted in one aggregation buffer. A larger one is narrowed first: a mergeable
summary brackets each quantile, rows below and within the bracket are counted, and a bracket that still holds too many
values is cut into equal bins, of which the one with the quantile goes on. What is left is counted by value and ordered,
within ``LIMIT``; nothing is approximated. Rows aren't shuffled by group: they meet the brackets of a few groups where they lie.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values of a group that one buffer may hold.
LIMIT = 1_000_000
ACCURACY, BINS = 10_000, 1_000


def largest_group(df: DataFrame, value: Column, keys: list[str] | None = None) -> int:
    """How many values that aren't null the largest group has."""
    return df.filter(value.isNotNull()).groupBy(*(keys or [])).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def percentiles(df: DataFrame, value: Column, probs: list[float], keys: list[str] | None = None, limit: int | None = None, largest: int | None = None) -> DataFrame:
    """keys and __q: array of the interpolated quantiles, nulls aside; without keys one row (null where there are no values).

    ``largest`` is how many values a group has at most, where that is known: it saves a count.
    """
    keys, limit = list(keys or []), limit or LIMIT
    own = df.select(*keys, value.cast("double").alias("__v")).filter("__v is not null")
    spread = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)])
    if (largest_group(own, F.col("__v"), keys) if largest is None else largest) <= limit:
        return own.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(p) for p in probs])).alias("__q"))

    # a row a group: written first, so that its size is known and the rows meet it where they lie if it is small
    sizes = written(own.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", spread, ACCURACY).alias("__s")))
    counted = written(_counted(own, sizes, probs, keys))
    while counted.filter((F.col("__inside") > limit) & (F.col("__lo") < F.col("__hi"))).limit(1).count():
        counted = written(_narrowed(own, counted, keys, limit))
    inside = _met(own, counted.filter(F.col("__lo") < F.col("__hi")), keys).filter("__v between __lo and __hi")
    # equal values are one row with their number: what a rank falls on follows from running sums
    values = inside.groupBy(*keys, "__j", "__up", "__v").agg(F.count("*").alias("__c"), F.first("__part").alias("__part"), F.first(F.col("__r") - F.col("__below")).alias("__at"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys, "__j", "__up").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = values.withColumn("__first", before).filter((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__first") + F.col("__c")))
    found = hit.select(*keys, "__j", "__up", "__part", F.col("__v").alias("__x")).unionByName(counted.filter(F.col("__lo") >= F.col("__hi")).select(*keys, "__j", "__up", "__part", F.col("__lo").alias("__x")))
    a, b = (F.max(F.when(F.col("__up") == up, F.col("__x"))) for up in (0, 1))
    each = found.groupBy(*keys, "__j").agg((a * (1 - F.first("__part")) + b * F.first("__part")).alias("__x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__j", "__x"))), lambda s: s["__x"]).alias("__q"))


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below the shared checkpoint folder (a local one only in local mode, where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/lodestar-checkpoints"
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """A table of a few rows a group: written to the shared folder, which cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quantiles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _met(own: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's targets (without keys: those of the one group)."""
    return own.join(targets, keys) if keys else own.crossJoin(F.broadcast(targets))


def _counted(own: DataFrame, sizes: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """How many values lie below each quantile's bracket and in it, of which __r is the rank wanted; a bracket that misses its ranks is widened to all.

    A row meets its group once, whatever the number of quantiles. Two ranks a quantile: the values next below and above it.
    """
    lo, hi = (lambda k: F.col("__s")[2 * k]), (lambda k: F.col("__s")[2 * k + 1])
    counts = [c for k in range(len(probs)) for c in (F.count_if(F.col("__v") < lo(k)).alias(f"__b{k}"), F.count_if((F.col("__v") >= lo(k)) & (F.col("__v") <= hi(k))).alias(f"__i{k}"))]
    # brackets aren't carried through the aggregate: arrays in it would have the rows sorted
    got = _met(_met(own, sizes.drop("__n"), keys).groupBy(*keys).agg(*counts, F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.count("*").alias("__n")), sizes.drop("__n"), keys)
    rank = lambda p: F.lit(p) * (F.col("__n") - 1)
    each = [F.struct(F.lit(k).alias("j"), F.lit(up).alias("up"), (rank(p) - F.floor(rank(p))).alias("part"), (F.ceil if up else F.floor)(rank(p)).alias("r"), lo(k).alias("lo"), hi(k).alias("hi"), F.col(f"__b{k}").alias("below"), F.col(f"__i{k}").alias("inside")) for k, p in enumerate(probs) for up in (0, 1)]
    t = lambda c: F.col(f"__t.{c}")
    ok = (t("r") >= t("below")) & (t("r") < t("below") + t("inside"))
    pick = lambda yes, no: F.when(ok, t(yes)).otherwise(no).alias(f"__{yes}")
    return got.withColumn("__t", F.explode(F.array(*each))).select(*keys, *[t(c).alias(f"__{c}") for c in ("j", "up", "part", "r")], pick("lo", F.col("__a")), pick("hi", F.col("__z")), pick("below", F.lit(0)), pick("inside", F.col("__n")))


def _narrowed(own: DataFrame, targets: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Brackets that hold more than ``limit`` values, each cut to the bins that hold its ranks, by their own ends."""
    large = (F.col("__inside") > limit) & (F.col("__lo") < F.col("__hi"))
    cut = _met(own, targets.filter(large), keys).filter("__v between __lo and __hi")
    # halves first: the width of a bracket may be beyond a double
    span = F.col("__hi") / 2 - F.col("__lo") / 2
    share = F.when(span > 0, (F.col("__v") / 2 - F.col("__lo") / 2) / span).otherwise(F.when(F.col("__v") > F.col("__lo"), 1.0).otherwise(0.0))
    bins = cut.withColumn("__bin", F.least(F.floor(share * BINS), F.lit(BINS - 1))).groupBy(*keys, "__j", "__up", "__bin").agg(
        F.count("*").alias("__c"), F.min("__v").alias("__x"), F.max("__v").alias("__y"), *[F.first(c).alias(c) for c in ("__r", "__part", "__below")])
    before = F.sum("__c").over(Window.partitionBy(*keys, "__j", "__up").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    ranked = bins.withColumn("__first", F.col("__below") + F.coalesce(before, F.lit(0)))
    holds = ranked.filter((F.col("__r") >= F.col("__first")) & (F.col("__r") < F.col("__first") + F.col("__c")))
    new = holds.select(*keys, "__j", "__up", "__part", "__r", F.col("__x").alias("__lo"), F.col("__y").alias("__hi"), F.col("__first").alias("__below"), F.col("__c").alias("__inside"))
    return new.unionByName(targets.filter(~large).select(*new.columns))


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of a column; None where there are no values."""
    row = percentiles(df, value, [0.5]).first()
    return row["__q"][0] if row and row["__q"] else None
