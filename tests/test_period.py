"""Periods behind gaps, steps, noise and outliers, over whole and over uneven x."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import discover, period


def saw(df):
    return df.select(F.col("id").alias("x"), (900 + F.pmod("id", F.lit(1000)) / 10).alias("y"))


FAR = "if(pmod(xxhash64(x), 100) < 5, y + pmod(xxhash64(x, y), 100000) / 100 - 500, y)"
CASES = {
    "one key missing": lambda d: d.filter("x <> 2000"),
    "even keys": lambda d: d.filter("x % 2 = 0"),
    "one outlier": lambda d: d.withColumn("y", F.expr("if(x = 500, 5000.0D, y)")),
    "one in twenty is an outlier": lambda d: d.withColumn("y", F.expr(FAR)),
    "two thirds missing": lambda d: d.filter("xxhash64(x) % 3 = 0"),
}


@pytest.mark.parametrize("case", CASES)
def test_flagship_behind_gaps_and_outliers(spark, case):
    got = discover.find(CASES[case](saw(spark.range(1, 20_001))), ["x"], "y")
    assert got.formula == "900 + (1/10)*mod(x, 1000)" and got.r2 > 1 - 1e-9


def test_two_million_rows_with_outliers(spark):
    got = discover.find(saw(spark.range(1, 2_000_001)).withColumn("y", F.expr(FAR)), ["x"], "y")
    assert got.formula == "900 + (1/10)*mod(x, 1000)" and got.how.startswith("modulo") and 0.94 * 2e6 < got.n < 0.96 * 2e6


def test_waves_over_uneven_x_and_no_period_where_there_is_none(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 500, 5000))
    df = spark.createDataFrame([(float(a), float(2 + math.sin(3.7 * a) + rng.normal() * 0.1)) for a in x], "x double, y double")
    best = period.periods(df, "x", "y")[0]
    assert best.length == pytest.approx(2 * math.pi / 3.7, rel=1e-4)
    noise = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rng.normal(size=4000))], "x long, y double")
    assert not [p for p in period.periods(noise, "x", "y") if p.spread < 0.5]
    assert period.periods(noise.limit(0), "x", "y") == [] and period.periods(noise.limit(5), "x", "y") == []
    assert period.periods(noise.withColumn("y", F.lit(1.0)), "x", "y") == []


def test_phases_sharpen_a_peak(spark):
    true = 1 / 37.123
    df = spark.range(200_000).select(F.col("id").alias("i"), F.sin(2 * math.pi * true * F.col("id")).alias("v"))
    (got,) = period.sharpened(df, [true * (1 + 1e-4)], 1 << 16, 200_000.0)
    assert got == pytest.approx(true, rel=1e-7)


@pytest.mark.parametrize("keys", [1500, 2000, 2450])
def test_a_period_that_comes_once_or_twice(spark, keys):
    got = discover.find(saw(spark.range(keys)), ["x"], "y")
    assert got.formula == "900 + (1/10)*mod(x, 1000)" and got.how == "modulo"
