"""Steps whose work or memory grew faster than their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dynamics, match, series


def test_equation_search_reads_its_table_once(spark):
    """Every row is made once for search and count alike."""
    made = spark.sparkContext.accumulator(0)
    t = 0.02 * np.arange(150)

    def paths(batches):
        for batch in batches:
            starts = np.asarray(batch.column(0)) / 8 + 0.3
            path = np.stack(list(series.rk4(lambda s: np.stack([s[1], -np.sin(s[0])]), np.stack([starts, 0 * starts]), t)))[:, 0]
            import pyarrow as pa

            for k, own in zip(batch.column(0).to_pylist(), path.T, strict=True):
                made.add(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(150, k)), pa.array(np.arange(150)), pa.array(t), pa.array(own)], ["k", "i", "t", "x"])

    df = spark.range(0, 16, 1, 2).mapInArrow(paths, "k long, i long, t double, x double")
    found = dynamics.search_ode(df, "t", "x", ["k"], "i")
    assert found.text == "y'' + sin(y) = 0" and found.rows == 16 * 150
    assert made.value == 16 * 150


def test_moments_leave_out_rows_without_values(spark):
    rows = [(0.5, 1.0, -2.0), (1.5, -1.0, 3.0), (-2.0, 0.25, 1.0), (None, 1.0, 1.0), (float("inf"), 1.0, 1.0), (1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "y0 double, y1 double, y2 double").repartition(3)
    got, n, read = dynamics.second_moments(df, ["y0", "y0^3*y1", "sin(y0)", "y1*sin(y0)", "y2^2"])
    a, b, c = np.array(rows[:3]).T
    v = np.stack([a, a**3 * b, np.sin(a), b * np.sin(a), c * c])
    assert (n, read) == (3, 6) and got == pytest.approx(v @ v.T / 3, rel=1e-12)


def test_parity_of_many_equal_rows(spark):
    """200,000 rows at each of 2 and -2 are 4e10 pairs."""
    df = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, 2.0).otherwise(-2.0).alias("x"), F.when(F.col("id") % 8 < 4, 4.0).otherwise(5.0).alias("y"))
    r = match.parity(df, "x", "y").first()
    assert (r.pairs, r.even_share, r.odd_share) == (40_000_000_000, 0.5, 0.0)


def test_parity_equals_pairs_one_by_one(spark):
    rng = np.random.default_rng(5)
    near = [0.0, 1e-7, -1e-7, 9.9e-7, 1e-6, 1.1e-6, 3e-6, 4e-6, -4e-6, 3.9e-6, 1e10, 1e10 + 2e-6, -1e10, 36028797018963968.0, 36028797018963976.0, 1e300, -1e300, None, float("nan"), float("inf"), -float("inf")]
    rows = [(float(x) / 2, y) for x, k in zip(rng.integers(-3, 4, 600), rng.integers(0, len(near), 600), strict=True) for y in [near[k]]] + [(None, 1.0), (1e-8, 1.0), (-1e-8, -1.0), (7.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    key = lambda x: round(x, 6) + 0.0
    met = [(a, b) for x, a in rows if x is not None and x > 0 for z, b in rows if z is not None and z < 0 and key(x) == key(-z)]
    whole = [(a, b) for a, b in met if a is not None and b is not None]
    r = match.parity(df, "x", "y").first()
    assert r.pairs == len(met)
    assert r.even_share == sum(abs(a - b) < 1e-6 for a, b in whole) / len(whole) and r.odd_share == sum(abs(a + b) < 1e-6 for a, b in whole) / len(whole)
    none = match.parity(df.filter("x > 0"), "x", "y").first()
    assert (none.pairs, none.even_share, none.odd_share) == (0, None, None)


def test_quantiles_of_a_few_large_groups_shuffle_no_rows_by_group(spark, monkeypatch, capsys):
    """Two groups are two tasks, whatever their size, if rows are shuffled or sorted by group."""
    from lodestar.operators import quantile

    kept = quantile.written

    def shown(df):
        df.explain()
        return kept(df)

    monkeypatch.setattr(quantile, "written", shown)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        df = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 5003).cast("double").alias("v"))
        out = quantile.percentiles(df, F.col("v"), [0.2, 0.5], ["k"], limit=1000)
        out.explain()
        got = {r.k: r["__q"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for k in (0, 1):
        assert got[k] == pytest.approx(np.quantile(np.arange(k, 200_000, 2) * 7919 % 5003, [0.2, 0.5]).tolist(), rel=1e-12)
    plans = capsys.readouterr().out
    assert "BroadcastHashJoin" in plans and "SortMergeJoin" not in plans and "SortAggregate" not in plans
