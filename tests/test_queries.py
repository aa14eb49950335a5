"""Every registered query against its oracle on the smallest tables, or its law."""

import glob
import os

import pytest

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"feynman_benchmark", "gp_search"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    r = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(row[names.index(c)] for c in cols) for row in r.fetchall()]
    assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row.r2 == pytest.approx(1.0)
    assert set(e.oracle_sql()) <= set(e.queries())
