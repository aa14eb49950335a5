"""Helpers of the query modules: tables, rounding alike on both engines, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Null for what isn't finite, no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits) + 0.0)


def rd(sql: str, digits: int = 6) -> str:
    """The same for the oracle."""
    return f"CASE WHEN isfinite({sql}) THEN round({sql}, {digits}) + 0.0 END"


def only(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """All double columns rounded; ``keep`` names the columns, in order (all: none named)."""
    kinds = dict(df.dtypes)
    return df.select(*[(rounded(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`")) for c in (keep or df.columns)])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None):
        """Registers a function under its own name."""

        def wrap(fn: Query) -> Query:
            self.add(fn.__name__, fn, sql)
            return fn

        return wrap


def seconds(ts: str = "ts") -> Column:
    """Epoch seconds of a time stamp without zone, in any session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))") / 1e6


SECONDS = "(epoch_us(ts) / 1000000.0::DOUBLE)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by user: t seconds, value, and event_id to break ties."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds().alias("t"), "value")


EVENTS = f"(SELECT user_id, event_id, event_type, {SECONDS} AS t, value FROM events)"
