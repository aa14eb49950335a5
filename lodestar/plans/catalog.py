"""The registry of the engine's queries and of their oracle SQL."""

from __future__ import annotations

from . import scalar, tables
from .base import Query


def queries() -> dict[str, Query]:
    return scalar.R.queries | tables.R.queries


def oracle_sql() -> dict[str, str]:
    return scalar.R.sql | tables.R.sql
