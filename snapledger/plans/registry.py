"""Names of queries, their DataFrames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import DERIVED_SQL
from ..sources.ledger import BASE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Relations ``base`` and ``rec``, to be continued with more relations or a SELECT.
RECORDS = f"WITH {BASE_SQL}, {DERIVED_SQL}"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
