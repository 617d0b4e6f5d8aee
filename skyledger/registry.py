"""All queries of the package by operator id, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.bindings import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) under an operator id; `sql` is over the views of `bindings`."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            # A count of DuckDB's own width, as Spark's.
            ORACLE_SQL[name] = duck(re.sub(r"COUNT_IF\(([^()]*)\)", r"COUNT(CASE WHEN \1 THEN 1 END)", sql))
        return f

    return put
