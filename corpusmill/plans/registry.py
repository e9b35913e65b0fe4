"""Registry of named queries: a function from (spark, folder) to a DataFrame, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Operators of the survey that a query covers.
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a function under a name. Without SQL, tests hold it against brute force."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name], COVERS[name] = f, covers
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return put
