"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The current row of each rid, as a common table expression.
CUR = "cur AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY updated_at DESC) AS _n FROM bundles) WHERE _n = 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (session, data directory) under a name; ``sql`` is its counterpart, if SQL has one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("{CUR}", CUR)
        return f

    return put
