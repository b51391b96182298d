"""Where queries register themselves, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.domain import sql as with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. `days` names its date columns: both sides give them as ISO text, since engines hand dates over in different types."""

    def add(f: Query) -> Query:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = f(spark, sf_dir)
            return rows.withColumns({c: rows[c].cast("string") for c in days}) if days else rows

        QUERIES[name] = shown
        if sql:
            text = with_views(sql)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({text})" if days else text
        return f

    return add
