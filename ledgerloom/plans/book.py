"""A book of named queries, each with the SQL an independent engine runs on the same tables (None: not expressible there)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep


#: Tables deliver some rows twice, equal in every column.
CLAIMS_SQL = "claims AS (SELECT DISTINCT * FROM claim)"
ITEMS_SQL = "items AS (SELECT DISTINCT * FROM claim_items)"
CODES_SQL = "codes AS (SELECT DISTINCT * FROM claim_codes)"
AUDIT_SQL = "audit AS (SELECT DISTINCT * FROM audit_log)"
