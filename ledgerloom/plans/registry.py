"""The core queries by name, with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import drift
from ledgerloom.plans import bills, cleaning, extraction, filters, forms, joins, metrics, relational, rules, storage, streams
from ledgerloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_extractions", "raw_id", "feed_id", "file_no", "payload")
    return drift.schema_changes(raw).select("feed_id", "file_no", "field_name", "change_kind").distinct()


def p2_cells(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified_cells(table(spark, folder, "raw_extractions", "raw_id", "feed_id", "file_no", "payload"))


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table: one typed column a unified field."""
    return drift.typed_table(table(spark, folder, "raw_extractions", "raw_id", "feed_id", "file_no", "payload"))


def p2_casts(spark: SparkSession, folder: str) -> DataFrame:
    """The report of casts that failed."""
    return drift.cast_report(drift.unified_cells(table(spark, folder, "raw_extractions", "raw_id", "feed_id", "file_no", "payload")))


_BOOKS = (filters, metrics, extraction, forms, bills, cleaning, rules, relational, joins, storage, streams)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"p2_found": p2_found, "p2_cells": p2_cells, "p2_table": p2_table, "p2_casts": p2_casts}
    for module in _BOOKS:
        out |= module.book.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _BOOKS:
        out |= module.book.sql
    return out
