"""All queries of the core, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import adapter_queries, check_queries, retrieval_queries, skew_queries, table_queries, text_queries

MODULES = (skew_queries, retrieval_queries, text_queries, adapter_queries, table_queries, check_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
