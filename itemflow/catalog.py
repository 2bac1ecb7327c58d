"""The engine's queries over the test tables, each with SQL for the same rows where SQL has words for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_columns, catalog_documents, catalog_operators


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog_operators.queries() | catalog_columns.queries() | catalog_documents.queries()


def oracle_sql() -> dict[str, str]:
    return catalog_operators.oracle_sql() | catalog_columns.oracle_sql() | catalog_documents.oracle_sql()
