"""Registered queries over the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellex.operators.nested import distinct_links, nested_rows
from tessellex.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "annotation_records", "record_id", "payload")
    return distinct_links(nested_rows(records, kinds=("coref_mention", "entity_mention", "quote"), with_fields=False))


@query("p3_children")
def p3_children(spark: SparkSession, folder: str) -> DataFrame:
    """Children of every kind, tokens too, with their fields."""
    records = table(spark, folder, "annotation_records", "record_id", "payload")
    return nested_rows(records)
