"""The core's queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import analysis_queries, boolean_queries, ranking_queries, source_queries, text_queries, topic_queries  # noqa: F401 - they register their queries
from lexmill.plans.topic_queries import flagship  # noqa: F401
from lexmill.plans.registry import REGISTERED


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
