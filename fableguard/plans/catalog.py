"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fableguard.plans import rule_queries, run_queries, story_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return rule_queries.queries() | story_queries.queries() | text_queries.queries() | run_queries.queries()


def oracle_sql() -> dict[str, str]:
    return rule_queries.oracle_sql() | story_queries.oracle_sql() | text_queries.oracle_sql() | run_queries.oracle_sql()
