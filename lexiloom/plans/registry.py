"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans import cue_queries, gloss_queries, interval_queries, page_queries, structure_queries, term_queries, text_queries

MODULES = (interval_queries, text_queries, term_queries, gloss_queries, cue_queries, page_queries, structure_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
