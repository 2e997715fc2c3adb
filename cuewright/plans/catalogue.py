"""The core's queries over the test tables, by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.plans import caption_queries, interval_queries, name_queries, run_queries, source_queries

_MODULES = [caption_queries, interval_queries, name_queries, run_queries, source_queries]
FLAGSHIP = "paragraph_fold"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
