"""Every query of the library proper by name, with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, evaluations, layouts, qualities, searching, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (searching, qualities, audits, states, evaluations, layouts):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search: the ten best pages for two words."""
    return QUERIES["bm25_search"](spark, sf_dir)
