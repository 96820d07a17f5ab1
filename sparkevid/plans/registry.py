"""All queries of the engine and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, job_queries, metric_queries, rule_queries

_MODULES = (corpus_queries, rule_queries, metric_queries, job_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
