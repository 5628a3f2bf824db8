"""Every query of the library by name, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelab.plans import fit_queries, image_queries, report_queries, source_queries, trace_queries

PARTS = (trace_queries, fit_queries, image_queries, source_queries, report_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: make for part in PARTS for name, make in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
