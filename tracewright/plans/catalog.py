"""Names of all queries of the engine, with their DuckDB twins."""

from __future__ import annotations

from tracewright.plans import adaptive_queries, program_queries, relation_queries, report_queries, signature_queries, skeleton_queries, stream_queries, text_queries, value_queries  # noqa: F401
from tracewright.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
