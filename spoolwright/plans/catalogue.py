"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import log_queries, problems, problems_sql


def queries() -> dict:
    return {**log_queries.QUERIES, **problems.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**log_queries.SQL, **problems_sql.SQL}
