"""All registered queries of the library."""

from __future__ import annotations

from . import choice_queries, core_queries, data_queries, source_queries


def _all() -> dict:
    return {**core_queries.QUERIES, **data_queries.QUERIES, **source_queries.QUERIES, **choice_queries.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
