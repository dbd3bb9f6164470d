"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from trialloom.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
