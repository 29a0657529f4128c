"""All queries of this subpackage, by name."""

from __future__ import annotations

from skein.llm import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(_queries.ORACLE)
