"""All queries of the core, by name."""

from __future__ import annotations

from skein.plans import answer_queries, asset_queries, index_queries, markdown_queries, orphan_queries, retrieval_queries, source_queries, structure_queries, text_queries

_MODULES = (retrieval_queries, structure_queries, asset_queries, text_queries, index_queries, markdown_queries, answer_queries, source_queries, orphan_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
