"""Queries of this subpackage by name and the SQL they are checked against."""

from __future__ import annotations

from sparkloom.llm import item_queries, source_queries, text_queries

MODULES = [source_queries, item_queries, text_queries]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
