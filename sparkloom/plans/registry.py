"""All core queries by name, each ``(spark, sf_dir) -> DataFrame``, and the SQL they are checked against."""

from __future__ import annotations

from sparkloom.plans import graph_plans, review_plans, snapshot_plans, store_plans

MODULES = [snapshot_plans, graph_plans, store_plans, review_plans]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
