"""All registered queries and their SQL."""

from __future__ import annotations

from cleanloom.workload import checks, fixes, outliers, profile, recommend, sources

MODULES = (sources, profile, outliers, checks, recommend, fixes)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
