"""All registered queries of the scoring engine and their DuckDB counterparts."""

from __future__ import annotations

from vecscore.plans import catalog, oracle


def queries():
    return catalog.queries()


def oracle_sql():
    return oracle.sql()
