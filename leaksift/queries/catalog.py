"""Registered queries: each is a Spark job over the given tables, most with equivalent SQL."""

from __future__ import annotations

from leaksift.queries import checking, metrics, pairs, projections, rates, splits, statistics, vectors

MODULES = (pairs, rates, splits, metrics, statistics, vectors, projections, checking)


def all_queries() -> dict:
    found = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found = {}
    for module in MODULES:
        found.update(module.SQL)
    return found
