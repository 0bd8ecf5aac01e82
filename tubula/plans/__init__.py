"""Registered queries over the supplied tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """Queries and oracles of all plan modules."""
    from tubula.plans import aggregates, cohorts, jobs, lines  # noqa: F401
    from tubula.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
