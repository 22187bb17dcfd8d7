"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from loamgraph.plans import coverage, graphs, pipeline, problems, relational, retrieval, upkeep

MODULES = [problems, relational, retrieval, graphs, upkeep, pipeline, coverage]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
