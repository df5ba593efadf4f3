"""Registry of the engine's queries and their DuckDB oracles, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("documents", "graph", "contract", "semantic", "coverage")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for area in AREAS:
        module = import_module(f"mdlake.plans.{area}_queries")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
