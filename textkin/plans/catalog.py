"""The registry of queries: name -> (DataFrame plan, oracle SQL or None). Each module of `plans` adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under a name, with the SQL that gives the same rows where SQL can."""

    def add(f: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"two queries are called {name}")
        REGISTRY[name] = (f, sql)
        return f

    return add


def load() -> None:
    """Imports the modules that register plans."""
    from . import clusters, graphs, indexes, params, reports, scores, search, text  # noqa: F401


def queries() -> dict[str, Plan]:
    load()
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
