"""Registered queries: a Spark callable and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    """Define a named SQL building block that later blocks and oracles may select from."""
    _CTES[name] = (needs, text)


def with_ctes(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in _CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    # shared blocks are read several times; let the engine compute each once
    blocks = ",\n".join(f"{n} as materialized ({_CTES[n][1]})" for n in order)
    final = final.strip()
    if final.startswith("with "):
        return f"with {blocks},\n{final[5:]}"
    return f"with {blocks}\n{final}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (sql, needs)
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql, *needs) for name, (sql, needs) in _SQL.items()}
