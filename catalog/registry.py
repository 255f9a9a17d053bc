"""Registration of queries and composition of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeworks.runtime import configure

from .fixtures import Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str, recursive: bool = False):
    """Declare a common table expression; the decorated function returns its SELECT."""

    def register(build: Callable[[], str]):
        VIEWS[name] = (needs, f"{name} AS {'' if recursive else 'MATERIALIZED '}({build()})")
        return build

    return register


def with_views(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in VIEWS[name][0]:
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n][1] for n in ordered) + "\n" + body


def query(name: str, *needs: str, sql: str | None = None):
    """Register ``fn(fixture) -> DataFrame`` under ``name``, with its oracle SELECT when one exists."""

    def register(fn: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixture(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *needs)
        return fn

    return register


def r6(value) -> Column:
    """Comparable double: six decimals, no negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def rounded(*names: str) -> list[Column]:
    return [r6(n).alias(n) for n in names]


def day(name: str = "date", alias: str | None = None) -> Column:
    return F.col(name).cast("string").alias(alias or name)


def q6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def q6s(*names: str) -> str:
    return ", ".join(f"{q6(n)} AS {n}" for n in names)
