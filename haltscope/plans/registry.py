"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.plans.derive import Inputs
from haltscope.plans.oracle_views import with_views

_PLANS: dict[str, Callable[[Inputs], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name`` with the statement that must give the same rows."""

    def add(plan: Callable[[Inputs], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql:
            _SQL[name] = sql
        return plan

    return add


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, sf_dir: plan(Inputs(spark, sf_dir))

    return {name: bind(plan) for name, plan in _PLANS.items()}


def statements() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}


def r6(c: Column | str) -> Column:
    """Six decimals: sums of doubles differ in the last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)
