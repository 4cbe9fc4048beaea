"""Registered queries and, for most of them, an SQL text that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` names the fixture views its SQL reads."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def r6(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def joined(values: Column | str, separator: str = ",") -> Column:
    column = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(column, lambda x: x.cast("string")), separator)


def digest(values: Column | str) -> Column:
    """md5 of an array joined by spaces: whole-text comparison in 32 characters."""
    return F.md5(joined(values, " "))
