"""Registry of queries: name, blueprint ids, Spark builder, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def wrap(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(ops.split()), build, sql)
        return build
    return wrap
