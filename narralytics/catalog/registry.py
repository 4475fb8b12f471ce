"""Query registry: a name, a (spark, sf_dir) -> DataFrame callable and an optional oracle."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    operators: str
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under a name, with the inventory ids it covers."""
    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, operators, fn, sql)
        return fn
    return add
