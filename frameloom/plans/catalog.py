"""Registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a query under its function's name; ``covers`` lists the operators that it shows."""

    def add(build):
        if build.__name__ in REGISTRY:
            raise ValueError(f"two queries named {build.__name__}")
        REGISTRY[build.__name__] = Query(build.__name__, tuple(covers.split()), build, sql)
        return build

    return add
