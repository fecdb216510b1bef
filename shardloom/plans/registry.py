"""Named queries with, where SQL can express them, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query; ``covers`` names its line in the operator inventory."""

    def wrap(run: Runner) -> Runner:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, covers, run, sql)
        return run

    return wrap
