"""Registration of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stallkeeper.plans.duck import oracle
from stallkeeper.sources.model import Model, out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None, recursive: bool = False):
    """Register make(model) -> DataFrame under a name, with its oracle if SQL can express it."""

    def register(make: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: out(make(Model(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle(sql, extra, recursive)
        return make

    return register
