"""The query catalogue: one entry per operator, on the stand-in views, with its SQL twin if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist.plans.standins import Tables, with_views
from annalist.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def load() -> None:
    from annalist.plans import (  # noqa: F401
        document_queries, digest_queries, extraction_queries, repair_queries, resolution_queries, timeline_queries,
    )
