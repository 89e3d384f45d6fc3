"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under a name, with its SQL."""
    def add(function):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(function, sql)
        return function
    return add


def load_all() -> dict[str, Query]:
    from storegrain.catalog import (  # noqa: F401
        files, learning, maintenance, places, preparation, quality, searching, statistics,
    )

    return REGISTRY
