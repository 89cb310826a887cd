"""Queries with their SQL counterparts side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from spanledger.session import pin_utc
from spanledger.sources.adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; without ``sql`` only its rows can be checked."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(pin_utc(spark), sf_dir))

        REGISTRY[name] = Query(name, run, sql)
        return fn
    return wrap
