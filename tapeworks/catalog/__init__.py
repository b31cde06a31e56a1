"""Registered queries: a Spark job per operator and, where SQL can say it, the
same result as SQL over the given tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "averages", "oscillators", "bands", "structure", "tables", "candles", "joins", "risk", "reports",
    "signals", "features", "stats", "portfolio", "knowledge", "scalars", "models", "flows", "simulate",
]


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tapeworks.catalog.{m}")
