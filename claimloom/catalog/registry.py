"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..plans.bindings import Tables

MODULES = (
    "bibliometrics", "citations", "claims", "graphs", "enrichment", "texts", "scores", "monitors", "sources", "traces", "networks", "histories", "stewardship",
)


def _entries() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    out: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
    for name in MODULES:
        out.update(import_module(f"{__package__}.{name}").ENTRIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, (fn, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
