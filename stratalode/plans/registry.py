"""All queries of the core library and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from stratalode.plans import catalog
from stratalode.session import share_code

MODULES = ("text", "quality", "listings", "sensors", "retrieval", "search", "graph", "knowledge", "chunks", "context", "budget", "evaluation", "storage")


def _load() -> None:
    for name in MODULES:
        import_module(f"stratalode.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: lambda spark, sf_dir, f=f: f(catalog.Tables(share_code(spark), sf_dir)) for name, f in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.SQL)
