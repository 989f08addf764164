"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package, each with QUERIES and SQL.
MODULES: list[str] = ["entropy", "alignment", "patches", "texts", "quality", "vectors", "logs", "files"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"patchwright.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"patchwright.plans.{m}").SQL
    return out
