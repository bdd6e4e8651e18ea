"""Queries over the test tables, by family, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("market", "portfolio", "trading")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for family in FAMILIES for k, f in import_module(f"barquet.plans.{family}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for family in FAMILIES for k, s in import_module(f"barquet.plans.{family}").SQL.items()}
