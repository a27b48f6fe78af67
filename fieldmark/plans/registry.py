"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("feature_queries", "identity_queries", "valuation_queries", "projection_queries", "board_queries")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"fieldmark.plans.{name}"), what)
        if both := found.keys() & part.keys():
            raise ValueError(f"defined twice: {sorted(both)}")
        found |= part
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_board"](spark, sf_dir)
