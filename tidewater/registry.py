"""Queries of the library's own operators and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that define queries Q and their SQL S.
MODULES = [
    "tidewater.plans.queries",
    "tidewater.operators.event_queries",
    "tidewater.sources.queries",
    "tidewater.operators.insight_queries",
    "tidewater.operators.text_queries",
    "tidewater.streaming.queries",
]


def _all(part: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(name), part)
    return found


def queries() -> dict[str, Query]:
    return _all("Q")


def oracle_sql() -> dict[str, str]:
    return _all("S")
