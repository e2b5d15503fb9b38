"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_handwritten", "q_secrets", "q_quantiles", "q_syntax", "q_leakage", "q_mixing", "q_encodings"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(f"codestrata.llm.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"codestrata.llm.{name}").ORACLES)
    return out
