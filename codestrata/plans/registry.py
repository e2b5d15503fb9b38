"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["p4_snapshots", "p2_nested", "q_scan", "q_findings", "q_history", "q_code", "q_reports", "q_manifests", "q_scores", "q_tools", "q_more", "q_trees"]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out.update(import_module(f"codestrata.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"codestrata.plans.{name}").ORACLES)
    return out
