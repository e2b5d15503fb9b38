"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.secrets import found_lines, redacted
from codestrata.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_lines(table(spark, sf_dir, "files"), table(spark, sf_dir, "findings"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "files"), table(spark, sf_dir, "findings"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
ORACLES: dict[str, str] = {}
