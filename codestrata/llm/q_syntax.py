"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.syntax import checked, rates
from codestrata.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "files"), table(spark, sf_dir, "languages")).filter("fault IS NOT NULL").select("file_id")


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact place and kind of each fault."""
    return checked(table(spark, sf_dir, "files"), table(spark, sf_dir, "languages")).filter("fault IS NOT NULL")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "languages"))


QUERIES = {"p6_found": p6_found, "p6_faults": p6_faults, "p6_rates": p6_rates}
ORACLES: dict[str, str] = {}
