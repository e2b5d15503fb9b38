"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.leakage import leaks
from codestrata.session import broadcast_if_small, table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that carry them."""
    items = table(spark, sf_dir, "eval_items")
    counts = leaks(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return counts.join(broadcast_if_small(items.select("item_id", "suite", "subset")), "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items}
ORACLES: dict[str, str] = {}
