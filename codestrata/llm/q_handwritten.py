"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.handwritten import not_handwritten
from codestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "files")).select("file_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and reason the number of files that are not hand-written."""
    files = table(spark, sf_dir, "files")
    return files.select("file_id", "repo").join(not_handwritten(files), "file_id").groupBy("repo", "reason").agg(F.count("*").alias("files"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}
ORACLES: dict[str, str] = {}
