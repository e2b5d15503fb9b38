"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.encodings import garbled
from codestrata.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the chain of encodings and the text as it was meant."""
    return garbled(table(spark, sf_dir, "documents"), restore=True)


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
ORACLES: dict[str, str] = {}
