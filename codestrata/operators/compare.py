"""Comparisons of a baseline with a current state, and the latest version of delivered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Of several rows of a key the one that comes first in ``order`` (a total order); the others are outdated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def change_type(before: Column, after: Column, unit: float = 1.0) -> Column:
    """new, removed, unchanged (moved by less than ``unit``), improved or regressed."""
    delta = after - before
    return (
        F.when(before.isNull(), "new").when(after.isNull(), "removed").when(F.abs(delta) < unit, "unchanged").when(delta > 0, "improved").otherwise("regressed")
    )


def full_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two states on their keys (null-safe): ``keys, before, after``."""
    tagged = before.select(*keys, F.col(value).alias("v"), F.lit(0).alias("side")).unionByName(after.select(*keys, F.col(value).alias("v"), F.lit(1).alias("side")))
    # One aggregation instead of a join: both sides meet at their key, and each side is combined on the map side.
    return tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("before"),
        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("after"),
        F.count_if(F.col("side") == 0).alias("in_before"),
        F.count_if(F.col("side") == 1).alias("in_after"),
    )
