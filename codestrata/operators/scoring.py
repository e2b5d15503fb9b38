"""Scores: weighted means, risk, strengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: weights of the categories and limits of the risk levels ----
WEIGHTS = {
    "complexity": 2.0, "security": 3.0, "testing": 2.0, "architecture": 2.0, "maintainability": 1.5, "dependencies": 1.0, "documentation": 0.5,
    "git_history": 0.5, "javascript": 1.5, "java": 1.5, "go": 1.5, "cpp": 1.5,
}
RISK_LIMITS = {"critical": 35.0, "high": 55.0, "medium": 75.0}
STRONG, WEAK, ALARM = 80.0, 50.0, 40.0
ALARM_CATEGORIES = ["security", "architecture"]
# --------------------------------------------------------------------------------


def default_weight(category: Column, default: float = 1.0) -> Column:
    out = None
    for name, w in WEIGHTS.items():
        out = F.when(category == name, F.lit(w)) if out is None else out.when(category == name, F.lit(w))
    return out.otherwise(F.lit(default))


def weighted_mean(score: Column, weight: Column, skip_zero: bool = True) -> Column:
    """Aggregate: weighted mean to one decimal, half even, exact in its sums; zero scores are left out.

    Null scores are left out; without any score the result is 0.0.
    """
    s, w = score.cast("decimal(12,4)"), weight.cast("decimal(8,4)")
    use = s.isNotNull() & w.isNotNull() & ((s > 0) if skip_zero else F.lit(True))
    total = F.sum(F.when(use, w))
    mean = F.sum(F.when(use, s * w)).cast("double") / F.nullif(total, F.lit(0)).cast("double")
    return F.coalesce(F.bround(F.round(mean, 6), 1), F.lit(0.0))


def risk_level(overall: Column, alarm: Column) -> Column:
    """critical for a low overall score or an alarming category, then high, medium and low by the limits."""
    return (
        F.when(alarm | (overall < RISK_LIMITS["critical"]), "critical")
        .when(overall < RISK_LIMITS["high"], "high")
        .when(overall < RISK_LIMITS["medium"], "medium")
        .otherwise("low")
    )


def overall(scores: DataFrame, keys: Sequence[str], category: str = "category", score: str = "score", weight: str = "weight") -> DataFrame:
    """Overall score and risk level per key."""
    low = F.bool_or(F.col(category).isin(ALARM_CATEGORIES) & (F.col(score) < ALARM))
    out = scores.groupBy(*keys).agg(
        weighted_mean(F.col(score), F.col(weight)).alias("overall_score"), F.coalesce(low, F.lit(False)).alias("alarm"), F.count("*").alias("categories")
    )
    return out.withColumn("risk_level", risk_level(F.col("overall_score"), F.col("alarm"))).drop("alarm")
