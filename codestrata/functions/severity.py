"""Columns over severities and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ----
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
ANNOTATION_LEVELS = {"critical": "failure", "high": "failure", "medium": "warning", "low": "notice", "info": "notice"}
LINTER_SEVERITIES = {1: "low", 2: "high"}
# ----------------------


def lookup(c: Column, table: dict, default: object = None) -> Column:
    """A small fixed table as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def clean(severity: Column | str) -> Column:
    """Severity in lower case without outer white space."""
    return F.lower(F.trim(severity))


def rank(severity: Column) -> Column:
    """0 for critical to 3 for low; anything else 4."""
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES[:4])}, 4)


def sarif_level(severity: Column) -> Column:
    return lookup(severity, SARIF_LEVELS, "warning")


def annotation_level(severity: Column) -> Column:
    return lookup(severity, ANNOTATION_LEVELS, "notice")


def cvss_severity(score: Column) -> Column:
    """Severity of a CVSS score given as number or text; null if it is neither."""
    x = score.try_cast("double")
    return F.when(x >= 9, "critical").when(x >= 7, "high").when(x >= 4, "medium").when(x.isNotNull(), "low")


def status(score: Column, ok: float = 70, warn: float = 40, names: tuple[str, str, str] = ("OK", "WARN", "FAIL")) -> Column:
    return F.when(score >= ok, names[0]).when(score >= warn, names[1]).otherwise(names[2])


def threshold_status(value: Column, threshold: Column) -> Column:
    """pass up to the threshold, fail beyond one and a half times it."""
    return F.when(value > 1.5 * threshold, "fail").when(value > threshold, "warn").otherwise("pass")


def clamp(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """A score between its bounds, to one decimal (half even)."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.bround(score, 1)))
