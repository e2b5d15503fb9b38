"""Scores of categories as expressions over severity counts and metrics, and runs of analyzers that may fail.

A score is data: a base, points for each finding of a severity, points for steps of a metric (the first step that
holds counts), and linear terms with a cap. From it comes one Column; nothing is computed row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.severity import clamp


class Score(NamedTuple):
    base: float
    severities: dict[str, float]
    """Points off for each finding."""
    steps: dict[str, list[tuple[str, float, float]]] = {}
    """Metric to (comparison, limit, points)."""
    linear: list[tuple[str, float, float | None]] = []
    """(metric, points for each unit, cap); with a negative factor the cap bounds what is taken off."""
    defaults: dict[str, float] = {}
    """Metrics that are not 0 where they are missing."""


_COMMON = {"high": 10, "medium": 5, "low": 2}
_LANGUAGE = {"critical": 20, "high": 10, "medium": 5, "low": 1}
# ---- Fixed values: the scores of the categories ----
SCORES = {
    "security": Score(100, {"critical": 20, "high": 8, "medium": 4, "low": 1}),
    "complexity": Score(
        100, _COMMON, {"avg_cc": [(">", 15, -20), (">", 10, -10), (">", 5, -5)], "max_cc": [(">", 30, -15), (">", 20, -10)], "avg_mi": [("<", 40, -20), ("<", 65, -10)]}, defaults={"avg_mi": 100}
    ),
    "testing": Score(
        0, _COMMON,
        {
            "test_files": [(">", 0, 20)],
            "coverage": [(">=", 90, 40), (">=", 80, 35), (">=", 60, 25), (">=", 40, 15), (">", 0, 10)],
            "test_ratio": [(">=", 1, 20), (">=", 0.5, 15), (">=", 0.25, 10)],
            "asserts_per_test": [(">=", 3, 10), (">=", 2, 7), (">=", 1, 5)],
            "mutation": [(">=", 80, 10), (">=", 60, 7), (">=", 40, 5), (">", 0, 3)],
        },
    ),
    "architecture": Score(
        100, {"high": 15, "medium": 8, "low": 3},
        {"clean": [(">", 0, 10)], "injection": [(">", 0, 5)], "repository": [(">", 0, 5)], "layering": [(">", 5, -10), (">", 0, -5)], "instability": [(">", 0.8, -10), (">", 0.6, -5)]},
        [("cycles", -10, None), ("god_modules", -5, None)],
    ),
    "maintainability": Score(
        100, {"high": 8, "medium": 4, "low": 1},
        {
            "avg_length": [(">", 50, -10), (">", 30, -5)], "avg_params": [(">", 5, -5)], "avg_cognitive": [(">", 15, -10), (">", 10, -5)],
            "documented_pct": [("<", 50, -10), ("<", 80, -5)], "typed_pct": [("<", 30, -5)],
        },
        defaults={"documented_pct": 100, "typed_pct": 100},
    ),
    "dependencies": Score(
        100, {"critical": 15, **_COMMON}, {"pinned_share": [(">=", 0.8, 5)]}, [("vulnerabilities", -20, None), ("outdated", -2, None), ("license_issues", -5, None), ("supply_chain", -10, None)]
    ),
    "documentation": Score(
        0, _COMMON, {"has_readme": [(">", 0, 15)]},
        [("readme_quality", 0.3, 15), ("module_doc_pct", 0.15, 15), ("documented_pct", 0.25, 25), ("class_doc_pct", 0.15, 15), ("typed_pct", 0.15, 15)],
    ),
    "git_history": Score(
        50, _COMMON, {"merge_pct": [(">", 10, 5)], "bus_factor": [(">=", 3, 10), (">=", 2, 5)]},
        [("authors", 5, 20), ("recent", 0.5, 15), ("fix_pct", -0.5, None), ("large_commits", -2, None), ("top_changes", -0.2, 10)], {"bus_factor": 1},
    ),
    "javascript": Score(100, _LANGUAGE, {"typescript_files": [(">", 0, 5)]}),
    "java": Score(100, _LANGUAGE),
    "go": Score(100, _LANGUAGE),
    "cpp": Score(100, _LANGUAGE),
}
#: Scores of the first version, on metrics only.
FIRST_SCORES = {
    "complexity": Score(100, {}, {"avg_cc": [(">", 15, -30), (">", 10, -15), (">", 5, -5)], "max_cc": [(">", 30, -20), (">", 20, -10)], "avg_mi": [("<", 50, -25), ("<", 65, -10)]}, defaults={"avg_mi": 100}),
    "security": Score(100, {"high": 15, "medium": 8, "low": 2}),
    "maintainability": Score(100, {}, {"avg_length": [(">", 50, -10)], "avg_methods": [(">", 25, -10)]}, [("long_functions", -3, None), ("large_classes", -5, None), ("duplicate_names", -1, None)]),
    "testing": Score(
        0, {},
        {"test_files": [(">", 0, 30)], "coverage": [(">=", 80, 40), (">=", 50, 25), (">", 0, 10)], "tests_per_file": [(">", 2, 15), (">", 1, 10)], "asserts_per_test": [(">=", 2, 10)], "framework": [(">", 0, 5)]},
    ),
    "dependencies": Score(100, {}, {}, [("vulnerabilities", -20, None), ("outdated", -2, None), ("license_issues", -5, None)]),
    "architecture": Score(100, {}, {"avg_imports": [(">", 15, -10)]}, [("cycles", -15, None), ("god_modules", -5, None), ("layering", -2, None)]),
    "documentation": Score(0, {}, {"has_readme": [(">", 0, 20)]}, [("readme_quality", 0.4, 20), ("documented_pct", 0.3, None), ("class_doc_pct", 0.2, None), ("typed_pct", 0.1, None)]),
    "git_history": Score(50, {}, {}, [("authors", 5, 20), ("recent", 0.5, 15), ("hotspots", -1, None), ("fix_pct", -0.5, None), ("large_commits", -2, None)]),
}
#: The score of a single script: two measures of functions and the share of comments; without files it is 0.
BASELINE = Score(100, {}, {"avg_cc": [(">", 10, -20), (">", 5, -10)], "max_cc": [(">", 20, -15)], "comment_ratio": [("<", 0.1, -10), ("<", 0.2, -5)]})
GATE_RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "none": -1}
# ----------------------------------------------------

_OPS: dict[str, Callable[[Column, float], Column]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b}


def score_column(score: Score, metric: Callable[[str], Column], count: Callable[[str], Column]) -> Column:
    """The score over columns of metrics and severity counts, between 0 and 100 to one decimal; nulls are missing."""
    out = F.lit(float(score.base))
    for severity, points in score.severities.items():
        out = out - F.coalesce(count(severity), F.lit(0)) * float(points)

    def value(name: str) -> Column:
        return F.coalesce(metric(name).cast("double"), F.lit(float(score.defaults.get(name, 0))))

    for name, steps in score.steps.items():
        got = None
        for op, limit, points in steps:
            hit = _OPS[op](value(name), float(limit))
            got = F.when(hit, float(points)) if got is None else got.when(hit, float(points))
        out = out + got.otherwise(0.0)
    for name, factor, cap in score.linear:
        term = value(name) * abs(float(factor))
        term = term if cap is None else F.least(F.lit(float(cap)), term)
        out = out + term if factor > 0 else out - term
    return clamp(F.round(out, 6))


def category_scores(measures: DataFrame, scores: Mapping[str, Score] = SCORES, only: Sequence[str] | None = None) -> DataFrame:
    """``repo, category, score`` for rows of ``repo``, metric columns and ``<category>_<severity>`` counts.

    Columns that the measures lack are missing values. ``only`` names the categories wanted (FLT11). A language
    without files (``<language>_files`` is 0) has 100.
    """
    have = set(measures.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    rows = []
    for category, score in scores.items():
        if only is not None and category not in only:
            continue
        value = score_column(score, column, lambda s, category=category: column(f"{category}_{s}"))
        if f"{category}_files" in have:
            value = F.when(F.coalesce(F.col(f"{category}_files"), F.lit(0)) == 0, 100.0).otherwise(value)
        rows.append(F.struct(F.lit(category).alias("category"), value.alias("score")))
    if not rows:
        return measures.sparkSession.createDataFrame([], "repo string, category string, score double")
    return measures.select("repo", F.explode(F.array(*rows)).alias("s")).select("repo", "s.*")


Analyzer = Callable[[Mapping[str, DataFrame]], DataFrame]
"""EXT1: named tables to ``repo, category, score``."""


def run_analyzers(analyzers: Mapping[str, Analyzer], tables: Mapping[str, DataFrame], repos: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """EXT1, EXT8: ``repo, category, score, error`` of all analyzers; one that fails gives a score of 0 with its error for every repository.

    An analyzer fails when its plan cannot be made or analyzed; the others go on.
    """
    out = None
    for name, analyze in analyzers.items():
        if only is not None and name not in only:
            continue
        try:
            part = analyze(tables).select("repo", F.lit(name).alias("category"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error"))
        except Exception as e:  # noqa: BLE001 - whatever an analyzer does, it ends in its own row
            text = type(e).__name__
            part = repos.select("repo", F.lit(name).alias("category"), F.lit(0.0).alias("score"), F.lit(text).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else repos.sparkSession.createDataFrame([], "repo string, category string, score double, error string")


def run_stages(stages: Sequence[Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]]], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """EXT7: stages in order; those of one stage see the tables of the stages before, not each other.

    What two later steps read is cut once, so that a stage is not computed again for each of them.
    """
    from codestrata.session import cut

    known = dict(tables)
    for n, stage in enumerate(stages):
        made = {name: step(dict(known)) for name, step in stage.items()}
        readers = len(stages[n + 1]) if n + 1 < len(stages) else 0
        known.update({name: cut(df) if readers > 1 else df for name, df in made.items()})
    return known


def gate(risk: Column, fail_on: str) -> Column:
    """SC13: 1 if a risk level reaches the one to fail on, else 0; an unknown level never does."""
    limit = GATE_RANKS.get(fail_on, 0)
    rank = F.lit(4)
    for level, r in GATE_RANKS.items():
        rank = F.when(risk == level, r).otherwise(rank)
    return (rank <= limit).cast("int")


def score_risk(score: Column) -> Column:
    """SC15: low from 80, medium from 60, high from 40, else critical."""
    return F.when(score >= 80, "low").when(score >= 60, "medium").when(score >= 40, "high").otherwise("critical")
