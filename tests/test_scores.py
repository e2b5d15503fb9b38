"""Category scores against stored results and plain arithmetic; analyzers that fail; stages; gates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import category_scores as cs

# Metrics and finding counts of a stored result, and the scores that it holds.
STORED = {
    "complexity": ({"complexity_medium": 1, "avg_cc": 3.7395, "max_cc": 7, "avg_mi": 54.5}, 85.0),
    "security": ({}, 100.0),
    "testing": ({"testing_medium": 12, "test_files": 1, "coverage": 100.0, "test_ratio": 1.0, "asserts_per_test": 0.0, "mutation": 0.0}, 20.0),
    "architecture": ({"instability": 0.5, "cycles": 0, "god_modules": 0, "layering": 0}, 100.0),
    "maintainability": ({"avg_length": 7.3, "avg_params": 1.1, "avg_cognitive": 1.8, "documented_pct": 29.4, "typed_pct": 29.4}, 85.0),
    "dependencies": ({"vulnerabilities": 0, "outdated": 0, "license_issues": 0}, 100.0),
    "documentation": ({"documentation_medium": 17, "documentation_high": 1, "documented_pct": 29.4, "class_doc_pct": 20.0, "typed_pct": 29.4}, 0.0),
    "git_history": ({"authors": 0}, 50.0),
}


@pytest.mark.parametrize("category", sorted(STORED))
def test_stored_scores(spark, category):
    measures, want = STORED[category]
    names = list(measures)
    df = spark.createDataFrame([("r", *(float(measures[n]) for n in names))], ", ".join(["repo string", *(f"{n} double" for n in names)]))
    assert [tuple(r) for r in cs.category_scores(df, only=[category]).collect()] == [("r", category, want)]


def plain(score, category, m):
    out = float(score.base) - sum(p * (m.get(f"{category}_{s}") or 0) for s, p in score.severities.items())
    value = lambda n: m[n] if m.get(n) is not None else score.defaults.get(n, 0)
    for name, steps in score.steps.items():
        for op, limit, points in steps:
            if {">": value(name) > limit, ">=": value(name) >= limit, "<": value(name) < limit}[op]:
                out += points
                break
    for name, factor, cap in score.linear:
        term = abs(factor) * value(name)
        out += (1 if factor > 0 else -1) * (term if cap is None else min(cap, term))
    return max(0.0, min(100.0, round(round(out, 6), 1)))


@pytest.mark.parametrize("scores", [cs.SCORES, cs.FIRST_SCORES])
def test_scores_against_plain_arithmetic(spark, scores):
    rng = random.Random(1)
    names = sorted({n for s in scores.values() for n in (*s.steps, *(x[0] for x in s.linear))} | {f"{c}_{x}" for c, s in scores.items() for x in s.severities})
    rows = [{n: rng.choice([None, 0.0, 0.5, 1.0, 3.0, 12.0, 29.0, 66.0, 85.0]) if "_" in n or rng.random() < 0.8 else None for n in names} for _ in range(40)]
    rows = [{n: (v if not any(n.endswith(f"_{x}") for x in ("critical", "high", "medium", "low")) or v is None else float(min(v, 3))) for n, v in r.items()} for r in rows]
    df = spark.createDataFrame([(str(i), *(r[n] for n in names)) for i, r in enumerate(rows)], ", ".join(["repo string", *(f"{n} double" for n in names)]))
    for r in cs.category_scores(df, scores).collect():
        assert r.score == pytest.approx(plain(scores[r.category], r.category, rows[int(r.repo)]), abs=0.11), (r, rows[int(r.repo)])


def test_languages_without_files_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, None), ("b", 2, 3.0)], "repo string, java_files int, java_high double")
    assert {(r.repo, r.score) for r in cs.category_scores(df, only=["java"]).collect()} == {("a", 100.0), ("b", 70.0)}
    assert cs.category_scores(df.limit(0)).count() == 0 and cs.category_scores(df, only=[]).count() == 0


def test_analyzers_that_fail_and_stages(spark):
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    analyzers = {"good": lambda t: t["repos"].withColumn("score", F.lit(70)), "bad": lambda t: t["missing"], "worse": lambda t: t["repos"].select("nothing")}
    got = sorted(tuple(r) for r in cs.run_analyzers(analyzers, {"repos": repos}, repos).collect())
    assert got == [("a", "bad", 0.0, "KeyError"), ("a", "good", 70.0, None), ("a", "worse", 0.0, "AnalysisException"), ("b", "bad", 0.0, "KeyError"), ("b", "good", 70.0, None), ("b", "worse", 0.0, "AnalysisException")]
    assert cs.run_analyzers(analyzers, {"repos": repos}, repos, only=[]).count() == 0
    out = cs.run_stages([{"x": lambda t: t["repos"].withColumn("n", F.lit(1))}, {"y": lambda t: t["x"].agg(F.sum("n").alias("n")), "z": lambda t: t["x"].filter("repo = 'a'")}], {"repos": repos})
    assert out["y"].first().n == 2 and out["z"].count() == 1
    with pytest.raises(KeyError):
        cs.run_stages([{"x": lambda t: t["repos"], "y": lambda t: t["x"]}], {"repos": repos})


def test_gate_and_risk(spark):
    df = spark.createDataFrame([("critical", 20.0), ("high", 45.0), ("medium", 65.0), ("low", 90.0), ("odd", None)], "risk string, score double")
    got = {r.risk: (r.g, r.n, r.s) for r in df.select("risk", cs.gate(F.col("risk"), "high").alias("g"), cs.gate(F.col("risk"), "none").alias("n"), cs.score_risk(F.col("score")).alias("s")).collect()}
    assert got == {"critical": (1, 0, "critical"), "high": (1, 0, "high"), "medium": (0, 0, "medium"), "low": (0, 0, "low"), "odd": (0, 0, "critical")}
