"""Scores of categories from the tables.

Metrics come from the last snapshot's findings, the files and the documents of a repository. Where the tables
lack a metric a stated one stands for it: the means of the metric findings for lengths, parameters and nesting,
``100 - 5 * nesting`` for maintainability, the testing score for coverage, and change notes for commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import basename, extension, is_test_file
from codestrata.operators import category_scores as cs
from codestrata.operators.scan import pattern_counts
from codestrata.operators.scoring import default_weight, overall, risk_level, weighted_mean
from codestrata.plans.q_findings import _LAST, _NOW, _OVERALL, _S, _findings, _scores, last_snapshots
from codestrata.plans.q_scan import _TEST, _oracle_spots
from codestrata.plans.samples import files_and_samples
from codestrata.session import table

SEVERITIES = ["critical", "high", "medium", "low"]
FOUND = ["security", "complexity", "testing", "architecture", "maintainability", "dependencies", "documentation", "git_history"]


def _mean(name: str, condition: Column) -> Column:
    x = F.when(condition, F.col(name)).cast("decimal(18,4)")
    return (F.sum(x).cast("double") / F.count(x))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every repository with the counts and metrics of all categories."""
    last = last_snapshots(spark, sf_dir)
    rule = lambda r: F.col("rule_id") == r
    found = _findings(spark, sf_dir, last).groupBy("repo").agg(
        *[F.count_if((F.col("category") == c) & (F.col("severity") == s)).alias(f"{c}_{s}") for c in FOUND for s in SEVERITIES],
        _mean("metric_value", rule("high-cyclomatic")).alias("avg_cc"), F.max(F.when(rule("high-cyclomatic"), F.col("metric_value"))).alias("max_cc"),
        (100 - 5 * _mean("metric_value", rule("deep-nesting"))).alias("avg_mi"), _mean("metric_value", rule("deep-nesting")).alias("avg_cognitive"),
        _mean("metric_value", rule("large-class")).alias("avg_length"), _mean("metric_value", rule("too-many-parameters")).alias("avg_params"),
        F.count_if(rule("layer-breach")).alias("layering"), F.count_if(rule("large-class") & (F.col("metric_value") > 40)).alias("god_modules"),
        F.count_if(rule("loose-pin") & (F.col("severity") == "critical")).alias("vulnerabilities"), F.count_if(rule("loose-pin")).alias("outdated"),
        F.count_if(rule("license-unknown")).alias("license_issues"), F.count_if(rule("large-class")).alias("large_classes"), F.count_if(rule("missing-docstring")).alias("undocumented"),
    )
    py = extension("path") == "py"
    text = F.coalesce("content", F.lit(""))
    has = lambda rx: F.count_if(F.col("path").rlike(rx))
    files = table(spark, sf_dir, "files").groupBy("repo").agg(
        F.count_if(is_test_file("path")).alias("test_files"), F.count_if(~is_test_file("path")).alias("source_files"), F.count_if(py).alias("py_files"),
        F.sum(F.when(py, F.regexp_count(text, F.lit(r"\bassert"))).otherwise(0)).alias("asserts"), F.sum(F.when(py, F.regexp_count(text, F.lit(r"\bdef test"))).otherwise(0)).alias("tests"),
        F.count_if(py & F.contains(text, F.lit("->"))).alias("typed"), F.count_if(F.contains(text, F.lit("pytest"))).alias("framework"), has(r"(^|/)domain/").alias("clean"), has(r"repositor").alias("repository"),
        has(r"inject|container").alias("injection"), F.count_if(basename("path").rlike(r"^(?i:poetry\.lock|package-lock\.json)$")).alias("locks"),
    )
    notes = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND repo IS NOT NULL")
    note = F.col("source") == "commit_note"
    newest = notes.agg(F.max("created_at")).first()[0]
    history = notes.groupBy("repo").agg(
        F.count_if(F.col("source") == "readme").alias("has_readme"), F.count_if(note).alias("notes"), F.countDistinct(F.when(note, F.lower(F.trim("lang")))).alias("authors"),
        F.count_if(note & (F.col("created_at") >= F.lit(newest) - F.expr("INTERVAL 30 DAYS"))).alias("recent"), F.count_if(note & F.contains(F.lower("text"), F.lit("fix"))).alias("fixes"),
        F.count_if(note & (F.col("n_chars") > 600)).alias("large_commits"),
    )
    coverage = _scores(spark, sf_dir, last).filter("category = 'testing'").select("repo", F.col("score").alias("coverage"))
    m = files.join(found, "repo", "full").join(history, "repo", "full").join(coverage, "repo", "left")
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return m.withColumns(
        {
            "test_ratio": F.col("test_files") / F.greatest("source_files", F.lit(1)), "asserts_per_test": F.col("asserts") / F.greatest("tests", F.lit(1)), "tests_per_file": share("tests", "source_files"),
            "instability": share("source_files", "py_files") / 3, "documented_pct": F.greatest(F.lit(0.0), 100 - 100 * share("undocumented", "py_files") / 10), "typed_pct": 100 * share("typed", "py_files"),
            "pinned_share": share("locks", "outdated"), "fix_pct": 100 * share("fixes", "notes"),
        }
    )


def sc2_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1-SC8, EXT1: scores of the eight categories of every repository."""
    return cs.category_scores(measures(spark, sf_dir), {c: cs.SCORES[c] for c in FOUND})


def sc9_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: scores of the languages from the scans of their files, 100 where there are none."""
    files = files_and_samples(spark, sf_dir)
    counts = pattern_counts(files, ["repo"])
    languages = ["javascript", "java", "go", "cpp"]
    from codestrata.operators.patterns import SUFFIXES

    c = counts.groupBy("repo").agg(*[F.sum(F.when((F.col("language") == g) & (F.col("severity") == s), F.col("n")).otherwise(0)).alias(f"{g}_{s}") for g in languages for s in SEVERITIES])
    n = files.groupBy("repo").agg(*[F.count_if(extension("path").isin(SUFFIXES[g])).alias(f"{g}_files") for g in languages], F.count_if(extension("path").isin("ts", "tsx")).alias("typescript_files"))
    return cs.category_scores(n.join(c, "repo", "left"), {g: cs.SCORES[g] for g in languages})


def sc18_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: scores of the first version."""
    return cs.category_scores(measures(spark, sf_dir), cs.FIRST_SCORES)


def flt11_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: the scores of two chosen categories."""
    return cs.category_scores(measures(spark, sf_dir), cs.SCORES, only=["security", "testing"])


def ext8_failed_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT1, EXT8: analyzers of which one fails; it has a row with a score of 0 and its error for every repository."""
    m = measures(spark, sf_dir)
    analyzers = {c: lambda t, c=c: cs.category_scores(t["measures"], only=[c]) for c in ("security", "complexity")}
    analyzers["broken"] = lambda t: t["measures"].select("no_such_column")
    return cs.run_analyzers(analyzers, {"measures": m}, m.select("repo"))


def ext7_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT7: measures, then scores, then the overall score and the alarms beside each other."""
    weight = default_weight(F.col("category"))
    stages = [
        {"scores": lambda t: cs.category_scores(t["measures"], {c: cs.SCORES[c] for c in FOUND})},
        {
            "overall": lambda t: t["scores"].groupBy("repo").agg(weighted_mean(F.col("score"), weight).alias("overall_score")),
            "alarms": lambda t: t["scores"].filter("category IN ('security', 'architecture') AND score < 40").groupBy("repo").agg(F.count("*").alias("alarms")),
        },
    ]
    t = cs.run_stages(stages, {"measures": measures(spark, sf_dir)})
    return t["overall"].join(t["alarms"], "repo", "left").na.fill(0, ["alarms"]).withColumn("risk_level", risk_level(F.col("overall_score"), F.col("alarms") > 0))


def sc13_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13: exit codes of every repository's last snapshot for each level to fail on."""
    o = overall(_scores(spark, sf_dir, last_snapshots(spark, sf_dir)), ["repo"])
    levels = F.array(*[F.struct(F.lit(x).alias("fail_on"), cs.gate(F.col("risk_level"), x).alias("exit_code")) for x in ("critical", "high", "medium", "low", "none")])
    return o.select("repo", "risk_level", F.explode(levels).alias("g")).select("repo", "risk_level", "g.*")


def sc14_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14, SC15: the single-script score of a repository's Python files and its risk; 0 without files."""
    py = table(spark, sf_dir, "files").filter((extension("path") == "py") & F.col("content").isNotNull())
    lines = F.split("content", "\n", -1)
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")
    per = py.select(
        "repo", F.size(F.filter(lines, lambda x: strip(x).startswith("#"))).alias("comments"), F.size(F.filter(lines, lambda x: (strip(x) != "") & ~strip(x).startswith("#"))).alias("code"),
        F.regexp_count("content", F.lit(r"(?m)^\s*(?:if|for|while|elif|except)\b")).alias("branches"), F.regexp_count("content", F.lit(r"(?m)^\s*(?:async )?def ")).alias("functions"),
    )
    p = per.groupBy("repo").agg(
        F.count("*").alias("files"), (F.sum("comments") / F.greatest(F.sum("code"), F.lit(1))).alias("comment_ratio"),
        (F.sum("branches") / F.greatest(F.sum("functions"), F.lit(1)) + 1).alias("avg_cc"), F.max(F.col("branches") + 1).alias("max_cc"),
    )
    every = table(spark, sf_dir, "files").select("repo").distinct().join(p, "repo", "left")
    value = F.when(F.col("files").isNull(), 0.0).otherwise(cs.score_column(cs.BASELINE, F.col, lambda s: F.lit(0)))
    return every.select("repo", F.coalesce("files", F.lit(0)).alias("files"), value.alias("score")).withColumn("risk", cs.score_risk(F.col("score")))


QUERIES = {f.__name__: f for f in (sc2_category_scores, sc9_language_scores, sc18_first_version, flt11_chosen, ext8_failed_analyzers, ext7_stages, sc13_gate, sc14_baseline)}


def _score_sql(score: cs.Score, category: str, have: set[str]) -> str:
    parts = [f"{score.base}.0"]
    parts += [f"- {p} * coalesce({category}_{s}, 0)" for s, p in score.severities.items() if f"{category}_{s}" in have]

    def value(name: str) -> str:
        return f"coalesce({name}, {score.defaults.get(name, 0)})" if name in have else str(score.defaults.get(name, 0))

    for name, steps in score.steps.items():
        parts.append("+ CASE " + " ".join(f"WHEN {value(name)} {op} {limit} THEN {points}" for op, limit, points in steps) + " ELSE 0 END")
    for name, factor, cap in score.linear:
        term = f"{abs(factor)} * {value(name)}::DOUBLE"
        parts.append(("+ " if factor > 0 else "- ") + (term if cap is None else f"least({cap}, {term})"))
    return f"greatest(0.0, least(100.0, round_even(round(({' '.join(parts)})::DOUBLE, 6), 1)))"


_COUNTS = [f"{c}_{s}" for c in FOUND for s in SEVERITIES]
_METRICS = (
    "avg_cc max_cc avg_mi avg_cognitive avg_length avg_params layering god_modules vulnerabilities outdated license_issues large_classes test_files has_readme authors recent large_commits framework clean repository "
    "injection coverage test_ratio asserts_per_test tests_per_file instability documented_pct typed_pct pinned_share fix_pct"
).split()
_HAVE = set(_COUNTS) | set(_METRICS)
_PYF = "regexp_matches(path, '\\.(?i:py)$')"


def _avg(rule: str) -> str:
    x = f"CASE WHEN rule_id = '{rule}' THEN metric_value END::DECIMAL(18,4)"
    return f"sum({x})::DOUBLE / count({x})"


_MEASURES = f"""{_S}, {_NOW},
fo AS (SELECT repo, {", ".join(f"count(*) FILTER (category = '{c}' AND severity = '{s}') AS {c}_{s}" for c in FOUND for s in SEVERITIES)},
  {_avg('high-cyclomatic')} AS avg_cc, max(metric_value) FILTER (rule_id = 'high-cyclomatic') AS max_cc, 100 - 5 * ({_avg('deep-nesting')}) AS avg_mi, {_avg('deep-nesting')} AS avg_cognitive, {_avg('large-class')} AS avg_length,
  {_avg('too-many-parameters')} AS avg_params, count(*) FILTER (rule_id = 'layer-breach') AS layering, count(*) FILTER (rule_id = 'large-class' AND metric_value > 40) AS god_modules,
  count(*) FILTER (rule_id = 'loose-pin' AND severity = 'critical') AS vulnerabilities, count(*) FILTER (rule_id = 'loose-pin') AS outdated, count(*) FILTER (rule_id = 'license-unknown') AS license_issues,
  count(*) FILTER (rule_id = 'large-class') AS large_classes, count(*) FILTER (rule_id = 'missing-docstring') AS undocumented FROM c0 GROUP BY 1),
fi AS (SELECT repo, count(*) FILTER ({_TEST}) AS test_files, count(*) FILTER (NOT {_TEST}) AS source_files, count(*) FILTER ({_PYF}) AS py_files, coalesce(sum(len(regexp_extract_all(content, '\\bassert'))) FILTER ({_PYF}), 0) AS asserts,
  coalesce(sum(len(regexp_extract_all(content, '\\bdef test'))) FILTER ({_PYF}), 0) AS tests, count(*) FILTER ({_PYF} AND contains(content, '->')) AS typed, count(*) FILTER (contains(content, 'pytest')) AS framework,
  count(*) FILTER (regexp_matches(path, '(^|/)domain/')) AS clean, count(*) FILTER (contains(path, 'repositor')) AS repository, count(*) FILTER (regexp_matches(path, 'inject|container')) AS injection,
  count(*) FILTER (regexp_matches(path, '(^|/)(?i:poetry\\.lock|package-lock\\.json)$')) AS locks FROM files GROUP BY 1),
nt AS (SELECT * FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL),
hi AS (SELECT repo, count(*) FILTER (source = 'readme') AS has_readme, count(*) FILTER (source = 'commit_note') AS notes, count(DISTINCT lower(trim(lang))) FILTER (source = 'commit_note') AS authors,
  count(*) FILTER (source = 'commit_note' AND created_at >= (SELECT max(created_at) FROM nt) - INTERVAL 30 DAYS) AS recent, count(*) FILTER (source = 'commit_note' AND contains(lower(text), 'fix')) AS fixes,
  count(*) FILTER (source = 'commit_note' AND n_chars > 600) AS large_commits FROM nt GROUP BY 1),
me AS (SELECT *, test_files / greatest(source_files, 1) AS test_ratio, asserts / greatest(tests, 1) AS asserts_per_test, tests / nullif(source_files, 0) AS tests_per_file, source_files / nullif(py_files, 0) / 3 AS instability,
  CASE WHEN undocumented IS NOT NULL AND py_files > 0 THEN greatest(0.0, 100 - 100 * (undocumented / py_files) / 10) WHEN true THEN 0.0 END AS documented_pct, 100 * (typed / nullif(py_files, 0)) AS typed_pct, locks / nullif(outdated, 0) AS pinned_share,
  100 * (fixes / nullif(notes, 0)) AS fix_pct
  FROM fi FULL JOIN fo USING (repo) FULL JOIN hi USING (repo) LEFT JOIN (SELECT s.repo, score AS coverage FROM s JOIN l USING (repo, snapshot_no) WHERE category = 'testing') USING (repo))"""


def _rows(scores: dict[str, cs.Score]) -> str:
    return " UNION ALL ".join(f"SELECT repo, '{c}' AS category, {_score_sql(s, c, _HAVE)} AS score FROM me" for c, s in scores.items())


_EIGHT = _rows({c: cs.SCORES[c] for c in FOUND})
_LANGS = ["javascript", "java", "go", "cpp"]


def _languages() -> str:
    from codestrata.operators.patterns import SUFFIXES

    have = {f"{g}_{s}" for g in _LANGS for s in SEVERITIES} | {"typescript_files"}
    ext = r"lower(regexp_extract(name, '\.([^.]*)$', 1))"
    counts = ", ".join(f"count(*) FILTER (language = '{g}' AND severity = '{s}') AS {g}_{s}" for g in _LANGS for s in SEVERITIES)
    files = ", ".join(f"count(*) FILTER ({ext} IN ({', '.join(repr(e) for e in SUFFIXES[g])})) AS {g}_files" for g in _LANGS)
    rows = " UNION ALL ".join(f"SELECT repo, '{g}' AS category, CASE WHEN {g}_files = 0 THEN 100.0 ELSE {_score_sql(cs.SCORES[g], g, have)} END AS score FROM lf LEFT JOIN lc USING (repo)" for g in _LANGS)
    return _oracle_spots(f", lc AS (SELECT repo, {counts} FROM fin GROUP BY 1), lf AS (SELECT repo, {files}, count(*) FILTER ({ext} IN ('ts', 'tsx')) AS typescript_files FROM x GROUP BY 1) {rows}")


_WEIGHTS = "CASE category WHEN 'complexity' THEN 2.0 WHEN 'security' THEN 3.0 WHEN 'testing' THEN 2.0 WHEN 'architecture' THEN 2.0 WHEN 'maintainability' THEN 1.5 WHEN 'documentation' THEN 0.5 WHEN 'git_history' THEN 0.5 ELSE 1.0 END"
ORACLES = {
    "sc2_category_scores": f"WITH {_MEASURES} {_EIGHT}",
    "sc9_language_scores": _languages(),
    "sc18_first_version": f"WITH {_MEASURES} {_rows(cs.FIRST_SCORES)}",
    "flt11_chosen": f"WITH {_MEASURES} {_rows({c: cs.SCORES[c] for c in ('security', 'testing')})}",
    "ext8_failed_analyzers": f"WITH {_MEASURES}, r AS ({_rows({c: cs.SCORES[c] for c in ('security', 'complexity')})}) SELECT repo, category, score, NULL::VARCHAR AS error FROM r UNION ALL SELECT repo, 'broken', 0.0, 'AnalysisException' FROM me",
    "ext7_stages": f"""WITH {_MEASURES}, r AS ({_EIGHT}), o AS (SELECT repo, coalesce(round_even(round(sum(score::DECIMAL(12,4) * ({_WEIGHTS})::DECIMAL(8,4)) FILTER (score > 0)::DOUBLE / sum(({_WEIGHTS})::DECIMAL(8,4)) FILTER (score > 0)::DOUBLE, 6), 1), 0.0) AS overall_score,
  count(*) FILTER (category IN ('security', 'architecture') AND score < 40) AS alarms FROM r GROUP BY 1)
SELECT repo, overall_score, alarms, CASE WHEN alarms > 0 OR overall_score < 35 THEN 'critical' WHEN overall_score < 55 THEN 'high' WHEN overall_score < 75 THEN 'medium' ELSE 'low' END AS risk_level FROM o""",
    "sc13_gate": f"""WITH {_S}, {_OVERALL}, {_LAST}, g(fail_on, k) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('none', -1))
SELECT repo, risk_level, fail_on, (CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END <= k)::INTEGER AS exit_code FROM r SEMI JOIN l USING (repo, snapshot_no), g""",
    "sc14_baseline": rf"""WITH p AS (SELECT file_id, repo, content FROM files WHERE content IS NOT NULL AND {_PYF}),
ln AS (SELECT file_id, trim(l, E' \t\r\f') AS l FROM (SELECT file_id, unnest(string_split(content, E'\n')) AS l FROM p)),
c AS (SELECT file_id, count(*) FILTER (starts_with(l, '#')) AS comments, count(*) FILTER (l <> '' AND NOT starts_with(l, '#')) AS code FROM ln GROUP BY 1),
q AS (SELECT repo, comments, code, len(regexp_extract_all(content, '(?m)^\s*(?:if|for|while|elif|except)\b')) AS b, len(regexp_extract_all(content, '(?m)^\s*(?:async )?def ')) AS f FROM p JOIN c USING (file_id)),
a AS (SELECT repo, count(*) AS files, sum(comments) / greatest(sum(code), 1) AS comment_ratio, sum(b) / greatest(sum(f), 1) + 1 AS avg_cc, max(b + 1) AS max_cc FROM q GROUP BY 1),
s AS (SELECT repo, coalesce(files, 0) AS files, CASE WHEN files IS NULL THEN 0.0 ELSE {_score_sql(cs.BASELINE, 'x', {'avg_cc', 'max_cc', 'comment_ratio'})} END AS score FROM (SELECT DISTINCT repo FROM files) LEFT JOIN a USING (repo))
SELECT *, CASE WHEN score >= 80 THEN 'low' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'high' ELSE 'critical' END AS risk FROM s""",
}
