"""Scores, comparisons, policies and report rows over findings and category scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import severity as sev
from codestrata.operators.compare import change_type, full_diff, latest
from codestrata.operators.scoring import STRONG, WEAK, default_weight, overall, weighted_mean
from codestrata.session import broadcast_if_small, table


def _scores(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """WIN4: the latest delivery of every score, or of those in the (repo, snapshot_no) ``of``."""
    s = table(spark, sf_dir, "category_scores")
    s = s if of is None else s.join(of, ["repo", "snapshot_no"], "left_semi")
    return latest(s, ["repo", "snapshot_no", "category"], F.desc("loaded_at"), F.desc("row_id"))


def _findings(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    f = table(spark, sf_dir, "findings")
    f = f if of is None else f.join(of, ["repo", "snapshot_no"], "left_semi")
    path = F.coalesce(F.regexp_replace(F.translate("file_path", "\\", "/"), r"^(\./)+", ""), F.lit(""))
    f = f.withColumn("severity", sev.clean("severity")).withColumn("file_path", path).withColumn("line_start", F.coalesce("line_start", F.lit(-1)))
    return latest(f, ["repo", "snapshot_no", "category", "rule_id", "file_path", "line_start"], F.desc("loaded_at"), F.desc("row_id"))


_S = """s AS (SELECT * FROM category_scores QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, category ORDER BY loaded_at DESC, row_id DESC) = 1)"""
_F = r"""f AS (SELECT * REPLACE (lower(trim(severity)) AS severity, coalesce(regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), '') AS file_path, coalesce(line_start, -1) AS line_start) FROM findings
  QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, category, rule_id, coalesce(regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), ''), coalesce(line_start, -1) ORDER BY loaded_at DESC, row_id DESC) = 1)"""
_MEAN = """coalesce(round_even(round((sum(score::DECIMAL(12,4) * weight::DECIMAL(8,4)) FILTER (score > 0))::DOUBLE / nullif((sum(weight::DECIMAL(8,4)) FILTER (score > 0))::DOUBLE, 0), 6), 1), 0.0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, snapshot_no`` that a repository has in either table."""
    return table(spark, sf_dir, "findings").select("repo", "snapshot_no").unionByName(table(spark, sf_dir, "category_scores").select("repo", "snapshot_no")).distinct()


def last_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, snapshot_no``: the last snapshot of every repository."""
    return broadcast_if_small(_snapshots(spark, sf_dir).groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, previous, snapshot_no``: consecutive snapshots of every repository; a repository has few."""
    previous = F.lag("snapshot_no").over(Window.partitionBy("repo").orderBy("snapshot_no"))
    return broadcast_if_small(_snapshots(spark, sf_dir).withColumn("previous", previous).filter("previous IS NOT NULL"))


def _last_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, of=last_snapshots(spark, sf_dir))


def _beside(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as before and after of consecutive snapshots, both under the number of the later one."""
    before = rows.withColumnRenamed("snapshot_no", "previous").join(pairs, ["repo", "previous"]).drop("previous")
    return before, rows.join(pairs.drop("previous"), ["repo", "snapshot_no"])


def _exact_mean(name: str) -> Column:
    """A mean whose sum does not depend on the order of the rows."""
    return F.sum(F.col(name).cast("decimal(18,6)")).cast("double") / F.count(name)


def agg1_overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, SC10, SC11: weighted score over non-zero categories, and the risk level, per repository and snapshot."""
    return overall(_scores(spark, sf_dir), ["repo", "snapshot_no"])


def jn19_default_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: the same mean with the configured weights, 1.0 for categories without one."""
    s = _scores(spark, sf_dir).withColumn("weight", default_weight(F.col("category")))
    return s.groupBy("repo", "snapshot_no").agg(weighted_mean(F.col("score"), F.col("weight")).alias("overall_score"))


def sc12_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12, TOP5, TOP7: the first three strengths and weaknesses of a snapshot, by score."""
    s = _scores(spark, sf_dir).filter("score IS NOT NULL AND NOT isnan(score)")
    # order by score, then by name, as one sortable array; a repository has few categories
    named = lambda cond, sign: F.array_join(
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct((sign * F.col("score")).alias("k"), F.col("category").alias("c"))))), lambda x: x["c"]), 1, 3), ", "
    )
    return s.groupBy("repo", "snapshot_no").agg(named(F.col("score") >= STRONG, -1).alias("strengths"), named(F.col("score") < WEAK, 1).alias("weaknesses"))


def set1_new_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: strengths that the snapshot before did not have (EXCEPT)."""
    strong = _scores(spark, sf_dir).filter(F.col("score") >= STRONG).select("repo", "snapshot_no", "category")
    before, after = _beside(strong, _pairs(spark, sf_dir))
    cols = ["repo", "snapshot_no", "category"]
    return after.select(cols).subtract(before.select(cols))


def jn1_category_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, SC16, JN4, SC17: full outer comparison of consecutive snapshots with change types and regression flags."""
    d = full_diff(*_beside(_scores(spark, sf_dir).filter("score IS NOT NULL"), _pairs(spark, sf_dir)), ["repo", "snapshot_no", "category"], "score")
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    return d.select("repo", "snapshot_no", "category", "before", "after", F.bround(delta, 1).alias("delta"), change_type(F.col("before"), F.col("after")).alias("change"), (delta < -5.0).alias("regressed"))


def agg19_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: numbers of categories by change type, each counted once."""
    return jn1_category_diff(spark, sf_dir).groupBy("repo", "snapshot_no", "change").agg(F.count("*").alias("n"))


def jn2_finding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: findings of consecutive snapshots by composite key (rule, file, line, severity, first 50 characters of the message)."""
    key = F.concat_ws("|", "rule_id", "file_path", F.col("line_start").cast("string"), "severity", F.substring(F.coalesce("message", F.lit("")), 1, 50))
    f = _findings(spark, sf_dir).select("repo", key.alias("key"), "snapshot_no", "row_id")
    d = full_diff(*_beside(f, _pairs(spark, sf_dir)), ["repo", "snapshot_no", "key"], "row_id")
    status = F.when(F.col("in_before") == 0, "new").when(F.col("in_after") == 0, "fixed").otherwise("unchanged")
    return d.groupBy("repo", "snapshot_no", status.alias("status")).agg(F.count("*").alias("findings"))


def jn3_metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: the largest metric value per repository and rule in consecutive snapshots, side by side."""
    f = _findings(spark, sf_dir).filter("metric_value IS NOT NULL").withColumn("metric_value", F.round("metric_value", 1))
    return full_diff(*_beside(f, _pairs(spark, sf_dir)), ["repo", "snapshot_no", "rule_id"], "metric_value").drop("in_before", "in_after")


def win7_score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: change of each score against the snapshot before."""
    w = Window.partitionBy("repo", "category").orderBy("snapshot_no")
    s = _scores(spark, sf_dir).filter("score IS NOT NULL").withColumn("previous", F.lag("score").over(w))
    return s.select("repo", "category", "snapshot_no", F.bround(F.col("score") - F.col("previous"), 1).alias("delta"))


def agg2_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG4, AGG17, SC1: security findings of the last snapshot by severity and confidence, distinct weaknesses, score."""
    f = _last_findings(spark, sf_dir).filter("category = 'security'")
    out = f.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in sev.SEVERITIES],
        *[F.count_if(F.col("confidence") == c).alias(f"confidence_{c}") for c in ("high", "medium", "low")],
        F.countDistinct("cwe").alias("weaknesses"),
    )
    penalty = 20 * F.col("critical") + 8 * F.col("high") + 4 * F.col("medium") + F.col("low")
    return out.withColumn("score", sev.clamp((100 - penalty).cast("double")))


def agg3_top_cwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: the most frequent weakness of a repository; ties go to the one seen first."""
    f = _last_findings(spark, sf_dir).filter("cwe IS NOT NULL")
    counts = f.groupBy("repo", "cwe").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    return latest(counts, ["repo"], F.desc("n"), F.asc("first")).select("repo", "cwe", "n")


def agg18_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, PRJ2: counts by rule as one sorted map, rendered as text."""
    counts = _last_findings(spark, sf_dir).groupBy("repo", "category", "rule_id").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "rule_id", F.col("n").cast("string"))))
    return counts.groupBy("repo", "category").agg(F.array_join(entries, ",").alias("rules"))


def top3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP3: the twenty worst findings of the last snapshot over all repositories (a top-k report)."""
    f = _last_findings(spark, sf_dir).withColumn("rank", sev.rank(F.col("severity")))
    return f.orderBy("rank", "row_id").limit(20).select("row_id", "repo", "rule_id", "severity", "rank")


def top8_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10, TOP8, PRJ4, D27: at most fifty annotations per repository, worst first (a feature of the report)."""
    f = _last_findings(spark, sf_dir).filter("file_path <> ''")
    w = Window.partitionBy("repo").orderBy(sev.rank(F.col("severity")), "row_id")
    rows = f.withColumn("n", F.row_number().over(w)).filter("n <= 50")
    return rows.select(
        "repo", "n", F.col("file_path").alias("path"), F.greatest("line_start", F.lit(1)).alias("start_line"), sev.annotation_level(F.col("severity")).alias("level"),
        F.substring(F.coalesce("message", "title", F.lit("")), 1, 65535).alias("message"),
    )


def snk2_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, WIN3, PRJ3: rule numbers by first appearance within a repository, with level and number of results."""
    f = _last_findings(spark, sf_dir)
    rules = f.groupBy("repo", "rule_id").agg(F.min("row_id").alias("first"), F.count("*").alias("results"), F.min(sev.rank(F.col("severity"))).alias("rank"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy("first"))
    level = F.when(F.col("rank") <= 1, "error").when(F.col("rank") == 2, "warning").otherwise("note")
    return rules.select("repo", "rule_id", F.concat(F.lit("CA"), F.lpad(n.cast("string"), 4, "0")).alias("number"), "results", level.alias("level"))


def prj1_flat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, FLT4, TOP4: critical and high findings of the last snapshot, stamped with their category's score."""
    s = _scores(spark, sf_dir, last_snapshots(spark, sf_dir)).select("repo", "category", "score")
    f = _last_findings(spark, sf_dir).filter(F.col("severity").isin("critical", "high"))
    return f.join(s, ["repo", "category"], "left").groupBy("repo", "category", "score").agg(F.count("*").alias("findings"))


# ---- Fixed values: limits of the built-in policies ----
HIGH_LIMIT, COMPLEXITY_LIMIT, OUTDATED_LIMIT, COVERAGE_LIMIT = 5, 15.0, 10, 80.0
DECISIONS = ["ALLOW", "WARN", "DENY"]
# -------------------------------------------------------
#: Policies as data: name, kind of its measure, condition, decision (1 warns, 2 denies). Further ones are rows of the same form.
POLICIES = [
    ("critical-vulnerabilities", "critical", "> 0", 2),
    ("high-findings", "high", f"> {HIGH_LIMIT}", 1),
    ("blocked-licenses", "blocked", "> 0", 2),
    ("min-test-coverage", "coverage", f"< {COVERAGE_LIMIT}", 1),
    ("max-complexity", "complexity", f"> {COMPLEXITY_LIMIT}", 2),
    ("supply-chain", "supply", "> 0", 2),
    ("outdated", "outdated", f"> {OUTDATED_LIMIT}", 1),
    ("secret-words", "secrets", "> 0", 2),
]
CUSTOM_POLICIES = [("no-debug-switches", "debug", "> 3", 1)]


def policy_measures(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """``repo`` and a column for each measure of the policies. The testing score stands for coverage where none is delivered."""
    f = findings.groupBy("repo").agg(
        F.count_if(F.col("severity") == "critical").cast("double").alias("critical"),
        F.count_if(F.col("severity") == "high").cast("double").alias("high"),
        F.count_if(F.col("rule_id") == "license-unknown").cast("double").alias("blocked"),
        F.bround(F.max(F.when(F.col("category") == "complexity", F.col("metric_value"))), 1).alias("complexity"),
        F.count_if((F.col("category") == "dependencies") & F.col("severity").isin("critical", "high")).cast("double").alias("supply"),
        F.count_if(F.col("rule_id") == "loose-pin").cast("double").alias("outdated"),
        F.count_if(F.lower(F.coalesce("message", F.lit(""))).rlike("password|secret|token|api key")).cast("double").alias("secrets"),
        F.count_if(F.col("rule_id") == "debug-enabled").cast("double").alias("debug"),
    )
    return f.join(scores.filter("category = 'testing'").select("repo", F.col("score").alias("coverage")), "repo", "left")


def decide(measures: DataFrame, policies: list[tuple[str, str, str, int]]) -> DataFrame:
    """EXT6, AGG20, AGG21: a row for every policy of a repository, with its decision and the dominant one (DENY over WARN over ALLOW).

    A measure that is missing warns where the policy needs one from above (coverage), and allows otherwise. Without
    policies the dominant decision is ALLOW and there are no rows.
    """
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("policy"), F.when(F.expr(f"`{m}` {test}") | (F.col(m).isNull() & F.lit(test.startswith("<"))), d).otherwise(0).alias("d"), F.col(m).alias("value"))
            for name, m, test, d in policies
        ]
    )
    names = lambda c: F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), c + 1)
    worst = F.array_max(F.transform(F.col("r"), lambda x: x["d"]))
    return (
        measures.select("repo", rules.alias("r")).withColumn("overall", names(worst)).select("repo", "overall", F.explode("r").alias("p"))
        .select("repo", F.col("p.policy").alias("policy"), names(F.col("p.d")).alias("decision"), F.col("p.value").alias("value"), "overall")
    )


def ext6_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT6, AGG21, D20: decisions of the eight built-in policies and a custom one on the last snapshot of every repository."""
    last = last_snapshots(spark, sf_dir)
    return decide(policy_measures(_findings(spark, sf_dir, last), _scores(spark, sf_dir, last)), POLICIES + CUSTOM_POLICIES)


def agg20_policy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: allowed, warned and denied repositories per policy."""
    d = ext6_policies(spark, sf_dir)
    return d.groupBy("policy").agg(*[F.count_if(F.col("decision") == x).alias(x.lower()) for x in DECISIONS])


def agg15_benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, AGG16, D21: average, extremes and sample deviation of the mean times per repository, 0.0 for a single run; hit rate."""
    b = latest(table(spark, sf_dir, "benchmark_results"), ["run_id"], F.desc("loaded_at")).filter("repo_name IS NOT NULL AND avg_time_ms IS NOT NULL AND NOT isnan(avg_time_ms)")
    out = b.groupBy("repo_name").agg(
        F.count("*").alias("runs"), _exact_mean("avg_time_ms").alias("avg_ms"), F.min("avg_time_ms").alias("min_ms"), F.max("avg_time_ms").alias("max_ms"),
        F.round(F.coalesce(F.stddev_samp("avg_time_ms"), F.lit(0.0)), 6).alias("stdev_ms"), F.sum("cache_hits").alias("hits"), F.sum("cache_misses").alias("misses"),
    )
    total = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.when(total > 0, F.col("hits") / total).otherwise(0.0))


def jn5_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: the n-th run of a month beside the n-th run of the month before of the same repository."""
    b = latest(table(spark, sf_dir, "benchmark_results"), ["run_id"], F.desc("loaded_at")).filter("repo_name IS NOT NULL AND started_at IS NOT NULL")
    w = Window.partitionBy("repo_name", "month").orderBy("started_at", "run_id")
    n = b.withColumn("month", F.year("started_at") * 12 + F.month("started_at")).withColumn("n", F.row_number().over(w))
    before = n.select("repo_name", "n", (F.col("month") + 1).alias("month"), F.col("run_id").alias("a"))
    return before.join(n.select("repo_name", "n", "month", F.col("run_id").alias("b")), ["repo_name", "n", "month"])


def flt12_search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, TOP11, PRJ5: repositories of the last snapshot whose name holds a word, with risk and status."""
    o = overall(_scores(spark, sf_dir, last_snapshots(spark, sf_dir)), ["repo"])
    hit = F.lower("repo").contains("harbor") | (F.col("risk_level") == "critical")
    return o.filter(hit).select("repo", "overall_score", "risk_level", sev.status(F.col("overall_score")).alias("status")).orderBy(F.desc("overall_score"), "repo")


def agg25_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25, MISC13: averages of the first and last scores of every repository, and how often they agree on being strong."""
    s = _scores(spark, sf_dir).filter("score IS NOT NULL").select("repo", "category", "score", "snapshot_no")
    ends = s.groupBy("repo", "category").agg(F.min_by("score", "snapshot_no").alias("a"), F.max_by("score", "snapshot_no").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return ends.groupBy("category").agg(
        _exact_mean("a").alias("avg_first"), _exact_mean("b").alias("avg_last"), F.count("*").alias("n"), F.count_if((F.col("a") >= STRONG) == (F.col("b") >= STRONG)).alias("agree")
    )


QUERIES = {
    f.__name__: f
    for f in (
        agg1_overall_score, jn19_default_weights, sc12_strengths, set1_new_strengths, jn1_category_diff, agg19_diff_summary, jn2_finding_diff, jn3_metric_diff,
        win7_score_delta, agg2_severity_counts, agg3_top_cwe, agg18_rule_counts, top3_findings, top8_annotations, snk2_sarif_rules, prj1_flat_findings,
        ext6_policies, agg20_policy_counts, agg15_benchmark_stats, jn5_paired_runs, flt12_search_sort, agg25_agreement,
    )
}

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_LAST = """n AS (SELECT repo, snapshot_no FROM findings UNION SELECT repo, snapshot_no FROM category_scores), l AS (SELECT repo, max(snapshot_no) AS snapshot_no FROM n GROUP BY 1),
pr AS (SELECT * FROM (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS previous FROM n) WHERE previous IS NOT NULL)"""
_NOW = f"{_F}, {_LAST}, c0 AS (SELECT f.* FROM f SEMI JOIN l ON f.repo = l.repo AND f.snapshot_no = l.snapshot_no)"
_DIFF = f"""WITH {_S}, {_LAST}, a AS (SELECT s.repo, category, score, pr.snapshot_no FROM s JOIN pr ON s.repo = pr.repo AND s.snapshot_no = pr.previous WHERE score IS NOT NULL),
b AS (SELECT s.repo, category, score, pr.snapshot_no FROM s JOIN pr ON s.repo = pr.repo AND s.snapshot_no = pr.snapshot_no WHERE score IS NOT NULL),
d AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.category, b.category) AS category, a.score AS before, b.score AS after,
  coalesce(b.score, 0) - coalesce(a.score, 0) AS x, CASE WHEN a.score IS NULL THEN 'new' WHEN b.score IS NULL THEN 'removed' WHEN abs(b.score - a.score) < 1 THEN 'unchanged'
  WHEN b.score > a.score THEN 'improved' ELSE 'regressed' END AS change FROM a FULL JOIN b ON a.repo = b.repo AND a.category = b.category AND a.snapshot_no = b.snapshot_no)"""
_OVERALL = f"""o AS (SELECT repo, snapshot_no, {_MEAN} AS overall_score, coalesce(bool_or(category IN ('security', 'architecture') AND score < 40), false) AS alarm, count(*) AS categories FROM s GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN alarm OR overall_score < 35 THEN 'critical' WHEN overall_score < 55 THEN 'high' WHEN overall_score < 75 THEN 'medium' ELSE 'low' END AS risk_level FROM o)"""
_B = "b AS (SELECT * FROM benchmark_results QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC) = 1)"
_POLICY = f"""{_S}, {_NOW}, a AS (SELECT repo, count(*) FILTER (severity = 'critical')::DOUBLE AS critical, count(*) FILTER (severity = 'high')::DOUBLE AS high, count(*) FILTER (rule_id = 'license-unknown')::DOUBLE AS blocked,
  round_even(max(metric_value) FILTER (category = 'complexity'), 1) AS complexity, count(*) FILTER (category = 'dependencies' AND severity IN ('critical', 'high'))::DOUBLE AS supply, count(*) FILTER (rule_id = 'loose-pin')::DOUBLE AS outdated,
  count(*) FILTER (regexp_matches(lower(coalesce(message, '')), 'password|secret|token|api key'))::DOUBLE AS secrets, count(*) FILTER (rule_id = 'debug-enabled')::DOUBLE AS debug FROM c0 GROUP BY 1),
m AS (SELECT a.*, t.score AS coverage FROM a LEFT JOIN (SELECT s.repo, score FROM s JOIN l USING (repo, snapshot_no) WHERE category = 'testing') t USING (repo)),
p AS ({" UNION ALL ".join(f"SELECT repo, '{n}' AS policy, CASE WHEN {m} {t}{f' OR {m} IS NULL' if t[0] == '<' else ''} THEN {d} ELSE 0 END AS d, {m} AS value FROM m" for n, m, t, d in POLICIES + CUSTOM_POLICIES)}),
q AS (SELECT repo, policy, ['ALLOW', 'WARN', 'DENY'][d + 1] AS decision, value, ['ALLOW', 'WARN', 'DENY'][max(d) OVER (PARTITION BY repo) + 1] AS overall FROM p)"""
ORACLES = {
    "agg1_overall_score": f"WITH {_S}, {_OVERALL} SELECT repo, snapshot_no, overall_score, categories, risk_level FROM r",
    "jn19_default_weights": f"""WITH s0 AS ({_S[6:-1]}), s AS (SELECT * REPLACE (CASE category WHEN 'complexity' THEN 2.0 WHEN 'security' THEN 3.0 WHEN 'testing' THEN 2.0 WHEN 'architecture' THEN 2.0
  WHEN 'maintainability' THEN 1.5 WHEN 'documentation' THEN 0.5 WHEN 'git_history' THEN 0.5 ELSE 1.0 END AS weight) FROM s0) SELECT repo, snapshot_no, {_MEAN} AS overall_score FROM s GROUP BY 1, 2""",
    "sc12_strengths": f"""WITH {_S}, x AS (SELECT *, row_number() OVER (PARTITION BY repo, snapshot_no, score >= 80 ORDER BY score DESC, category) AS hi,
  row_number() OVER (PARTITION BY repo, snapshot_no, score < 50 ORDER BY score, category) AS lo FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT repo, snapshot_no, coalesce(string_agg(category, ', ' ORDER BY score DESC, category) FILTER (score >= 80 AND hi <= 3), '') AS strengths,
  coalesce(string_agg(category, ', ' ORDER BY score, category) FILTER (score < 50 AND lo <= 3), '') AS weaknesses FROM x GROUP BY 1, 2""",
    "set1_new_strengths": f"""WITH {_S}, {_LAST}, t AS (SELECT repo, snapshot_no, category FROM s WHERE score >= 80) SELECT t.repo, t.snapshot_no, category FROM t JOIN pr USING (repo, snapshot_no)
EXCEPT SELECT t.repo, pr.snapshot_no, category FROM t JOIN pr ON t.repo = pr.repo AND t.snapshot_no = pr.previous""",
    "jn1_category_diff": f"{_DIFF} SELECT repo, snapshot_no, category, before, after, round_even(x, 1) AS delta, change, x < -5 AS regressed FROM d",
    "agg19_diff_summary": f"{_DIFF} SELECT repo, snapshot_no, change, count(*) AS n FROM d GROUP BY 1, 2, 3",
    "jn2_finding_diff": f"""WITH {_F}, {_LAST}, k AS (SELECT DISTINCT repo, snapshot_no, concat_ws('|', rule_id, file_path, line_start, severity, left(coalesce(message, ''), 50)) AS key FROM f),
a AS (SELECT k.repo, pr.snapshot_no, key FROM k JOIN pr ON k.repo = pr.repo AND k.snapshot_no = pr.previous), b AS (SELECT k.repo, pr.snapshot_no, key FROM k JOIN pr ON k.repo = pr.repo AND k.snapshot_no = pr.snapshot_no),
d AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'fixed' ELSE 'unchanged' END AS status
  FROM a FULL JOIN b ON a.repo = b.repo AND a.key = b.key AND a.snapshot_no = b.snapshot_no) SELECT repo, snapshot_no, status, count(*) AS findings FROM d GROUP BY 1, 2, 3""",
    "jn3_metric_diff": f"""WITH {_F}, {_LAST}, m AS (SELECT repo, snapshot_no, rule_id, max(round(metric_value, 1)) AS v FROM f WHERE metric_value IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT m.repo, pr.snapshot_no, rule_id, v FROM m JOIN pr ON m.repo = pr.repo AND m.snapshot_no = pr.previous), b AS (SELECT m.repo, pr.snapshot_no, rule_id, v FROM m JOIN pr ON m.repo = pr.repo AND m.snapshot_no = pr.snapshot_no)
SELECT repo, snapshot_no, rule_id, a.v AS before, b.v AS after FROM a FULL JOIN b USING (repo, snapshot_no, rule_id)""",
    "win7_score_delta": f"WITH {_S} SELECT repo, category, snapshot_no, round_even(score - lag(score) OVER (PARTITION BY repo, category ORDER BY snapshot_no), 1) AS delta FROM s WHERE score IS NOT NULL",
    "agg2_severity_counts": f"""WITH {_NOW}, c AS (SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (confidence = 'high') AS confidence_high, count(*) FILTER (confidence = 'medium') AS confidence_medium,
  count(*) FILTER (confidence = 'low') AS confidence_low, count(DISTINCT cwe) AS weaknesses FROM c0 WHERE category = 'security' GROUP BY 1)
SELECT *, greatest(0, least(100, 100 - 20 * critical - 8 * high - 4 * medium - low))::DOUBLE AS score FROM c""",
    "agg3_top_cwe": f"WITH {_NOW} SELECT repo, cwe, n FROM (SELECT repo, cwe, count(*) AS n, min(row_id) AS o FROM c0 WHERE cwe IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, o) = 1",
    "agg18_rule_counts": f"WITH {_NOW} SELECT repo, category, string_agg(rule_id || '=' || n, ',' ORDER BY rule_id || '=' || n) AS rules FROM (SELECT repo, category, rule_id, count(*) AS n FROM c0 GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "top3_findings": f"WITH {_NOW} SELECT row_id, repo, rule_id, severity, {_RANK} AS rank FROM c0 ORDER BY rank, row_id LIMIT 20",
    "top8_annotations": f"""WITH {_NOW}, x AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, row_id) AS n FROM c0 WHERE file_path <> '')
SELECT repo, n::INTEGER AS n, file_path AS path, greatest(line_start, 1) AS start_line, CASE WHEN severity IN ('critical', 'high') THEN 'failure' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END AS level,
  left(coalesce(message, title, ''), 65535) AS message FROM x WHERE n <= 50""",
    "snk2_sarif_rules": f"""WITH {_NOW}, r AS (SELECT repo, rule_id, min(row_id) AS o, count(*) AS results, min({_RANK}) AS k FROM c0 GROUP BY 1, 2)
SELECT repo, rule_id, 'CA' || lpad((row_number() OVER (PARTITION BY repo ORDER BY o))::VARCHAR, 4, '0') AS number, results, CASE WHEN k <= 1 THEN 'error' WHEN k = 2 THEN 'warning' ELSE 'note' END AS level FROM r""",
    "prj1_flat_findings": f"WITH {_S}, {_NOW} SELECT c0.repo, c0.category, s.score, count(*) AS findings FROM c0 LEFT JOIN s ON s.repo = c0.repo AND s.category = c0.category AND s.snapshot_no = c0.snapshot_no WHERE severity IN ('critical', 'high') GROUP BY 1, 2, 3",
    "ext6_policies": f"WITH {_POLICY} SELECT repo, policy, decision, value, overall FROM q",
    "agg20_policy_counts": f"WITH {_POLICY} SELECT policy, count(*) FILTER (decision = 'ALLOW') AS allow, count(*) FILTER (decision = 'WARN') AS warn, count(*) FILTER (decision = 'DENY') AS deny FROM q GROUP BY 1",
    "agg15_benchmark_stats": f"""WITH {_B} SELECT repo_name, count(*) AS runs, sum(avg_time_ms::DECIMAL(18,6))::DOUBLE / count(avg_time_ms) AS avg_ms, min(avg_time_ms) AS min_ms, max(avg_time_ms) AS max_ms, round(coalesce(stddev_samp(avg_time_ms), 0), 6) AS stdev_ms,
  sum(cache_hits)::BIGINT AS hits, sum(cache_misses)::BIGINT AS misses, CASE WHEN sum(cache_hits) + sum(cache_misses) > 0 THEN sum(cache_hits)::DOUBLE / (sum(cache_hits) + sum(cache_misses))::DOUBLE ELSE 0 END AS hit_rate
FROM b WHERE repo_name IS NOT NULL AND avg_time_ms IS NOT NULL AND NOT isnan(avg_time_ms) GROUP BY 1""",
    "jn5_paired_runs": f"""WITH {_B}, n AS (SELECT repo_name, run_id, year(started_at) * 12 + month(started_at) AS m FROM b WHERE repo_name IS NOT NULL AND started_at IS NOT NULL),
k AS (SELECT repo_name, run_id, m, row_number() OVER (PARTITION BY repo_name, m ORDER BY started_at, run_id) AS n FROM (SELECT n.*, started_at FROM n JOIN b USING (run_id, repo_name)))
SELECT x.repo_name, x.n::INTEGER AS n, y.m::INTEGER AS month, x.run_id AS a, y.run_id AS b FROM k x JOIN k y ON x.repo_name = y.repo_name AND x.n = y.n AND x.m + 1 = y.m""",
    "flt12_search_sort": f"WITH {_S}, {_OVERALL}, {_LAST} SELECT repo, overall_score, risk_level, CASE WHEN overall_score >= 70 THEN 'OK' WHEN overall_score >= 40 THEN 'WARN' ELSE 'FAIL' END AS status FROM r SEMI JOIN l USING (repo, snapshot_no) WHERE (contains(lower(repo), 'harbor') OR risk_level = 'critical')",
    "agg25_agreement": f"""WITH {_S}, e AS (SELECT repo, category, min_by(score, snapshot_no) AS a, max_by(score, snapshot_no) AS b FROM s WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT category, sum(a::DECIMAL(18,6))::DOUBLE / count(a) AS avg_first, sum(b::DECIMAL(18,6))::DOUBLE / count(b) AS avg_last, count(*) AS n, count(*) FILTER ((a >= 80) = (b >= 80)) AS agree FROM e GROUP BY 1""",
}
