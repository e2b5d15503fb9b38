"""Problem 4: changes of findings and category scores between consecutive snapshots of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.snapshots import norm_number, norm_path, norm_text, snapshot_diff, state_hash
from codestrata.session import table

KEYS = ["tbl", "repo", "category", "rule_id", "file_path", "line_start"]


def changes(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each added, removed or changed finding or score (columns of p4_found)."""
    f = findings.select(
        F.lit("findings").alias("tbl"),
        "repo",
        "category",
        "rule_id",
        norm_path("file_path").alias("file_path"),
        F.coalesce(F.col("line_start").cast("bigint"), F.lit(-1)).alias("line_start"),
        "snapshot_no",
        state_hash(norm_text("severity"), norm_text("message"), norm_number("metric_value")).alias("state"),
        "loaded_at",
        "row_id",
    )
    s = scores.select(
        F.lit("category_scores").alias("tbl"),
        "repo",
        "category",
        F.lit("").alias("rule_id"),
        F.lit("").alias("file_path"),
        F.lit(-1).cast("bigint").alias("line_start"),
        "snapshot_no",
        state_hash(norm_number("score")).alias("state"),
        "loaded_at",
        "row_id",
    )
    out = snapshot_diff([f, s], KEYS, owner="repo", snapshot="snapshot_no", state="state", arrived="loaded_at", tiebreak="row_id")
    return out.select("tbl", "repo", "snapshot_no", "category", "rule_id", "file_path", "line_start", "change_type")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "findings"), table(spark, sf_dir, "category_scores"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of changes per table, repository, snapshot and type."""
    return p4_found(spark, sf_dir).groupBy("tbl", "repo", "snapshot_no", "change_type").agg(F.count("*").alias("n"))


_BASE = r"""
WITH f AS (
  SELECT 'findings' AS tbl, repo, snapshot_no, category, rule_id,
         coalesce(regexp_replace(trim(replace(file_path, '\', '/')), '^(\./+)+', ''), '') AS file_path,
         coalesce(line_start::BIGINT, -1) AS line_start,
         lower(trim(severity, E' \t\r\n')) AS a, lower(trim(message, E' \t\r\n')) AS b,
         CASE WHEN NOT isnan(metric_value) THEN round(metric_value, 1) END AS c, loaded_at, row_id
  FROM findings
  UNION ALL
  SELECT 'category_scores', repo, snapshot_no, category, '', '', -1, NULL, NULL,
         CASE WHEN NOT isnan(score) THEN round(score, 1) END, loaded_at, row_id
  FROM category_scores
), cal AS (
  SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev
  FROM (SELECT DISTINCT repo, snapshot_no FROM f)
), cur AS (
  SELECT * FROM f QUALIFY row_number() OVER (
    PARTITION BY tbl, repo, snapshot_no, category, rule_id, file_path, line_start ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1
), new AS (
  SELECT cur.*, cal.prev FROM cur JOIN cal USING (repo, snapshot_no) WHERE cal.prev IS NOT NULL
), old AS (
  SELECT cur.* REPLACE (cal.snapshot_no AS snapshot_no) FROM cur JOIN cal ON cal.repo = cur.repo AND cal.prev = cur.snapshot_no
), diff AS (
  SELECT coalesce(n.tbl, o.tbl) AS tbl, coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no,
         coalesce(n.category, o.category) AS category, coalesce(n.rule_id, o.rule_id) AS rule_id,
         coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.line_start, o.line_start) AS line_start,
         CASE WHEN o.row_id IS NULL THEN 'added' WHEN n.row_id IS NULL THEN 'removed'
              WHEN n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b OR n.c IS DISTINCT FROM o.c THEN 'changed' END AS change_type
  FROM new n FULL JOIN old o ON n.tbl = o.tbl AND n.repo = o.repo AND n.snapshot_no = o.snapshot_no
   AND n.category IS NOT DISTINCT FROM o.category AND n.rule_id IS NOT DISTINCT FROM o.rule_id
   AND n.file_path = o.file_path AND n.line_start = o.line_start
)
"""
QUERIES = {"p4_found": p4_found, "p4_summary": p4_summary}
ORACLES = {
    "p4_found": _BASE + "SELECT * FROM diff WHERE change_type IS NOT NULL",
    "p4_summary": _BASE
    + "SELECT tbl, repo, snapshot_no, change_type, count(*) AS n FROM diff WHERE change_type IS NOT NULL GROUP BY 1, 2, 3, 4",
}
