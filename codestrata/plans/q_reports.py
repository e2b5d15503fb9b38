"""Report documents and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans.q_findings import _LAST, _NOW, _S, _findings, _scores, last_snapshots
from codestrata.sources import reports
from codestrata.streaming.windows import sessions, windowed_counts
from codestrata.session import table


def snk1_json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: nested result documents of each repository's last snapshot (checked by their shape in the tests)."""
    last = last_snapshots(spark, sf_dir)
    return reports.json_reports(_scores(spark, sf_dir, last), _findings(spark, sf_dir, of=last))


def snk2_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: SARIF documents of each repository's last snapshot; one that has scores only gives none."""
    return reports.sarif(_findings(spark, sf_dir, of=last_snapshots(spark, sf_dir)).withColumn("ord", F.col("row_id")))


def snk3_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: Markdown score tables of the last snapshot."""
    return reports.markdown(_scores(spark, sf_dir, last_snapshots(spark, sf_dir)))


def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of one day over events (the batch form of the stream)."""
    return windowed_counts(table(spark, sf_dir, "events")).select(F.to_date("start").alias("day"), "event_type", "n", "value")


def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of two days every day."""
    return windowed_counts(table(spark, sf_dir, "events"), "2 days", "1 day").select(F.to_date("start").alias("day"), "event_type", "n")


def win_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, ended by 30 minutes without an event."""
    return sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (snk1_json_reports, snk2_sarif, snk3_markdown, win_tumbling, win_sliding, win_sessions)}
_MEMBER = "coalesce(',\"{0}\":' || to_json({0}), '')"
_JSON = f"""fj AS (SELECT repo, category, string_agg('{{"file_path":' || to_json(file_path) || ',"line_start":' || line_start || {" || ".join(_MEMBER.format(c) for c in ("rule_id", "severity", "message"))} || '}}', ','
  ORDER BY file_path, line_start, rule_id NULLS FIRST, severity NULLS FIRST, message NULLS FIRST) AS findings FROM c0 GROUP BY 1, 2),
ls AS (SELECT s.repo, category, score, weight FROM s SEMI JOIN l USING (repo, snapshot_no)),
ct AS (SELECT repo, category, score, weight, findings FROM ls FULL JOIN fj USING (repo, category))"""
ORACLES = {
    "snk1_json_reports": f"""WITH {_S}, {_NOW}, {_JSON} SELECT repo, 0::BIGINT AS part, '{{"repository":' || to_json(repo) || ',"part":0,"categories":[' || string_agg('{{"category":' || to_json(category) || {_MEMBER.format("score")} || {_MEMBER.format("weight")}
  || coalesce(',"findings":[' || findings || ']', '') || '}}', ',' ORDER BY category) || ']}}' AS document FROM ct GROUP BY repo""",
    "snk2_sarif": f"""WITH {_NOW}, ru AS (SELECT repo, rule_id, 'CA' || lpad((row_number() OVER (PARTITION BY repo ORDER BY min(row_id), rule_id))::VARCHAR, 4, '0') AS number FROM c0 GROUP BY 1, 2),
rl AS (SELECT repo, string_agg('{{"id":"' || number || '","name":' || to_json(rule_id) || '}}', ',' ORDER BY number) AS rules FROM ru GROUP BY 1),
rs AS (SELECT c0.repo, string_agg('{{"ruleId":"' || number || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning' END || '","message":{{"text":' || to_json(coalesce(message, c0.rule_id))
  || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file_path) || '}},"region":{{"startLine":' || greatest(line_start, 1) || ',"endLine":' || greatest(coalesce(line_end, line_start), 1) || '}}}}}}]}}', ',' ORDER BY row_id) AS results
  FROM c0 JOIN ru ON c0.repo = ru.repo AND c0.rule_id = ru.rule_id GROUP BY 1)
SELECT repo, 0::BIGINT AS part, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"codestrata","rules":[' || rules || ']}}}},"results":[' || results || ']}}]}}' AS document FROM rs JOIN rl USING (repo)""",
    "snk3_markdown": f"""WITH {_S}, {_LAST} SELECT repo, '# ' || repo || E'\\n\\n| Category | Score | Status |\\n|---|---|---|\\n' || string_agg(printf('| %s | %.1f | %s |', category, score, CASE WHEN score >= 70 THEN 'OK' WHEN score >= 40 THEN 'WARN' ELSE 'FAIL' END), E'\\n' ORDER BY score, category) || E'\\n' AS document
FROM s SEMI JOIN l USING (repo, snapshot_no) WHERE score IS NOT NULL GROUP BY repo""",
    "win_tumbling": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "win_sliding": "SELECT d AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest([ts::DATE, ts::DATE - 1]) AS d FROM events) GROUP BY 1, 2",
    "win_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM c GROUP BY 1""",
}
