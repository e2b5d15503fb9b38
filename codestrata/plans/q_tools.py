"""Sources: repositories, logs, change sets, stored results, rule files and the reports of other tools.

Logs and change sets are written from the tables in the form of the tool and read back, so that every row is compared;
reports of tools are short texts of our own in their formats.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import severity as sev
from codestrata.functions.paths import module_name, module_prefixes
from codestrata.plans.q_code import RULES
from codestrata.plans.samples import quote, values
from codestrata.sources import repository as repo_io
from codestrata.sources import tool_reports as tools
from codestrata.session import table

PACKAGE = str(Path(__file__).resolve().parents[1])


def src1_scan_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, SRC3: the Python files of this package, by a recursive scan with include and exclude patterns."""
    found = repo_io.scan_repository(spark, PACKAGE, include=["*.py"], exclude=["__pycache__", "llm"])
    return found.select("repo", "path", F.length("content").alias("chars"), F.md5("content").alias("md5"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log text for every note that stands for a commit, with the paths of the repository's files of the same number."""
    d = table(spark, sf_dir, "documents").filter("source = 'commit_note' AND text IS NOT NULL AND repo IS NOT NULL")
    subject = F.regexp_replace(F.substring("text", 1, 60), r"[\n\r\x1e\x1f]", " ")
    stamp = F.concat(F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("doc_id") % 2 == 0, "+02:00").otherwise("-05:30"))
    parents = F.when(F.col("doc_id") % 5 == 0, "p1 p2").otherwise("p1")
    head = F.concat_ws("\x1f", F.md5(F.col("doc_id").cast("string")), F.coalesce("lang", F.lit("nobody")), F.lit("a@b.c"), stamp, parents, subject)
    paths = F.transform(F.sequence(F.lit(1), F.pmod("doc_id", F.lit(4)) + 1), lambda i: F.concat(F.lit("src/f"), (F.col("doc_id") % 50 + i).cast("string"), F.lit(".py")))
    return d.select("repo", F.concat(F.lit("\x1e"), head, F.lit("\n"), F.array_join(paths, "\n"), F.lit("\n")).alias("log"))


def src4_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: commits of parsed logs."""
    commits, _ = repo_io.parse_log(spark, _logs(spark, sf_dir))
    return commits.drop("commit_ord", "email")


def src5_touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: paths that commits touch, counted."""
    _, touched = repo_io.parse_log(spark, _logs(spark, sf_dir))
    return touched.groupBy("repo", "path").agg(F.count("*").alias("changes"))


def src6_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: commits by author."""
    return repo_io.authors_of(repo_io.parse_log(spark, _logs(spark, sf_dir))[0])


def top12_newest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP12: the five newest commits of every repository (a limit of the report)."""
    commits = repo_io.parse_log(spark, _logs(spark, sf_dir))[0].withColumn("commit_ord", F.lit(0))
    return repo_io.newest_commits(commits, 5).select("repo", "n", "hash", "ts")


def src7_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: change sets in name-status form with NUL separators, read back and counted by status."""
    return _changes(spark, sf_dir).groupBy("status", (F.col("new_path").isNotNull()).alias("moved")).agg(F.count("*").alias("files"), F.min("path").alias("first"), F.max("new_path").alias("last_target"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").filter("path IS NOT NULL")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R090", "C075")]), (F.pmod("file_id", F.lit(5)) + 1).cast("int"))
    target = F.concat(F.lit("moved/"), "path")
    text = F.when(F.pmod("file_id", F.lit(5)) >= 3, F.concat_ws("\x00", kind, "path", target, F.lit(""))).otherwise(F.concat_ws("\x00", kind, "path", F.lit("")))
    return repo_io.parse_changes(f.select(text.alias("diff")))


def gr4_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4: whether a repository has too many changed files for an incremental run; renames do not count."""
    f = table(spark, sf_dir, "files").filter("path IS NOT NULL")
    changed = F.count_if(F.pmod("file_id", F.lit(5)) < 3)
    return f.groupBy("repo").agg(changed.alias("changed"), (changed > repo_io.FULL_SCAN_LIMIT).alias("full_scan"))


def src8_stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: stored results with their top-level members; what is no JSON gives nothing."""
    r = table(spark, sf_dir, "analysis_raw").filter(F.try_parse_json("payload").isNotNull())
    member = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    return r.select("record_id", member("repository", "repo").alias("repository"), member("risk_level", "risk").alias("risk"), F.get_json_object("payload", "$.overall_score").try_cast("double").alias("score"))


#: Rules as a rule file holds them.
_RULE_FIELDS = ["id", "type", "severity", "regex_pattern", "ast_pattern", "ast_condition", "metric_name", "comparison", "composite_logic"]


def src9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: the rule set as a table."""
    rows = [tuple(r.get(k) for k in _RULE_FIELDS) + (float(r["threshold"]) if "threshold" in r else None,) for r in RULES]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in _RULE_FIELDS) + ", threshold double")


def snk8_rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: every rule as its part of a YAML rule file (JSON strings are YAML strings)."""
    r = src9_rules(spark, sf_dir)
    line = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"  {k}: "), F.element_at(F.array(F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)), 1), F.lit("\n")))
    text = F.concat(F.lit("- "), F.substring(line("id"), F.lit(3), F.length(line("id"))), *[F.coalesce(line(k), F.lit("")) for k in _RULE_FIELDS[1:]])
    return r.select("id", text.alias("yaml"))


BANDIT = [("a", '{"results": [{"test_id": "B101", "issue_severity": "LOW", "issue_confidence": "HIGH", "issue_text": "assert used", "filename": "a.py", "line_number": 3, "line_range": [3, 5], "code": "assert x", "issue_cwe": {"id": 703}}, {"test_id": "B602", "issue_severity": "HIGH", "issue_confidence": "MEDIUM", "issue_text": "shell", "filename": "b.py", "line_number": 9, "code": "run"}]}'), ("b", "{}"), ("c", "broken")]
ESLINT = [("a", '[{"filePath": "x.js", "messages": [{"ruleId": "no-eval", "severity": 2, "message": "no", "line": 4, "endLine": 6, "column": 2}, {"ruleId": "semi", "severity": 1, "message": "semi", "line": 7, "column": 1}, {"severity": 0, "message": "odd", "line": 8, "column": 3}]}, {"filePath": "y.js", "messages": []}]')]
LINES = [("a", "# pkg\nmain.go:12:4: unused variable\nutil.go:7: bad format\nno place here\n")]
COVERAGE = [("a", '{"totals": {"percent_covered": 87.5}, "files": {"a.py": {"summary": {"percent_covered": 100.0}}, "b.py": {"summary": {"percent_covered": 0}}}}'), ("b", "broken")]
AUDIT = [("a", '{"dependencies": [{"name": "django", "version": "3.0", "vulns": [{"id": "PYSEC-1", "fix_versions": ["3.0.1", "3.1"], "description": "x"}, {"id": "PYSEC-2", "fix_versions": [], "description": "y"}]}, {"name": "rich", "version": "1", "vulns": []}]}'), ("b", "broken")]
OUTDATED = [("a", '[{"name": "Django", "version": "3.2", "latest_version": "5.0"}, {"name": "x", "version": "dev", "latest_version": "2"}]')]
INSTALLED = [("a", '[{"name": "Rich", "version": "12.4"}, {"name": "attrs", "version": "22.1"}]'), ("b", "broken")]
LICENSES = [("a", "Name: Rich\nVersion: 1\nLicense: MIT \n---\nName: other\nLicense:\n")]
MUTATION = [("a", "Killed: 30\nSurvived: 10\n"), ("b", "nothing")]
NATIVE = [("a", "a.cpp:3:error:nullPointer:Null pointer\nb.cpp:9:style:unused:Unused 'x': y\nb.cpp:1:odd::?\nnofile\n")]
BUILDLOG = [("a", "[INFO] start\n[ERROR] src/A.java:[4,9] cannot find symbol\n[WARNING] src/B.java:[1,2] raw type\n[ERROR] failed\n")]
DECISIONS = [("a", '{"result": [{"expressions": [{"value": {"result": {"decision": "deny", "policy": "p1", "message": "no"}}}]}]}'), ("b", '{"result": []}'), ("c", "timeout")]
SIGNED = [("a", '[{"critical": {"image": {"docker-manifest-digest": "sha256:1"}}, "optional": {"Issuer": "https://i"}}]'), ("b", "error: none")]


def _reports(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "repo string, report string")


def misc6_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC6, SRC21."""
    return repo_io.bandit_findings(_reports(spark, BANDIT)).select("repo", "rule_id", "severity", "confidence", "file_path", "line_start", "line_end", "cwe")


def misc7_eslint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC7, PRJ14, SRC21."""
    return repo_io.eslint_findings(_reports(spark, ESLINT)).select("repo", "rule_id", "severity", "file_path", "line_start", "line_end", "column_start", "message")


def misc8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC8, SRC21."""
    return repo_io.line_findings(_reports(spark, LINES), "go", "vet").select("repo", "rule_id", "file_path", "line_start", "column_start", "message")


def misc9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC9, SRC21."""
    return repo_io.coverage_totals(_reports(spark, COVERAGE)).filter("percent IS NOT NULL")


def src20_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.installed_packages(_reports(spark, INSTALLED))


def src21_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: package audits."""
    return tools.audit_findings(_reports(spark, AUDIT))


def src21_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: outdated packages."""
    return tools.outdated_packages(_reports(spark, OUTDATED))


def src21_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: licenses of package descriptions."""
    return tools.package_licenses(_reports(spark, LICENSES))


def src21_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: mutation tests."""
    return tools.mutation_totals(_reports(spark, MUTATION))


def src21_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: native analyzers."""
    return tools.native_findings(_reports(spark, NATIVE))


def src21_build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: build logs."""
    return tools.build_log_findings(_reports(spark, BUILDLOG))


def src21_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: policy engines."""
    return tools.policy_decisions(_reports(spark, DECISIONS))


def src21_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: verified signatures."""
    return tools.signatures(_reports(spark, SIGNED))


def prj8_parent_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7, PRJ8: every module and its parents, with the files below them."""
    py = table(spark, sf_dir, "files").filter("path LIKE '%.py'").select("repo", "path").distinct()
    return py.select("repo", F.explode(module_prefixes(module_name("path"))).alias("module")).groupBy("repo", "module").agg(F.count("*").alias("files"))


def prj11_severity_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11, PRJ13, PRJ14, PRJ4, PRJ3: severities of scores, threshold states and levels over metric findings."""
    f = table(spark, sf_dir, "findings").filter("metric_value IS NOT NULL AND threshold IS NOT NULL AND NOT isnan(metric_value)")
    s = sev.clean("severity")
    return f.groupBy(
        sev.cvss_severity(F.col("metric_value").cast("string")).alias("cvss"), sev.threshold_status(F.col("metric_value"), F.col("threshold")).alias("state"),
        sev.sarif_level(s).alias("level"), sev.annotation_level(s).alias("annotation"), sev.lookup(F.pmod(F.col("line_start"), F.lit(3)), sev.LINTER_SEVERITIES, "medium").alias("linter"),
    ).agg(F.count("*").alias("n"))


def flt13_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: events of wanted actions only, with nested members of their JSON."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup", "click"))
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select("event_id", "event_type", k.alias("k")).filter("k IS NOT NULL AND k > 50")


QUERIES = {
    f.__name__: f
    for f in (
        src1_scan_repository, src4_commits, src5_touched_files, src6_authors, top12_newest_commits, src7_changes, gr4_full_scan, src8_stored_results, src9_rules, snk8_rule_file,
        misc6_bandit, misc7_eslint, misc8_lines, misc9_coverage, src20_installed, src21_audits, src21_outdated, src21_licenses, src21_mutation, src21_native, src21_build_log, src21_decisions,
        src21_signatures, prj8_parent_modules, prj11_severity_ladders, flt13_actions,
    )
}

_DOC = r"""d AS (SELECT *, regexp_replace(left(text, 60), '[\n\r\x1e\x1f]', ' ', 'g') AS subject FROM documents WHERE source = 'commit_note' AND text IS NOT NULL AND repo IS NOT NULL)"""


def _t(rows) -> str:
    return f"{values(rows)} AS t(repo, report)"


_RULES = values([*(tuple(r.get(k) for k in _RULE_FIELDS) + (float(r["threshold"]) if "threshold" in r else None,) for r in RULES)])
_OK = "json_valid(report)"
ORACLES = {
    "src1_scan_repository": f"""SELECT 'codestrata' AS repo, substr(filename, {len(PACKAGE) + 2}) AS path, length(content)::INTEGER AS chars, md5(content) AS md5
FROM read_text({quote(PACKAGE + '/**/*.py')}) WHERE NOT contains(filename, '__pycache__') AND NOT contains(substr(filename, {len(PACKAGE) + 1}), '/llm/')""",
    "src4_commits": rf"""WITH {_DOC} SELECT repo, md5(doc_id::VARCHAR) AS hash, coalesce(lang, 'nobody') AS author, date_trunc('second', created_at) AS ts, CASE WHEN doc_id % 2 = 0 THEN 120 ELSE -330 END AS utc_offset_min,
  trim(subject) AS message, doc_id % 5 = 0 AS is_merge, (doc_id % 4 + 1)::INTEGER AS files_changed FROM d""",
    "src5_touched_files": f"WITH {_DOC} SELECT repo, 'src/f' || (doc_id % 50 + i) || '.py' AS path, count(*) AS changes FROM (SELECT repo, doc_id, unnest(range(1, (doc_id % 4 + 2)::BIGINT)) AS i FROM d) GROUP BY 1, 2",
    "src6_authors": f"WITH {_DOC} SELECT repo, coalesce(lang, 'nobody') AS author, count(*) AS commits FROM d GROUP BY 1, 2",
    "top12_newest_commits": f"WITH {_DOC} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY date_trunc('second', created_at) DESC, md5(doc_id::VARCHAR))::INTEGER AS n, md5(doc_id::VARCHAR) AS hash, date_trunc('second', created_at) AS ts FROM d QUALIFY n <= 5",
    "src7_changes": """SELECT ['A', 'M', 'D', 'R', 'C'][(file_id % 5)::INTEGER + 1] AS status, file_id % 5 >= 3 AS moved, count(*) AS files, min(path) AS first, max(CASE WHEN file_id % 5 >= 3 THEN 'moved/' || path END) AS last_target
FROM files WHERE path IS NOT NULL GROUP BY 1, 2""",
    "gr4_full_scan": f"SELECT repo, count(*) FILTER (file_id % 5 < 3) AS changed, count(*) FILTER (file_id % 5 < 3) > {repo_io.FULL_SCAN_LIMIT} AS full_scan FROM files WHERE path IS NOT NULL GROUP BY 1",
    "src8_stored_results": """SELECT record_id, coalesce(payload->>'repository', payload->>'repo') AS repository, coalesce(payload->>'risk_level', payload->>'risk') AS risk, try_cast(payload->>'overall_score' AS DOUBLE) AS score
FROM analysis_raw WHERE json_valid(payload)""",
    "src9_rules": f"SELECT {', '.join(_RULE_FIELDS)}, threshold::DOUBLE AS threshold FROM {_RULES} AS t({', '.join(_RULE_FIELDS)}, threshold)",
    "snk8_rule_file": f"SELECT id, '- id: ' || to_json(id) || E'\\n' || "
    + " || ".join(f"coalesce('  {k}: ' || CASE WHEN {k} IS NOT NULL THEN to_json({k}) END || E'\\n', '')" for k in _RULE_FIELDS[1:])
    + f" AS yaml FROM {_RULES} AS t({', '.join(_RULE_FIELDS)}, threshold)",
    "misc6_bandit": f"""SELECT repo, r->>'test_id' AS rule_id, lower(r->>'issue_severity') AS severity, lower(r->>'issue_confidence') AS confidence, r->>'filename' AS file_path, (r->>'line_number')::INTEGER AS line_start,
  coalesce(list_max((r->'line_range')::INTEGER[]), (r->>'line_number')::INTEGER) AS line_end, 'CWE-' || (r->'issue_cwe'->>'id') AS cwe FROM (SELECT repo, unnest((report::JSON->'results')::JSON[]) AS r FROM {_t(BANDIT)} WHERE {_OK})""",
    "misc7_eslint": f"""SELECT repo, m->>'ruleId' AS rule_id, CASE (m->>'severity')::INTEGER WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS severity, f->>'filePath' AS file_path, (m->>'line')::INTEGER AS line_start,
  coalesce((m->>'endLine')::INTEGER, (m->>'line')::INTEGER) AS line_end, (m->>'column')::INTEGER AS column_start, m->>'message' AS message
FROM (SELECT repo, f, unnest((f->'messages')::JSON[]) AS m FROM (SELECT repo, unnest(report::JSON[]) AS f FROM {_t(ESLINT)} WHERE {_OK}))""",
    "misc8_lines": r"""SELECT repo, 'vet' AS rule_id, p[1] AS file_path, p[2]::INTEGER AS line_start, try_cast(p[3] AS INTEGER) AS column_start, p[4] AS message FROM (SELECT repo, regexp_extract_all(l, '^([^:\s][^:]*):(\d+)(?::(\d+))?:\s*(.+?)\s*$', 1)
  || regexp_extract_all(l, '^([^:\s][^:]*):(\d+)(?::(\d+))?:\s*(.+?)\s*$', 2) || regexp_extract_all(l, '^([^:\s][^:]*):(\d+)(?::(\d+))?:\s*(.+?)\s*$', 3) || regexp_extract_all(l, '^([^:\s][^:]*):(\d+)(?::(\d+))?:\s*(.+?)\s*$', 4) AS p
  FROM (SELECT repo, unnest(string_split(report, chr(10))) AS l FROM """ + _t(LINES) + r""")) WHERE len(p) = 4""",
    "misc9_coverage": f"""SELECT repo, (report::JSON->'totals'->>'percent_covered')::DOUBLE AS percent, len(json_keys(report::JSON->'files'))::INTEGER AS files,
  len(list_filter(json_keys(report::JSON->'files'), lambda k: (report::JSON->'files'->k->'summary'->>'percent_covered')::DOUBLE = 0))::INTEGER AS uncovered FROM {_t(COVERAGE)} WHERE {_OK}""",
    "src20_installed": f"SELECT repo, lower(p->>'name') AS name, p->>'version' AS version, 'pkg:pypi/' || lower(p->>'name') || '@' || (p->>'version') AS purl FROM (SELECT repo, unnest(report::JSON[]) AS p FROM {_t(INSTALLED)} WHERE {_OK})",
    "src21_audits": f"""SELECT repo, d->>'name' AS name, d->>'version' AS version, v->>'id' AS id, coalesce(v->'fix_versions'->>0, '') AS fixed_version, v->>'description' AS description
FROM (SELECT repo, d, unnest((d->'vulns')::JSON[]) AS v FROM (SELECT repo, unnest((report::JSON->'dependencies')::JSON[]) AS d FROM {_t(AUDIT)} WHERE {_OK}))""",
    "src21_outdated": f"""SELECT repo, lower(p->>'name') AS name, p->>'version' AS version, p->>'latest_version' AS latest, try_cast(split_part(p->>'latest_version', '.', 1) AS INTEGER) - try_cast(split_part(p->>'version', '.', 1) AS INTEGER) AS majors
FROM (SELECT repo, unnest(report::JSON[]) AS p FROM {_t(OUTDATED)} WHERE {_OK})""",
    "src21_licenses": rf"""SELECT repo, lower(regexp_extract(t, '(?m)^Name: *(.*?)\s*$', 1)) AS name, coalesce(nullif(regexp_extract(t, '(?m)^License: *(.*?)\s*$', 1), ''), 'UNKNOWN') AS license FROM (SELECT repo, unnest(string_split(report, E'\n---\n')) AS t FROM {_t(LICENSES)})""",
    "src21_mutation": rf"""SELECT *, CASE WHEN killed + survived > 0 THEN round_even(killed * 100.0::DOUBLE / (killed + survived), 1) ELSE 0.0 END AS score FROM (SELECT repo, coalesce(try_cast(regexp_extract(report, '(?mi)^killed:\s*(\d+)', 1) AS INTEGER), 0) AS killed,
  coalesce(try_cast(regexp_extract(report, '(?mi)^survived:\s*(\d+)', 1) AS INTEGER), 0) AS survived FROM {_t(MUTATION)})""",
    "src21_native": rf"""SELECT repo, split_part(l, ':', 1) AS file_path, split_part(l, ':', 2)::INTEGER AS line_start, CASE split_part(l, ':', 3) WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'style' THEN 'low' WHEN 'performance' THEN 'low'
  WHEN 'portability' THEN 'low' WHEN 'information' THEN 'info' ELSE 'medium' END AS severity, split_part(l, ':', 4) AS rule_id, array_to_string(string_split(l, ':')[5:], ':') AS message
FROM (SELECT repo, unnest(string_split(report, E'\n')) AS l FROM {_t(NATIVE)}) WHERE regexp_matches(l, '^[^:]+:\d+:\w+:[^:]*:')""",
    "src21_build_log": rf"""SELECT repo, CASE WHEN starts_with(l, '[ERROR]') THEN 'high' ELSE 'medium' END AS severity, regexp_extract(l, '\] ([^\s:]+):', 1) AS file_path, regexp_extract(l, ':\[(\d+),', 1)::INTEGER AS line_start, regexp_extract(l, ',(\d+)\]', 1)::INTEGER AS column_start,
  regexp_extract(l, ',\d+\] (.*)$', 1) AS message FROM (SELECT repo, unnest(string_split(report, E'\n')) AS l FROM {_t(BUILDLOG)}) WHERE regexp_matches(l, '^\[(ERROR|WARNING)\] [^\s:]+:\[\d+,\d+\] ')""",
    "src21_decisions": f"""SELECT repo, coalesce(r->>'policy', '') AS policy, CASE WHEN j IS NULL THEN 'WARN' WHEN upper(r->>'decision') IN ('ALLOW', 'WARN', 'DENY') THEN upper(r->>'decision') ELSE 'ALLOW' END AS decision,
  coalesce(r->>'message', CASE WHEN j IS NULL THEN 'unreadable result' ELSE '' END) AS message FROM (SELECT repo, j, j->'result'->0->'expressions'->0->'value'->'result' AS r FROM (SELECT repo, CASE WHEN {_OK} THEN report::JSON END AS j FROM {_t(DECISIONS)}))""",
    "src21_signatures": f"""SELECT repo, coalesce(j->0->'critical'->'image'->>'docker-manifest-digest', '') AS digest, coalesce(j->0->'optional'->>'Issuer', '') AS issuer, coalesce(j->0->'critical'->'image'->>'docker-manifest-digest', '') <> '' AS verified
FROM (SELECT repo, CASE WHEN {_OK} THEN report::JSON END AS j FROM {_t(SIGNED)})""",
    "prj8_parent_modules": r"""WITH p AS (SELECT DISTINCT repo, path FROM files WHERE path LIKE '%.py'), m AS (SELECT repo, string_split(replace(translate(path, '/\', '..'), '.py', ''), '.') AS a FROM p)
SELECT repo, array_to_string(a[1:i], '.') AS module, count(*) AS files FROM (SELECT repo, a, unnest(range(1, len(a) + 1)) AS i FROM m) GROUP BY 1, 2""",
    "prj11_severity_ladders": """SELECT CASE WHEN metric_value >= 9 THEN 'critical' WHEN metric_value >= 7 THEN 'high' WHEN metric_value >= 4 THEN 'medium' ELSE 'low' END AS cvss, CASE WHEN metric_value > 1.5 * threshold THEN 'fail' WHEN metric_value > threshold THEN 'warn' ELSE 'pass' END AS state,
  CASE lower(trim(severity)) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' WHEN 'info' THEN 'note' ELSE 'warning' END AS level,
  CASE lower(trim(severity)) WHEN 'critical' THEN 'failure' WHEN 'high' THEN 'failure' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'notice' WHEN 'info' THEN 'notice' ELSE 'notice' END AS annotation,
  CASE line_start % 3 WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS linter, count(*) AS n FROM findings WHERE metric_value IS NOT NULL AND threshold IS NOT NULL AND NOT isnan(metric_value) GROUP BY ALL""",
    "flt13_actions": "SELECT event_id, event_type, k FROM (SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('purchase', 'signup', 'click')) WHERE k > 50",
}
