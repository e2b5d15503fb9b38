"""Cache, settings, imports by line, licence and README files, components of graphs, and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata import config
from codestrata.functions.hashes import hmac_sha256, pads
from codestrata.functions.paths import basename, module_name, module_prefixes
from codestrata.operators import cache
from codestrata.operators.builds import cyclonedx_documents
from codestrata.operators.dependencies import all_dependencies
from codestrata.operators.graph import cycles, first_cycles, strong_components
from codestrata.operators.scoring import overall
from codestrata.plans.q_findings import _DIFF, _LAST, _NOW, _OVERALL, _S, _findings, _scores, jn1_category_diff, last_snapshots
from codestrata.plans.q_history import _BUSY, _busy
from codestrata.plans.q_manifests import ORACLES as _MANIFESTS
from codestrata.plans.samples import X, files_and_samples, quote, values
from codestrata.sources import reports
from codestrata.session import cut, table

# ---- Fixed values: names of licence files ----
LICENSE_FILES = ["license", "license.txt", "license.md", "copying"]
# ----------------------------------------------
IMPORT = r"(?m)^[ \t]*(?:from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b|import[ \t]+([A-Za-z_][\w.]*))"


def flt7_license_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7: whether a repository has a licence file."""
    f = files_and_samples(spark, sf_dir)
    return f.groupBy("repo").agg(F.count_if(F.lower(basename("path")).isin(LICENSE_FILES)).alias("license_files")).withColumn("missing", F.col("license_files") == 0)


def flt8_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8: the first README of a repository in the order of its files."""
    f = files_and_samples(spark, sf_dir).filter(F.lower(basename("path")).startswith("readme"))
    return f.groupBy("repo").agg(F.min_by(F.struct("path", F.length("content").alias("chars")), F.struct("ord", "path", "file_id")).alias("r"), F.count("*").alias("found")).select("repo", "r.path", "r.chars", "found")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, module``: imports of Python files by their lines, in the JVM."""
    f = files_and_samples(spark, sf_dir).filter(F.col("path").rlike(r"\.pyi?$") & F.col("content").isNotNull())
    both = F.concat(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)), F.regexp_extract_all("content", F.lit(IMPORT), F.lit(2)))
    return f.select("repo", "path", F.explode(F.array_distinct(both)).alias("module")).filter("module <> ''")


def _local_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, local``: modules of a repository with all their parents, also below ``src``."""
    f = files_and_samples(spark, sf_dir).filter(F.col("path").rlike(r"\.pyi?$"))
    name = module_name(F.regexp_replace(F.regexp_replace("path", r"\.pyi$", ".py"), "^src/", ""))
    return f.select("repo", F.explode(module_prefixes(name)).alias("local")).distinct()


def _internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports whose module begins with a local one. The prefixes of a module are looked up, so no pair is compared in vain."""
    i = _imports(spark, sf_dir).withColumn("local", F.explode(F.transform(F.sequence(F.lit(1), F.length("module")), lambda n: F.substring(F.col("module"), F.lit(1), n))))
    return i.join(_local_modules(spark, sf_dir), ["repo", "local"], "left_semi").select("repo", "path", "module").distinct()


def jn9_internal_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9: internal imports of a repository: any local module's name begins the import."""
    return _internal(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("internal"), F.countDistinct("module").alias("modules"))


def set7_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET7, JN10: external modules of a repository, each once."""
    external = _imports(spark, sf_dir).join(_internal(spark, sf_dir), ["repo", "path", "module"], "left_anti")
    return external.select("repo", F.split_part("module", F.lit("."), F.lit(1)).alias("package")).distinct()


def top9_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP9: the first twenty imports of a repository by name (a limit of the report)."""
    n = F.row_number().over(Window.partitionBy("repo").orderBy("module"))
    return _imports(spark, sf_dir).select("repo", "module").distinct().withColumn("n", n).filter("n <= 20")


def jn20_related_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20: files whose module is an affected one, below one or above one; affected are those of every tenth file here.

    Either direction is a lookup of dotted prefixes instead of a comparison of all pairs.
    """
    f = table(spark, sf_dir, "files").filter(F.col("path").endswith(".py")).select("file_id", "repo", module_name("path").alias("module"))
    affected = f.filter("file_id % 10 = 0").select("repo", "module").distinct()
    below = f.select("file_id", "repo", F.explode(module_prefixes("module")).alias("module")).join(affected, ["repo", "module"], "left_semi")
    above = f.join(affected.select("repo", F.explode(module_prefixes("module")).alias("module")).distinct(), ["repo", "module"], "left_semi")
    return below.select("repo", "file_id").unionByName(above.select("repo", "file_id")).distinct().groupBy("repo").agg(F.count("*").alias("files"))


def gr2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2: nodes on cycles of any length, by strongly connected components."""
    return strong_components(_busy(spark, sf_dir, 1.35))


def top10_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP10: the first five cycles."""
    return first_cycles(cycles(_busy(spark, sf_dir), 3), 5)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries of every delivered snapshot: made at its first score, of the state that its number stands for."""
    s = _scores(spark, sf_dir).groupBy("repo", "snapshot_no").agg(F.min("loaded_at").alias("created_at"), F.count("*").alias("n"))
    key = cache.cache_key(F.col("repo"), F.lit("security"), F.lit("v1"))
    return s.select("repo", key.alias("key"), F.concat(F.lit("s"), (F.floor(F.col("snapshot_no") / 2)).cast("string")).alias("state"), "created_at", F.concat(F.lit("value "), F.col("snapshot_no").cast("string")).alias("value"))


def win6_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6, MISC5: the cache's answers for two states of every repository, a week before the newest entry."""
    e = cut(_entries(spark, sf_dir))
    newest = e.agg(F.max("created_at")).first()[0]
    repos = table(spark, sf_dir, "files").select("repo").union(e.select("repo")).distinct()
    wanted = repos.select("repo", cache.cache_key(F.col("repo"), F.lit("security"), F.lit("v1")).alias("key"), F.explode(F.array(F.lit("s4"), F.lit("s1"), F.lit("s9"))).alias("state"))
    return cache.lookup(wanted, e.drop("repo"), F.lit(newest).cast("timestamp_ntz"), 14 * 86400).drop("key")


def misc5_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC5: the cache's numbers after the entries of some repositories were invalidated."""
    e = cut(_entries(spark, sf_dir))
    return cache.stats(cache.invalidate(e, e.filter("repo LIKE '%a%'")))


def misc5_state_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6, hash family: the state of every repository's files."""
    return cache.state_hash(table(spark, sf_dir, "files"), ["repo"])


#: Settings and variables of the example.
SETTINGS = {"analysis": {"timeout": 30, "parallel": True, "skills": ["security", "testing"], "limits": {"high": 5, "ratio": 0.5}}, "output": {"format": "json", "verbose": False}}
FILE_SETTINGS = {"analysis": {"timeout": 60}, "output": {"format": "html"}, "extra": "x"}
VARIABLES = {"CODESTRATA_ANALYSIS_PARALLEL": "no", "CODESTRATA_ANALYSIS_SKILLS": "security, git", "CODESTRATA_ANALYSIS_LIMITS_HIGH": "9", "CODESTRATA_ANALYSIS_LIMITS_RATIO": "odd", "CODESTRATA_OUTPUT_VERBOSE": "1", "OTHER": "1"}
EXPECTED = [
    ("analysis.timeout", "60"), ("analysis.parallel", "false"), ("analysis.skills", "security,git"), ("analysis.limits.high", "9"), ("analysis.limits.ratio", "0.5"), ("output.format", "html"), ("output.verbose", "true"),
    ("extra", "x"),
]


def misc4_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC4, MISC1: settings of defaults, a file and environment variables."""
    done = config.with_environment(config.merged(SETTINGS, FILE_SETTINGS), VARIABLES)
    return spark.createDataFrame(list(config.flat(done).items()), "name string, value string")


def snk4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: pages of every repository's last snapshot."""
    last = last_snapshots(spark, sf_dir)
    return reports.html(_scores(spark, sf_dir, last), _findings(spark, sf_dir, last).withColumn("ord", F.col("row_id")))


def top4_first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP4: the first ten critical and high findings of every repository in order."""
    f = _findings(spark, sf_dir, last_snapshots(spark, sf_dir)).withColumn("ord", F.col("row_id"))
    return reports.first_findings(f, 10).select("repo", "n", "row_id", "rule_id", "severity")


def snk5_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: printed summaries."""
    s = _scores(spark, sf_dir, last_snapshots(spark, sf_dir))
    return reports.console(overall(s, ["repo"]), s)


def snk9_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, TOP6: comparisons of consecutive snapshots as text."""
    return reports.comparison(jn1_category_diff(spark, sf_dir))


def snk9_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: the same as Markdown."""
    return reports.comparison(jn1_category_diff(spark, sf_dir), "markdown")


def snk9_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: the same as JSON."""
    return reports.comparison(jn1_category_diff(spark, sf_dir), "json")


#: Key of the example's signatures.
HOOK_KEY = "winter garden"


def snk11_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, hash family: the payload that is sent for every repository's last snapshot, with its keyed hash; sending is a service."""
    o = overall(_scores(spark, sf_dir, last_snapshots(spark, sf_dir)), ["repo"])
    payload = F.to_json(F.struct(F.lit("analysis.completed").alias("event"), "repo", "overall_score", "risk_level"))
    return o.select("repo", payload.alias("payload")).withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(HOOK_KEY, F.col("payload"))))


def snk12_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12: a statement for every inventory document with its digest, as it would be signed; signing is a service."""
    docs = cyclonedx_documents(all_dependencies(files_and_samples(spark, sf_dir)), reports.DOCUMENT_FINDINGS)
    digest = F.struct(F.sha2("document", 256).alias("sha256"))
    subject = F.array(F.struct(F.concat_ws("/", "repo", F.col("part").cast("string")).alias("name"), digest.alias("digest")))
    statement = F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), subject.alias("subject"), F.lit("https://cyclonedx.org/bom").alias("predicateType"))
    return docs.select("repo", "part", F.to_json(statement).alias("statement"))


def snk13_benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13, MISC14: benchmark results written to files and read back, counted by repository."""
    from codestrata.session import shared_folder
    import uuid

    b = table(spark, sf_dir, "benchmark_results").filter("repo_name IS NOT NULL").select("run_id", "repo_name", "avg_score")
    path = f"{shared_folder(spark)}/codestrata/{uuid.uuid4().hex}"
    reports.write_benchmark(b, path)
    back = spark.read.schema(b.schema).json(path)
    return back.groupBy("repo_name").agg(F.count("*").alias("rows"), F.countDistinct("run_id").alias("runs"), F.max("avg_score").alias("best"))


QUERIES = {
    f.__name__: f
    for f in (
        flt7_license_files, flt8_readme, jn9_internal_imports, set7_external, top9_imports, jn20_related_modules, gr2_components, top10_cycles, win6_cache, misc5_cache_stats, misc5_state_hashes,
        misc4_settings, snk4_html, top4_first_findings, snk5_console, snk9_console, snk9_markdown, snk9_json, snk11_notifications, snk12_statements,
        snk13_benchmark_rows,
    )
}

_IMP = rf"""{X}, im AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '{IMPORT}', 1) || regexp_extract_all(content, '{IMPORT}', 2)) AS module FROM x WHERE regexp_matches(path, '\.pyi?$') AND content IS NOT NULL),
i AS (SELECT * FROM im WHERE module <> ''),
lm0 AS (SELECT repo, string_split(replace(replace(replace(regexp_replace(regexp_replace(path, '\.pyi$', '.py'), '^src/', ''), '/', '.'), '\', '.'), '.py', ''), '.') AS a FROM x WHERE regexp_matches(path, '\.pyi?$')),
lm AS (SELECT DISTINCT repo, array_to_string(a[1:n], '.') AS local FROM (SELECT repo, a, unnest(range(1, len(a) + 1)) AS n FROM lm0)),
inn AS (SELECT DISTINCT i.* FROM i JOIN lm ON i.repo = lm.repo AND starts_with(i.module, lm.local))"""
_ENT = """e AS (SELECT repo, substr(sha256(repo || ':security:v1'), 1, 32) AS key, 's' || floor(snapshot_no / 2)::BIGINT AS state, min(loaded_at) AS created_at, 'value ' || snapshot_no AS value FROM s GROUP BY repo, snapshot_no)"""
_CHG = "ch AS (SELECT repo, snapshot_no, category, coalesce(before, 0.0) AS before, coalesce(after, 0.0) AS after, round_even(x, 1) AS delta, change, CASE change WHEN 'improved' THEN '[+]' WHEN 'regressed' THEN '[-]' WHEN 'new' THEN '[+]' WHEN 'removed' THEN '[-]' ELSE '[=]' END AS mark FROM d WHERE change <> 'unchanged' OR abs(round_even(x, 1)) >= 0.1)"
_SIGNED = "(CASE WHEN delta < 0 THEN '' ELSE '+' END || printf('%.1f', delta))"


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


ORACLES = {
    "flt7_license_files": f"WITH {X} SELECT repo, count(*) FILTER (lower(name) IN ({', '.join(map(quote, LICENSE_FILES))})) AS license_files, count(*) FILTER (lower(name) IN ({', '.join(map(quote, LICENSE_FILES))})) = 0 AS missing FROM x GROUP BY 1",
    "flt8_readme": f"WITH {X} SELECT repo, path, length(content)::INTEGER AS chars, count(*) OVER (PARTITION BY repo) AS found FROM x WHERE starts_with(lower(name), 'readme') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ord, path, file_id) = 1",
    "jn9_internal_imports": f"WITH {_IMP} SELECT repo, count(*) AS internal, count(DISTINCT module) AS modules FROM inn GROUP BY 1",
    "set7_external": f"WITH {_IMP} SELECT DISTINCT repo, split_part(module, '.', 1) AS package FROM (SELECT * FROM i EXCEPT SELECT * FROM inn)",
    "top9_imports": f"WITH {_IMP} SELECT repo, module, row_number() OVER (PARTITION BY repo ORDER BY module)::INTEGER AS n FROM (SELECT DISTINCT repo, module FROM i) QUALIFY n <= 20",
    "jn20_related_modules": r"""WITH m AS (SELECT file_id, repo, replace(translate(path, '/\', '..'), '.py', '') AS module FROM files WHERE path LIKE '%.py'), a AS (SELECT DISTINCT repo, module FROM m WHERE file_id % 10 = 0)
SELECT repo, count(*) AS files FROM m WHERE EXISTS (SELECT 1 FROM a WHERE a.repo = m.repo AND (a.module = m.module OR starts_with(m.module, a.module || '.') OR starts_with(a.module, m.module || '.'))) GROUP BY 1""",
    "gr2_components": f"""WITH RECURSIVE {_BUSY.replace('1.12', '1.35')}, r(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
c AS (SELECT x.a AS node, min(least(x.a, x.b)) AS component, count(*) FILTER (x.b <> x.a) + 1 AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT node, component, size FROM c WHERE size > 1""",
    "top10_cycles": f"""WITH {_BUSY}, x AS (SELECT * FROM e WHERE src <> dst), c AS (SELECT a.src || '>' || a.dst AS path, 2 AS length FROM x a JOIN x b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM x a JOIN x b ON a.dst = b.src JOIN x c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst) SELECT * FROM c ORDER BY length, path LIMIT 5""",
    "win6_cache": f"""WITH {_S}, {_ENT}, now AS (SELECT max(created_at) AS t FROM e), w AS (SELECT repo, substr(sha256(repo || ':security:v1'), 1, 32) AS key, unnest(['s4', 's1', 's9']) AS state FROM (SELECT repo FROM files UNION SELECT repo FROM e)),
p AS (SELECT key, state, max_by(value, created_at) AS value, min(floor(epoch((SELECT t FROM now))) - floor(epoch(created_at))) AS age FROM e GROUP BY 1, 2),
j AS (SELECT w.repo, w.state, p.value, CASE WHEN age <= 1209600 THEN 'hit' WHEN age IS NOT NULL THEN 'expired' WHEN w.key IN (SELECT key FROM e) THEN 'changed' ELSE 'miss' END AS outcome FROM w LEFT JOIN p USING (key, state))
SELECT repo, state, outcome, CASE WHEN outcome = 'hit' THEN value END AS value FROM j""",
    "misc5_cache_stats": f"WITH {_S}, {_ENT} SELECT count(*) AS entries, count(DISTINCT key) AS keys, coalesce(sum(length(value)), 0)::BIGINT AS chars, min(created_at) AS oldest, max(created_at) AS newest FROM e WHERE repo NOT LIKE '%a%'",
    "misc5_state_hashes": "SELECT repo, count(*) || '-' || sum(('0x' || substr(sha256(concat_ws(':', path, sha256(coalesce(content, '')))), 1, 12))::BIGINT)::VARCHAR AS state FROM files GROUP BY 1",
    "misc4_settings": f"SELECT * FROM {values(EXPECTED)} AS t(name, value)",
    "snk4_html": f"""WITH {_S}, {_NOW}, c AS (SELECT repo, string_agg('<tr><td>' || {_esc('category')} || '</td><td>' || printf('%.1f', round_even(score, 1)) || '</td><td>' || CASE WHEN score >= 70 THEN 'OK' WHEN score >= 40 THEN 'WARN' ELSE 'FAIL' END || '</td></tr>', E'\\n' ORDER BY score, category) AS rows
  FROM s SEMI JOIN l USING (repo, snapshot_no) WHERE score IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM c0 WHERE severity IN ('critical', 'high') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY row_id) <= 20),
i AS (SELECT repo, string_agg('<li>' || {_esc('severity')} || ': ' || {_esc('rule_id')} || ' ' || {_esc('file_path')} || '</li>', E'\\n' ORDER BY row_id) AS items FROM t GROUP BY 1)
SELECT repo, E'<!DOCTYPE html>\\n<html><head><title>' || {_esc('repo')} || E'</title></head><body>\\n<h1>' || {_esc('repo')} || E'</h1>\\n<table>\\n' || rows || E'\\n</table>\\n<ul>\\n' || coalesce(items, '') || E'\\n</ul>\\n</body></html>\\n' AS document FROM c LEFT JOIN i USING (repo)""",
    "top4_first_findings": f"WITH {_NOW} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY row_id)::INTEGER AS n, row_id, rule_id, severity FROM c0 WHERE severity IN ('critical', 'high') QUALIFY n <= 10",
    "snk5_console": f"""WITH {_S}, {_OVERALL}, {_LAST}, q AS (SELECT s.* FROM s SEMI JOIN l USING (repo, snapshot_no) WHERE score IS NOT NULL)
SELECT r.repo, r.repo || ': ' || printf('%.1f', overall_score) || ' (' || risk_level || E')\\n' || string_agg('  ' || rpad(category, 20, ' ') || ' ' || lpad(printf('%.1f', score), 5, ' '), E'\\n' ORDER BY score DESC, category) AS text
FROM r SEMI JOIN l USING (repo, snapshot_no) JOIN q USING (repo) GROUP BY r.repo, overall_score, risk_level""",
    "snk9_console": f"""{_DIFF}, {_CHG} SELECT repo, snapshot_no, repo || ', snapshot ' || snapshot_no || E'\\n' || string_agg('  ' || mark || ' ' || rpad(category, 20, ' ') || ' ' || lpad(printf('%.1f', before), 5, ' ') || ' -> ' || lpad(printf('%.1f', after), 5, ' ') || ' (' || {_SIGNED} || ')', E'\\n' ORDER BY delta, category) AS document
FROM ch GROUP BY 1, 2""",
    "snk9_markdown": f"""{_DIFF}, {_CHG} SELECT repo, snapshot_no, '# Comparison of ' || repo || ', snapshot ' || snapshot_no || E'\\n\\n' || string_agg('### ' || mark || ' ' || category || E'\\n- **Score:** ' || printf('%.1f', before) || ' -> ' || printf('%.1f', after) || ' (' || {_SIGNED} || E')\\n- **Change:** ' || change, E'\\n' ORDER BY delta, category) AS document
FROM ch GROUP BY 1, 2""",
    "snk9_json": f"""{_DIFF}, {_CHG} SELECT repo, snapshot_no, '{{"repo":' || to_json(repo) || ',"snapshot_no":' || snapshot_no || ',"categories":[' || string_agg('{{"category":' || to_json(category) || ',"score_before":' || to_json(before) || ',"score_after":' || to_json(after) || ',"delta":' || to_json(delta) || ',"change_type":' || to_json(change) || '}}', ',' ORDER BY delta, category) || ']}}' AS document
FROM ch GROUP BY 1, 2""",
    "snk11_notifications": f"""WITH {_S}, {_OVERALL}, {_LAST}, p AS (SELECT repo, '{{"event":"analysis.completed","repo":' || to_json(repo) || ',"overall_score":' || to_json(overall_score) || ',"risk_level":' || to_json(risk_level) || '}}' AS payload FROM r SEMI JOIN l USING (repo, snapshot_no))
SELECT repo, payload, 'sha256=' || sha256(unhex('{pads(HOOK_KEY)[1]}') || unhex(sha256(unhex('{pads(HOOK_KEY)[0]}') || encode(payload)))) AS signature FROM p""",
    "snk12_statements": f"""WITH b AS ({_MANIFESTS["snk7_cyclonedx"]}) SELECT repo, part, '{{"_type":"https://in-toto.io/Statement/v1","subject":[{{"name":' || to_json(repo || '/' || part) || ',"digest":{{"sha256":"' || sha256(document) || '"}}}}],"predicateType":"https://cyclonedx.org/bom"}}' AS statement FROM b""",
    "snk13_benchmark_rows": "SELECT repo_name, count(*) AS rows, count(DISTINCT run_id) AS runs, max(avg_score) AS best FROM benchmark_results WHERE repo_name IS NOT NULL GROUP BY 1",
}
