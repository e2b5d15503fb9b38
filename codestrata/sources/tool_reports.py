"""Reports of external tools as rows: audits, versions, licenses, mutation tests, native analyzers, decisions, signatures.

No tool is run; each reader takes rows ``repo, report`` with the text that the tool wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.severity import cvss_severity, lookup

# ---- Fixed values: severities of the native analyzer ----
NATIVE_SEVERITIES = {"error": "high", "warning": "medium", "style": "low", "performance": "low", "portability": "low", "information": "info"}
# ---------------------------------------------------------


def advisory_rows(rows: DataFrame) -> DataFrame:
    """SRC22: rows ``source, name, advisory`` (JSON of osv, ossindex or depsdev) to ``source, name, id, severity, fixed_version``.

    What is no JSON gives no row; without a score the severity is medium.
    """
    schema = (
        "id STRING, cvssScore STRING, cvss3Score STRING, advisoryKey STRUCT<id:STRING>, severity ARRAY<STRUCT<type:STRING,score:STRING>>, "
        "affected ARRAY<STRUCT<ranges:ARRAY<STRUCT<events:ARRAY<STRUCT<introduced:STRING,fixed:STRING>>>>>>"
    )
    j = rows.filter(F.try_parse_json("advisory").isNotNull()).select("source", "name", F.from_json("advisory", schema).alias("j"))
    listed = F.element_at(F.split(F.get(F.filter("j.severity", lambda s: s["type"] == "CVSS_V3"), 0)["score"], ":"), -1)
    score = F.when(F.col("source") == "osv", listed).when(F.col("source") == "ossindex", F.col("j.cvssScore")).otherwise(F.col("j.cvss3Score"))
    events = F.flatten(F.flatten(F.transform("j.affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.get(F.filter(events, lambda e: e["fixed"].isNotNull()), 0)["fixed"]
    return j.select(
        "source", "name", F.coalesce("j.id", "j.advisoryKey.id").alias("id"), F.coalesce(cvss_severity(score), F.lit("medium")).alias("severity"), F.coalesce(fixed, F.lit("")).alias("fixed_version")
    )


def _json(reports: DataFrame, schema: str) -> DataFrame:
    return reports.filter(F.try_parse_json("report").isNotNull()).select("repo", F.from_json("report", schema).alias("j"))


def audit_findings(reports: DataFrame) -> DataFrame:
    """Package audits (one object per dependency with its vulnerabilities): ``repo, name, version, id, fixed_version, description``."""
    j = _json(reports, "dependencies ARRAY<STRUCT<name:STRING,version:STRING,vulns:ARRAY<STRUCT<id:STRING,fix_versions:ARRAY<STRING>,description:STRING>>>>")
    d = j.select("repo", F.explode("j.dependencies").alias("d")).select("repo", "d.name", "d.version", F.explode("d.vulns").alias("v"))
    return d.select("repo", "name", "version", F.col("v.id").alias("id"), F.coalesce(F.get("v.fix_versions", 0), F.lit("")).alias("fixed_version"), F.col("v.description").alias("description"))


def outdated_packages(reports: DataFrame) -> DataFrame:
    """Lists of outdated packages: ``repo, name, version, latest, majors`` behind (null where versions are no numbers)."""
    j = _json(reports, "ARRAY<STRUCT<name:STRING,version:STRING,latest_version:STRING>>")
    p = j.select("repo", F.explode("j").alias("p")).select("repo", F.lower("p.name").alias("name"), "p.version", F.col("p.latest_version").alias("latest")).filter("name IS NOT NULL")
    major = lambda c: F.split_part(c, F.lit("."), F.lit(1)).try_cast("int")
    return p.withColumn("majors", major("latest") - major("version"))


def installed_packages(reports: DataFrame) -> DataFrame:
    """SRC20: lists of installed packages: ``repo, name, version, purl``."""
    j = _json(reports, "ARRAY<STRUCT<name:STRING,version:STRING>>")
    p = j.select("repo", F.explode("j").alias("p")).select("repo", F.lower("p.name").alias("name"), "p.version").filter("name IS NOT NULL")
    return p.withColumn("purl", F.concat(F.lit("pkg:pypi/"), "name", F.lit("@"), "version"))


def package_licenses(reports: DataFrame) -> DataFrame:
    """Package descriptions in header form, separated by lines of dashes: ``repo, name, license``."""
    one = reports.select("repo", F.explode(F.split("report", r"\n---\n")).alias("t"))
    field = lambda name: F.regexp_extract("t", rf"(?m)^{name}: *(.*?)\s*$", 1)
    return one.select("repo", F.lower(field("Name")).alias("name"), F.coalesce(F.nullif(field("License"), F.lit("")), F.lit("UNKNOWN")).alias("license")).filter("name <> ''")


def mutation_totals(reports: DataFrame) -> DataFrame:
    """Mutation test summaries (``killed: n`` and the like, one each line): ``repo, killed, survived, score`` in percent."""
    n = lambda name: F.coalesce(F.regexp_extract("report", rf"(?mi)^{name}:\s*(\d+)", 1).try_cast("int"), F.lit(0))
    r = reports.select("repo", n("killed").alias("killed"), n("survived").alias("survived"))
    total = F.col("killed") + F.col("survived")
    return r.withColumn("score", F.when(total > 0, F.bround(F.col("killed") * 100.0 / total, 1)).otherwise(0.0))


def native_findings(reports: DataFrame) -> DataFrame:
    """Native analyzers' ``file:line:severity:rule:message`` lines: ``repo, file_path, line_start, severity, rule_id, message``."""
    rx = r"^([^:\s][^:]*):(\d+):(\w+):([^:]*):(.*?)\s*$"
    l = reports.select("repo", F.explode(F.split("report", "\n")).alias("l")).filter(F.col("l").rlike(rx))  # noqa: E741
    part = lambda n: F.regexp_extract("l", rx, n)
    return l.select("repo", part(1).alias("file_path"), part(2).try_cast("int").alias("line_start"), lookup(part(3), NATIVE_SEVERITIES, "medium").alias("severity"), part(4).alias("rule_id"), part(5).alias("message"))


def build_log_findings(reports: DataFrame) -> DataFrame:
    """Build logs with ``[LEVEL] file:[line,column] message`` lines: ``repo, severity, file_path, line_start, column_start, message``."""
    rx = r"^\[(ERROR|WARNING)\] ([^\s:]+):\[(\d+),(\d+)\] (.*?)\s*$"
    l = reports.select("repo", F.explode(F.split("report", "\n")).alias("l")).filter(F.col("l").rlike(rx))  # noqa: E741
    part = lambda n: F.regexp_extract("l", rx, n)
    return l.select("repo", F.when(part(1) == "ERROR", "high").otherwise("medium").alias("severity"), part(2).alias("file_path"), part(3).try_cast("int").alias("line_start"), part(4).try_cast("int").alias("column_start"), part(5).alias("message"))


def policy_decisions(reports: DataFrame) -> DataFrame:
    """Results of a policy engine: ``repo, policy, decision, message``; what cannot be read is a warning."""
    schema = "result ARRAY<STRUCT<expressions:ARRAY<STRUCT<value:STRUCT<result:STRUCT<decision:STRING,policy:STRING,message:STRING>>>>>>"
    j = reports.select("repo", F.when(F.try_parse_json("report").isNotNull(), F.from_json("report", schema)).alias("j"))
    v = F.get(F.get("j.result", 0)["expressions"], 0)["value"]["result"]
    known = F.upper(v["decision"]).isin("ALLOW", "WARN", "DENY")
    decision = F.when(F.col("j").isNull(), "WARN").when(known, F.upper(v["decision"])).otherwise("ALLOW")
    return j.select("repo", F.coalesce(v["policy"], F.lit("")).alias("policy"), decision.alias("decision"), F.coalesce(v["message"], F.when(F.col("j").isNull(), "unreadable result").otherwise("")).alias("message"))


def signatures(reports: DataFrame) -> DataFrame:
    """Verification results of signed inventories: ``repo, digest, issuer, verified``."""
    j = reports.select("repo", F.when(F.try_parse_json("report").isNotNull(), F.from_json("report", "ARRAY<STRUCT<critical:STRUCT<image:STRUCT<`docker-manifest-digest`:STRING>>,optional:STRUCT<Issuer:STRING>>>")).alias("j"))
    first = F.get("j", 0)
    digest = F.coalesce(first["critical"]["image"]["docker-manifest-digest"], F.lit(""))
    return j.select("repo", digest.alias("digest"), F.coalesce(first["optional"]["Issuer"], F.lit("")).alias("issuer"), (digest != "").alias("verified"))


