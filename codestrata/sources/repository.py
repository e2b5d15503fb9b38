"""Reading repositories and the results of other tools.

Analyzers are not run: their output is read as text or tables and mapped to the shape of findings. The only program
that is called, by ``read_log`` and on the driver, is git.
"""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import excluded, included
from codestrata.functions.severity import LINTER_SEVERITIES, lookup

FINDING = (
    "repo string, category string, rule_id string, severity string, confidence string, message string, file_path string, line_start int, line_end int, column_start int, "
    "code_snippet string, cwe string, source string"
)

# ---- Fixed values: what a repository scan takes and leaves out ----
INCLUDE = [
    "*.py", "*.pyi", "*.js", "*.jsx", "*.ts", "*.tsx", "*.mjs", "*.cjs", "*.java", "*.go", "*.cpp", "*.cc", "*.cxx", "*.c", "*.h", "*.hpp", "*.hxx",
    "pyproject.toml", "setup.py", "requirements*.txt", "Pipfile", "poetry.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "go.mod", "go.sum", "CMakeLists.txt", "Makefile", "README*", "LICENSE*",
]
EXCLUDE = [
    "__pycache__", ".git", ".venv", "venv", "env", "build", "dist", "*.egg-info", ".pytest_cache", ".mypy_cache", ".coverage", "htmlcov", "node_modules",
    "target", ".idea", ".vscode",
]
# -------------------------------------------------------------------


def scan_repository(spark: SparkSession, root: str, repo: str | None = None, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """SRC1-SRC3: ``repo, path, ord, content`` of the files under ``root``; bytes that are no UTF-8 are dropped.

    Exclusion goes first and by whole path segments; the order is that of the paths. Spark's file reader leaves out
    names that begin with ``_`` or ``.`` (``__init__.py``) and empty files, so those are listed and read beside it.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).filter("length > 0").select("path", "content").unionByName(_hidden(spark, base))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape("/" + re.sub(r"^[a-z0-9]+:/*", "/", base).lstrip("/")) + "/", "")
    rows = files.select(path.alias("path"), "content").filter(~excluded("path", exclude, by_segment=True) & included("path", include))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return rows.select(F.lit(repo or Path(base).name).alias("repo"), "path", F.xxhash64("path").alias("ord"), text.alias("content"))


def _hidden(spark: SparkSession, base: str) -> DataFrame:
    """``path, content`` of the files under ``base`` that are empty or have a part of their path that begins with ``_`` or ``.``."""
    import pyarrow.fs as pafs

    uri = base if re.match(r"^[a-z0-9]+:", base) else "file://" + str(Path(base).resolve())
    fs, root = pafs.FileSystem.from_uri(uri)
    inside = len(root.rstrip("/")) + 1
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and (not f.size or re.search(r"(?:^|/)[_.]", f.path[inside:]))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from_fs, _ = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for path in pdf["path"]:
                with from_fs.open_input_stream(path) as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    listed = spark.createDataFrame([(n,) for n in names], "path string")
    return listed.filter(~F.col("path").rlike(r"/\.git/|/__pycache__/")).mapInPandas(read, "path string, content binary")


LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%s"


def read_log(root: str, limit: int = 500) -> str:
    """The log of a working copy with the touched paths of each commit, in LOG_FORMAT."""
    out = subprocess.run(["git", "-C", root, "log", f"--max-count={limit}", f"--pretty=format:{LOG_FORMAT}", "--name-only"], capture_output=True, text=True, check=False)
    return out.stdout if out.returncode == 0 else ""


def parse_log(spark: SparkSession, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC4-SRC6, D14: ``commits`` and ``file_changes`` from rows ``repo, log`` (text in LOG_FORMAT).

    Hours and weekdays are those of the author: ``ts`` is the wall clock of the commit and ``utc_offset_min``
    its offset. The subject may hold any character.
    """
    one = logs.select("repo", F.posexplode(F.filter(F.split("log", "\x1e"), lambda x: F.trim(x) != "")).alias("commit_ord", "entry"))
    lines = F.split("entry", "\n")
    head = F.split(lines[0], "\x1f")
    stamp = head[3]
    offset = F.regexp_extract(stamp, r"([+-])(\d{2}):(\d{2})$", 1)
    minutes = F.regexp_extract(stamp, r"([+-])(\d{2}):(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(stamp, r"([+-])(\d{2}):(\d{2})$", 3).try_cast("int")
    commits = one.select(
        "repo", "commit_ord", head[0].alias("hash"), head[1].alias("author"), head[2].alias("email"), F.to_timestamp_ntz(F.substring(stamp, 1, 19)).alias("ts"),
        F.coalesce(F.when(offset == "-", -minutes).otherwise(minutes), F.lit(0)).alias("utc_offset_min"), F.trim(head[5]).alias("message"), F.contains(F.trim(head[4]), F.lit(" ")).alias("is_merge"),
        F.size(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "")).alias("files_changed"),
    )
    touched = one.select("repo", "commit_ord", F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("path")).filter(F.trim("path") != "")
    return commits, touched


def parse_changes(status: DataFrame) -> DataFrame:
    """SRC7, D15: ``status, path, new_path`` from rows ``diff`` in name-status form with NUL separators."""
    parts = F.filter(F.split("diff", "\x00"), lambda x: x != "")
    step = F.aggregate(
        parts,
        F.struct(F.lit("").alias("pending"), F.lit("").alias("first"), F.array().cast("array<struct<status:string,path:string,new_path:string>>").alias("out")),
        lambda acc, x: F.when(acc["pending"] == "", F.struct(x.alias("pending"), F.lit("").alias("first"), acc["out"].alias("out")))
        .when(
            F.substring(acc["pending"], 1, 1).isin("R", "C") & (acc["first"] == ""), F.struct(acc["pending"].alias("pending"), x.alias("first"), acc["out"].alias("out"))
        )
        .otherwise(
            F.struct(
                F.lit("").alias("pending"),
                F.lit("").alias("first"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            F.substring(acc["pending"], 1, 1).alias("status"),
                            F.when(acc["first"] == "", x).otherwise(acc["first"]).alias("path"),
                            F.when(acc["first"] != "", x).alias("new_path"),
                        )
                    ),
                ).alias("out"),
            )
        ),
    )
    return status.select(F.explode(step["out"]).alias("c")).select("c.*")


def authors_of(commits: DataFrame) -> DataFrame:
    """SRC6: ``repo, author, commits`` of parsed logs."""
    return commits.groupBy("repo", "author").agg(F.count("*").alias("commits"))


def newest_commits(commits: DataFrame, most: int) -> DataFrame:
    """TOP12: the newest ``most`` commits of every repository (a limit of the report), ties by place in the log."""
    n = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ts"), "commit_ord", "hash"))
    return commits.withColumn("n", n).filter(F.col("n") <= most)


#: More changed files than an incremental run is worth.
FULL_SCAN_LIMIT = 50


def full_scan_needed(changes: DataFrame, limit: int = FULL_SCAN_LIMIT) -> bool:
    """GR4: more changed files than an incremental run is worth."""
    return changes.limit(limit + 1).count() > limit


def bandit_findings(reports: DataFrame) -> DataFrame:
    """INT1: rows ``repo, report`` (JSON of the scanner) to findings."""
    schema = "results ARRAY<STRUCT<test_id:STRING,issue_severity:STRING,issue_confidence:STRING,issue_text:STRING,filename:STRING,line_number:INT,line_range:ARRAY<INT>,code:STRING,issue_cwe:STRUCT<id:INT>>>"
    rows = reports.select("repo", F.explode(F.from_json("report", schema)["results"]).alias("r"))
    return rows.select(
        "repo", F.lit("security").alias("category"), F.col("r.test_id").alias("rule_id"), F.lower("r.issue_severity").alias("severity"), F.lower("r.issue_confidence").alias("confidence"),
        F.col("r.issue_text").alias("message"), F.col("r.filename").alias("file_path"), F.col("r.line_number").alias("line_start"), F.coalesce(F.array_max("r.line_range"), F.col("r.line_number")).alias("line_end"),
        F.lit(None).cast("int").alias("column_start"), F.col("r.code").alias("code_snippet"), F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string")).alias("cwe"), F.lit("bandit").alias("source"),
    )


def eslint_findings(reports: DataFrame) -> DataFrame:
    """INT2: rows ``repo, report`` (JSON of the linter, one object per file) to findings."""
    schema = "ARRAY<STRUCT<filePath:STRING,messages:ARRAY<STRUCT<ruleId:STRING,severity:INT,message:STRING,line:INT,endLine:INT,column:INT>>>>"
    rows = reports.select("repo", F.explode(F.from_json("report", schema)).alias("f")).select("repo", F.col("f.filePath").alias("file_path"), F.explode("f.messages").alias("m"))
    return rows.select(
        "repo", F.lit("javascript").alias("category"), F.col("m.ruleId").alias("rule_id"), lookup(F.col("m.severity"), LINTER_SEVERITIES, "medium").alias("severity"), F.lit(None).cast("string").alias("confidence"),
        F.col("m.message").alias("message"), "file_path", F.col("m.line").alias("line_start"), F.coalesce("m.endLine", "m.line").alias("line_end"), F.col("m.column").alias("column_start"),
        F.lit(None).cast("string").alias("code_snippet"), F.lit(None).cast("string").alias("cwe"), F.lit("eslint").alias("source"),
    )


def line_findings(reports: DataFrame, category: str, source: str) -> DataFrame:
    """INT3: rows ``repo, report`` with lines ``file:line[:column]: message``; other lines are ignored."""
    rx = r"^([^:\s][^:]*):(\d+)(?::(\d+))?:\s*(.+?)\s*$"
    rows = reports.select("repo", F.explode(F.split("report", "\n")).alias("l")).filter(F.col("l").rlike(rx))
    null = F.lit(None).cast("string")
    line = F.regexp_extract("l", rx, 2).try_cast("int")
    return rows.select(
        "repo", F.lit(category).alias("category"), F.lit(source).alias("rule_id"), F.lit("medium").alias("severity"), null.alias("confidence"), F.regexp_extract("l", rx, 4).alias("message"),
        F.regexp_extract("l", rx, 1).alias("file_path"), line.alias("line_start"), line.alias("line_end"), F.regexp_extract("l", rx, 3).try_cast("int").alias("column_start"), null.alias("code_snippet"), null.alias("cwe"),
        F.lit(source).alias("source"),
    )


def coverage_totals(reports: DataFrame) -> DataFrame:
    """INT4: rows ``repo, report`` (JSON of the coverage tool): total percentage, files, and files without any coverage."""
    schema = "totals STRUCT<percent_covered:DOUBLE>, files MAP<STRING,STRUCT<summary:STRUCT<percent_covered:DOUBLE>>>"
    r = reports.select("repo", F.from_json("report", schema).alias("j"))
    values = F.map_values("j.files")
    return r.select("repo", F.col("j.totals.percent_covered").alias("percent"), F.size("j.files").alias("files"), F.size(F.filter(values, lambda x: x["summary"]["percent_covered"] == 0)).alias("uncovered"))


def advisories(rows: DataFrame) -> DataFrame:
    """SRC22, PRJ11, PRJ12: rows ``name, advisory`` (JSON of a vulnerability source) to severity and first fixed version."""
    schema = "id STRING, severity ARRAY<STRUCT<type:STRING,score:STRING>>, affected ARRAY<STRUCT<ranges:ARRAY<STRUCT<events:ARRAY<STRUCT<introduced:STRING,fixed:STRING>>>>>>"
    from codestrata.functions.severity import cvss_severity

    j = rows.select("name", F.from_json("advisory", schema).alias("j"))
    score = F.element_at(F.split(F.get(F.filter("j.severity", lambda s: s["type"] == "CVSS_V3"), 0)["score"], ":"), -1)
    events = F.flatten(F.flatten(F.transform("j.affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.get(F.filter(events, lambda e: e["fixed"].isNotNull()), 0)["fixed"]
    return j.select("name", F.col("j.id").alias("id"), F.coalesce(cvss_severity(score), F.lit("medium")).alias("severity"), F.coalesce(fixed, F.lit("")).alias("fixed_version"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: stored analysis results (JSON, one object or many) with their categories exploded."""
    j = spark.read.option("multiLine", "true").json(path)
    name = "categories" if "categories" in j.columns else "category_scores"
    return j.select(F.input_file_name().alias("file"), F.explode(name).alias("c")).select("file", "c.*")


def load_rules(path: str) -> list[dict]:
    """SRC9: rules from a JSON file, or from YAML where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        doc = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML rules needs a YAML package; JSON works without") from e
        doc = yaml.safe_load(text)
    return doc["rules"] if isinstance(doc, dict) else doc
