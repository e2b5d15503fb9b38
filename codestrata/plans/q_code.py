"""Dependencies, syntax trees and rules over file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import extension, is_test_file
from codestrata.operators import dependencies as deps
from codestrata.operators import rules as user_rules
from codestrata.operators import syntax_tree as trees
from codestrata.operators.graph import degrees
from codestrata.session import cut, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def src14_lock_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14, PRJ9: packages of lock files with their package URLs."""
    f = _files(spark, sf_dir).filter(F.col("content").isNotNull())
    return deps.package_lock(f).unionByName(deps.poetry_lock(f)).groupBy("ecosystem", "name", "version", "purl").agg(F.countDistinct("repo").alias("repos"))


def jn14_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, version family: packages a major version behind the newest one in use."""
    f = _files(spark, sf_dir).filter(F.col("content").isNotNull())
    return deps.outdated(deps.package_lock(f).unionByName(deps.poetry_lock(f))).groupBy("ecosystem", "name", "newest").agg(F.countDistinct("repo").alias("repos"))


def jn16_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16: part types, market segments and names made of languages that are look-alike variants of each other (self-join on generated variants)."""
    a = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"))
    c = table(spark, sf_dir, "languages").select(F.explode(F.array("lang_name", F.concat("lang_name", F.lit("-utils")), F.concat("lang_name", F.lit("s")))).alias("name"))
    return deps.lookalikes(a.unionByName(b).unionByName(c))


def prj10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10, JN17: licenses that file headers name, normalised, with their status."""
    named = F.regexp_extract("content", r"(?:licensed under |contributors, )([A-Za-z0-9.\-]+)", 1)
    rows = _files(spark, sf_dir).select(named.alias("raw")).filter("raw <> ''").withColumn("spdx", deps.spdx(F.col("raw")))
    return rows.groupBy("raw", "spdx", deps.license_status(F.col("spdx")).alias("status")).agg(F.count("*").alias("files"))


def src11_toml_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10-SRC13: dependencies of project tables in TOML files; files that are no TOML give none (needs a TOML reader)."""
    d = deps.toml_manifests(_files(spark, sf_dir), r"\.toml$")
    return d.groupBy("name", "specifier", "purl").agg(F.count("*").alias("n"))


def ast_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST7-AST9, AGG5: measures of every Python file that parses."""
    return trees.modules(_files(spark, sf_dir))


def ast_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST10, AST12, FLT10: functions per repository, with limits and documentation."""
    fn = trees.functions(_files(spark, sf_dir))
    return fn.groupBy("repo").agg(
        F.count("*").alias("functions"), F.count_if(F.col("length") > 50).alias("long"), F.count_if(F.col("params") > 5).alias("wide"), F.count_if(F.col("complexity") > 15).alias("complex"),
        F.count_if("has_doc").alias("documented"), F.count_if("typed").alias("typed"), F.max("complexity").alias("max_complexity"),
    )


def ast_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST13, AST14: test functions per repository with assertion calls, parameters, fixtures, and tests without assertions or with bare handlers."""
    return test_structure(_files(spark, sf_dir))


def test_structure(f: DataFrame) -> DataFrame:
    """AST13, AST14 for any files."""
    fn = trees.functions(f).filter(is_test_file("path"))
    test = F.col("name").startswith("test")
    return fn.groupBy("repo").agg(
        F.count_if(test).alias("tests"), F.sum(F.when(test, F.col("assert_calls")).otherwise(0)).alias("assert_calls"), F.count_if(test & (F.col("assert_calls") == 0)).alias("without_assertions"),
        F.count_if(F.contains("decorators", F.lit("parametrize"))).alias("parametrized"), F.count_if(F.contains("decorators", F.lit("fixture"))).alias("fixtures"), F.sum("bare_excepts").alias("bare_excepts"),
    )


def pat14_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT14: mean quality of the docstrings of a repository's functions."""
    fn = trees.functions(_files(spark, sf_dir)).filter("has_doc")
    return fn.groupBy("repo").agg(F.count("*").alias("docstrings"), F.round(F.avg(trees.doc_quality(F.col("doc"))), 6).alias("quality"))


# ---- Fixed values: methods of a repository class, folders of layers ----
CRUD = ["get", "create", "update", "delete", "find", "save", "list"]
LAYER_WORDS = "domain|application|infrastructure|presentation"
# ------------------------------------------------------------------------


def _class_flags(c: DataFrame) -> DataFrame:
    names = F.col("method_names")
    return c.select(
        *[x for x in ("repo", "file_id", "name", "methods", "public", "private", "attributes", "has_doc") if x in c.columns],
        (F.size(F.array_intersect(names, F.array(*[F.lit(x) for x in CRUD]))) >= 3).alias("is_repository"), F.exists(names, lambda n: F.contains(F.lower(n), F.lit("factory"))).alias("is_factory"),
        (F.array_contains(names, "__new__") | F.array_contains(names, "get_instance")).alias("is_singleton"), ((F.col("methods") > 25) & (F.col("attributes") > 10)).alias("is_god_class"),
    )


def ast_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST11, MISC11, SET3: classes with size, and whether they look like a repository, a factory or a singleton."""
    return _class_flags(trees.classes(_files(spark, sf_dir))).drop("repo")


def agg11_pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST16, AGG11: patterns that a repository shows anywhere, as flags."""
    return pattern_flags(_files(spark, sf_dir))


def pattern_flags(f: DataFrame) -> DataFrame:
    """AST16, AGG11 for any files."""
    c = _class_flags(trees.classes(f)).groupBy("repo").agg(F.bool_or("is_repository").alias("repository"), F.bool_or("is_factory").alias("factory"), F.bool_or("is_singleton").alias("singleton"))
    fn = trees.functions(f).groupBy("repo").agg(F.bool_or("injected").alias("injection"))
    p = f.filter(extension("path") == "py").groupBy("repo").agg(F.bool_or(F.lower("path").rlike("controller|view")).alias("mvc"), F.bool_or(F.lower("path").rlike(LAYER_WORDS)).alias("clean"))
    flags = ["repository", "factory", "singleton", "injection", "mvc", "clean"]
    return p.join(c, "repo", "left").join(fn, "repo", "left").na.fill(False, flags).select("repo", *flags)


def ast_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST15, GR1: imports of Python files as edges from repository to module, with their degrees."""
    n = trees.nodes(_files(spark, sf_dir), kinds=["Import", "ImportFrom"])
    e = n.select(F.col("repo").alias("src"), F.explode(F.split("name", ",")).alias("dst")).filter("dst <> ''")
    return degrees(e).filter("fan_in > 0").select("node", "fan_in")


def ast_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST19: names of functions, classes and variables that a repository sets more than three times, the first ten (a limit of the report)."""
    n = trees.nodes(_files(spark, sf_dir), kinds=["FunctionDef", "ClassDef", "Name"])
    named = n.filter(F.col("kind").isin("FunctionDef", "ClassDef") | (F.col("kind") == "Name") & (F.element_at("attrs", "stored") == "True"))
    counts = named.groupBy("repo", "name").agg(F.count("*").alias("n")).filter("n > 3")
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "name"))
    return counts.withColumn("place", place).filter("place <= 10")


def ast_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST18, AGG8: files of equal structure by the sequence of their node kinds (hash), with group sizes."""
    sig = trees.signatures(_files(spark, sf_dir))
    return sig.filter("nodes > 5").groupBy("sig").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file_id")).filter("files > 1")


RISKY_KINDS = ["Call", "ExceptHandler", "Assign", "BinOp"]


def risky_nodes(n: DataFrame) -> DataFrame:
    """AST2-AST6, AST14: ``file_id, line, rule_id`` of queries put together, risky calls, bare handlers and literal credentials."""
    call = F.col("kind") == "Call"
    kind = (
        F.when(call & F.col("name").rlike(r"\.(run|Popen|call)$") & (F.element_at("attrs", "kw_shell") == "True"), "shell-true")
        .when(call & F.col("name").isin("random.random", "random.choice", "random.randint"), "weak-random")
        .when(call & (F.element_at("attrs", "kw_verify") == "False"), "verify-false")
        .when((F.col("kind") == "ExceptHandler") & (F.element_at("attrs", "type") == ""), "bare-except")
        .when((F.col("kind") == "Assign") & F.lower(F.element_at("attrs", "targets")).rlike("password|secret|token|apikey|api_key") & (F.element_at("attrs", "length").try_cast("int") > 8), "literal-credential")
        .when((F.col("kind") == "BinOp") & (F.element_at("attrs", "sql") == "True"), "sql-concat")
        .when(call & (F.col("name") == "print"), "print-call")
    )
    return n.select("file_id", "line", kind.alias("rule_id")).filter("rule_id IS NOT NULL")


def ast_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST1-AST6, AST14: risky syntax nodes of all files."""
    return risky_nodes(trees.nodes(_files(spark, sf_dir), kinds=RISKY_KINDS))


# ---- Fixed values: the rule set that ships ----
RULES = [
    {"id": "no-print-statements", "type": "ast_pattern", "severity": "low", "ast_pattern": "Call", "ast_condition": "name == 'print'"},
    {"id": "no-bare-except", "type": "ast_pattern", "severity": "medium", "ast_pattern": "ExceptHandler", "ast_condition": "attr.type == ''"},
    {"id": "hardcoded-password", "type": "regex_pattern", "severity": "high", "regex_pattern": r"""(password|secret|api_key|token|private_key)\s*=\s*["'][^"']+["']""", "regex_flags": 2},
    {"id": "sql-injection-risk", "type": "regex_pattern", "severity": "high", "regex_pattern": r"""(execute|query|cursor)\s*\(\s*f["'].*\{.*\}.*["']""", "regex_flags": 2},
    {"id": "eval-usage", "type": "ast_pattern", "severity": "high", "ast_pattern": "Call", "ast_condition": "name == 'eval'"},
    {"id": "todo-comments", "type": "regex_pattern", "severity": "info", "regex_pattern": r"#\s*(TODO|FIXME|HACK|BUG):", "regex_flags": 2},
    {"id": "long-function", "type": "metric_threshold", "severity": "medium", "metric_name": "loc", "threshold": 60, "comparison": "gt"},
    {"id": "high-complexity", "type": "metric_threshold", "severity": "medium", "metric_name": "max_complexity", "threshold": 3, "comparison": "gt"},
    {"id": "long-function-composite", "type": "composite", "severity": "medium", "sub_rules": ["long-function", "high-complexity"], "composite_logic": "all"},
]
# -----------------------------------------------


def ext2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT2-EXT5, AST17, PAT6, JN7, FLT9: the shipped rules over Python files, counted by rule and repository."""
    f = _files(spark, sf_dir).filter((extension("path") == "py") & F.col("content").isNotNull())
    return counted_rules(f)


def counted_rules(f: DataFrame, rules: list[dict] = RULES) -> DataFrame:
    """Rules over files, counted by repository; the files are parsed once for conditions and measures."""
    parsed = cut(trees.nodes(f, measures=True, kinds=user_rules.node_kinds(rules)))
    m = trees.measures_of(parsed, ["loc", "max_complexity"])
    found = user_rules.apply(f, rules, m, parsed=parsed.filter(F.col("kind") != trees.MEASURES))
    return found.join(f.select("file_id", "repo"), "file_id").groupBy("repo", "rule_id", "severity").agg(F.count("*").alias("matches"))


QUERIES = {
    f.__name__: f
    for f in (
        src14_lock_packages, jn14_outdated, jn16_lookalikes, prj10_licenses, src11_toml_dependencies, ast_modules, ast_functions, ast_tests, pat14_docstrings, ast_classes, agg11_pattern_flags,
        ast_imports, ast_identifiers, ast_signatures, ast_security, ext2_rules,
    )
}

_PKG = r"""n AS (SELECT repo, 'npm' AS ecosystem, unnest(regexp_extract_all(content, '"(?:[^"]*/)?node_modules/([^"]+)":\s*\{\s*"version":\s*"([^"]+)"', 1)) AS name,
  unnest(regexp_extract_all(content, '"(?:[^"]*/)?node_modules/([^"]+)":\s*\{\s*"version":\s*"([^"]+)"', 2)) AS version
  FROM files WHERE regexp_extract(path, '[^/]*$') = 'package-lock.json' AND json_valid(content)),
q AS (SELECT repo, unnest(regexp_extract_all(content, '\[\[package\]\]\r?\nname = "([^"]+)"\r?\nversion = "([^"]+)"', 1)) AS name, unnest(regexp_extract_all(content, '\[\[package\]\]\r?\nname = "([^"]+)"\r?\nversion = "([^"]+)"', 2)) AS version
  FROM files WHERE regexp_extract(path, '[^/]*$') = 'poetry.lock'),
d AS (SELECT * FROM n UNION ALL SELECT repo, 'pypi', lower(name), version FROM q)"""
_SPDX = "CASE lower(trim(raw)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in deps.SPDX.items()) + " ELSE upper(raw) END"
ORACLES = {
    "src14_lock_packages": f"WITH {_PKG} SELECT ecosystem, name, version, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl, count(DISTINCT repo) AS repos FROM d GROUP BY 1, 2, 3",
    "jn14_outdated": f"""WITH {_PKG}, m AS (SELECT DISTINCT repo, ecosystem, name, version, try_cast(split_part(version, '.', 1) AS INT) AS major FROM d),
x AS (SELECT *, max(major) OVER (PARTITION BY ecosystem, name) AS newest FROM m WHERE major IS NOT NULL) SELECT ecosystem, name, newest, count(DISTINCT repo) AS repos FROM x WHERE major < newest GROUP BY 1, 2, 3""",
    "jn16_lookalikes": """WITH n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT p_type AS name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT unnest([lang_name, lang_name || '-utils', lang_name || 's']) FROM languages)),
v AS (SELECT name, unnest([replace(name, '-', '_'), replace(name, '_', '-'), CASE WHEN length(name) > 3 THEN name[:-2] ELSE name END, name || 's', name || '2', name || '-utils', name || '-tools', name || '-lib', name || '-client']) AS other FROM n)
SELECT DISTINCT v.name, v.other FROM v JOIN n ON n.name = v.other WHERE v.other <> v.name""",
    "prj10_licenses": rf"""WITH r AS (SELECT regexp_extract(content, '(?:licensed under |contributors, )([A-Za-z0-9.\-]+)', 1) AS raw FROM files), s AS (SELECT raw, {_SPDX} AS spdx FROM r WHERE raw <> '')
SELECT raw, spdx, CASE WHEN contains(spdx, 'GPL-3.0') OR contains('GPL-3.0', spdx) OR contains('AGPL-3.0', spdx) OR contains('LGPL-3.0', spdx) THEN 'blocked'
  WHEN {" OR ".join(f"contains(spdx, '{a}') OR contains('{a}', spdx)" for a in deps.ALLOWED_LICENSES)} THEN 'allowed' ELSE 'unknown' END AS status, count(*) AS files FROM s GROUP BY 1, 2, 3""",
}
