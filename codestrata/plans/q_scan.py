"""Scans of file contents and inventories of files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import any_of, basename, excluded, extension, glob_regex, is_test_file, module_name, stem
from codestrata.functions.severity import clamp
from codestrata.operators.patterns import LIMITED, SETS, STRUCTURES, SUFFIXES
from codestrata.operators.scan import of_language, pattern_counts, scan_all
from codestrata.plans.samples import X, files_and_samples
from codestrata.session import broadcast_if_small, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def pat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT1-PAT5: every match of the built-in patterns with line and columns."""
    return scan_all(files_and_samples(spark, sf_dir).select("file_id", "path", "content")).select(
        "file_id", "language", "rule_id", "severity", "start", "line", "column_start", "column_end", "snippet"
    )


def pat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT1-PAT5 as counts per file and rule."""
    return pattern_counts(files_and_samples(spark, sf_dir), ["file_id"])


def sc1_scan_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG17, SC1: severity counts and penalty score per repository, 100 where nothing was found."""
    files = files_and_samples(spark, sf_dir)
    counts = pattern_counts(files, ["repo"]).groupBy("repo").agg(
        *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s) for s in ("critical", "high", "medium", "low")]
    )
    base = files.select("repo").distinct().join(counts, "repo", "left").na.fill(0, ["critical", "high", "medium", "low"])
    penalty = 20 * F.col("critical") + 8 * F.col("high") + 4 * F.col("medium") + F.col("low")
    return base.withColumn("score", clamp((100 - penalty).cast("double")))


def pat7_limited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT7: constructs of TypeScript files beyond their limit per file."""
    ts = files_and_samples(spark, sf_dir).filter(extension("path").isin("ts", "tsx") & F.col("content").isNotNull())
    counts = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.regexp_count("content", F.lit(rx)).alias("n"), F.lit(most).alias("most")) for k, (rx, most) in LIMITED.items()])
    return ts.select("file_id", F.explode(counts).alias("c")).select("file_id", "c.rule_id", "c.n").filter(
        any_of((F.col("rule_id") == k) & (F.col("n") > most) for k, (_, most) in LIMITED.items())
    )


def pat8_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT8: declarations per language, summed over each repository."""
    out = None
    for language, counters in STRUCTURES.items():
        files = of_language(files_and_samples(spark, sf_dir), language).filter(F.col("content").isNotNull())
        sums = files.groupBy("repo").agg(*[F.sum(F.regexp_count("content", F.lit(rx))).alias(name) for name, rx in counters.items()])
        part = sums.unpivot("repo", list(counters), "construct", "n").withColumn("language", F.lit(language))
        out = part if out is None else out.unionByName(part)
    return out


def agg23_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, AGG23, AGG24: lines, blank, comment and code lines per repository and ending."""
    lines = _files(spark, sf_dir).filter(F.col("content").isNotNull()).select("repo", extension("path").alias("ext"), F.split("content", "\n", -1).alias("lines"))
    blank = F.size(F.filter("lines", lambda x: F.trim(F.replace(F.replace(x, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(""))) == ""))
    comment = F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*(#|//|/\*|\*)")))
    per = lines.select("repo", "ext", F.size("lines").alias("total"), blank.alias("blank"), comment.alias("comment"))
    return per.groupBy("repo", "ext").agg(
        F.count("*").alias("files"), F.sum("total").alias("lines"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"),
        F.sum(F.col("total") - F.col("blank") - F.col("comment")).alias("code"),
    )


def misc1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC1, D24, AGG22, JN21: language by file name, then ending, then shebang; counts and the main language of a repository."""
    files = _files(spark, sf_dir)
    langs = table(spark, sf_dir, "languages")
    names = broadcast_if_small(langs.select(F.explode("filename_patterns").alias("name"), F.col("lang_name").alias("by_name")))
    ends = broadcast_if_small(langs.select(F.explode("extensions").alias("end"), F.col("lang_name").alias("by_end")))
    bangs = broadcast_if_small(langs.select(F.explode("shebang_patterns").alias("bang"), F.col("lang_name").alias("by_bang")))
    first = F.substring_index(F.col("content"), "\n", 1)
    program = F.regexp_extract(first, r"^#!\s*(?:/\S*/)?(?:env\s+)?(\S+)", 1)
    found = (
        files.select("repo", "ord", basename("path").alias("name"), F.concat(F.lit("."), extension("path")).alias("end"), program.alias("bang"))
        .join(names, "name", "left")
        .join(ends, "end", "left")
        .join(bangs, "bang", "left")
        .withColumn("language", F.coalesce("by_name", "by_end", "by_bang"))
        .filter("language IS NOT NULL")
    )
    counts = found.groupBy("repo", "language").agg(F.count("*").alias("files"), F.min("ord").alias("first_ord"))
    w = Window.partitionBy("repo").orderBy(F.desc("files"), "first_ord", "language")
    return counts.withColumn("main", F.row_number().over(w) == 1).select("repo", "language", "files", "main")


def flt1_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, JN6: which files each pattern of exclude_patterns hits, as substring or glob, and by whole path segments."""
    files = _files(spark, sf_dir).select("repo", "path")
    patterns = [(r[0], r[1]) for r in table(spark, sf_dir, "exclude_patterns").filter("enabled").select("pattern_id", "exclude_pattern").orderBy("pattern_id").collect()]
    tests = F.array(*[F.struct(F.lit(i).alias("pattern_id"), excluded("path", [p]).alias("loose"), excluded("path", [p], by_segment=True).alias("strict")) for i, p in patterns])
    hit = files.select("repo", F.explode(tests).alias("t")).select("repo", "t.*").filter("loose OR strict")
    return hit.groupBy("pattern_id").agg(F.count_if("loose").alias("loose"), F.count_if("strict").alias("strict"), F.countDistinct("repo").alias("repos"))


def flt3_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3, AGG6, AGG14: test files per repository and their ratio to other source files (guarded)."""
    code = [e for ends in SUFFIXES.values() for e in ends]
    rows = _files(spark, sf_dir).filter(extension("path").isin(code)).select("repo", is_test_file("path").alias("test"))
    out = rows.groupBy("repo").agg(F.count_if("test").alias("tests"), F.count_if(~F.col("test")).alias("others"))
    return out.withColumn("ratio", F.col("tests") / F.greatest(F.col("others"), F.lit(1)))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).filter(F.length("content") > 50).select("file_id", "repo", "path", "ord", F.sha2("content", 256).alias("hash"))


def win2_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, PRJ6: later files with the content of an earlier one, pointing at the first (by repo, ord, file_id)."""
    firsts = _hashed(spark, sf_dir).groupBy("hash").agg(F.min(F.struct("repo", "ord", "file_id", "path")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = _hashed(spark, sf_dir).join(firsts, "hash").filter(F.col("file_id") != F.col("first.file_id"))
    return rows.select("file_id", "path", F.substring("hash", 1, 16).alias("hash16"), F.col("first.file_id").alias("first_file_id"), F.col("first.path").alias("first_path"))


def agg8_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: groups of equal contents with their size and spread; a group of any size is one row, not all its pairs."""
    return (
        _hashed(spark, sf_dir)
        .groupBy("hash")
        .agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .filter("files > 1")
    )


def jn13_untested_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, JN10: Python modules of a repository whose name occurs in no test file's name (left anti); private ones are exempt."""
    py = _files(spark, sf_dir).filter(extension("path") == "py").select("repo", "path", stem("path").alias("stem"), is_test_file("path").alias("test")).distinct()
    tested = py.filter("test").select("repo", F.regexp_replace("stem", "^test_|_test$", "").alias("stem")).distinct()
    mine = py.filter("NOT test").filter(~F.col("stem").startswith("_"))
    return mine.join(tested, ["repo", "stem"], "left_anti").select("repo", "path", module_name("path").alias("module"))


# ---- Fixed values: layers and the words in a path that put a file into them, later ones win ----
LAYERS = [
    ("domain", ["domain", "models", "entities", "core"]),
    ("application", ["application", "services", "use_cases"]),
    ("infrastructure", ["infrastructure", "repositories", "adapters"]),
    ("presentation", ["presentation", "api", "controllers", "views", "cli"]),
]
# ------------------------------------------------------------------------------------------------


def jn12_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: the layer of a file by words in its path; the last matching layer wins."""
    layer = F.coalesce(*[F.when(any_of(F.col("path").contains(w) for w in words), F.lit(name)) for name, words in reversed(LAYERS)])
    rows = _files(spark, sf_dir).select("repo", layer.alias("layer")).filter("layer IS NOT NULL")
    return rows.groupBy("repo", "layer").agg(F.count("*").alias("files"))


def _oracle_spots(body: str) -> str:
    """``fin``: every match of every pattern. DuckDB has no look-ahead: the one for SafeLoader is a condition on the rest
    of the match's line, and the one behind a greedy run up to the block's end always holds."""
    rows = []
    for language, patterns in SETS.items():
        for p in patterns:
            rx = ("(?i)" if p.ignore_case else "") + re.sub(r"\(\?!.*?\)(?=$)", "", p.regex)
            rows.append("('%s', '%s', '%s', '%s')" % (language, p.id, p.severity, rx.replace("'", "''")))
    ends = [f"('{lang}', '{e}')" for lang, es in SUFFIXES.items() for e in es]
    return f"""WITH {X},
pats(language, rule_id, severity, rx) AS (VALUES {", ".join(rows)}),
ends(language, ext) AS (VALUES {", ".join(ends)}),
code AS (SELECT file_id, repo, content, language FROM x JOIN ends ON lower(regexp_extract(name, '\\.([^.]*)$', 1)) = ext WHERE content IS NOT NULL),
hits AS (SELECT file_id, repo, content, language, rule_id, severity, regexp_extract_all(content, rx) AS m, regexp_split_to_array(content, rx) AS g FROM code JOIN pats USING (language)),
spots AS (
  SELECT file_id, repo, content, language, rule_id, severity, m[i] AS txt,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0)
), fin AS (
  SELECT *, length(head) - length(replace(head, E'\\n', '')) + 1 AS line, length(head) - length(regexp_extract(head, '[^\\n]*$')) AS bol
  FROM (SELECT *, left(content, start::BIGINT) AS head FROM spots)
  WHERE rule_id <> 'yaml-unsafe-load' OR NOT contains(lower(split_part(substr(content, (start + length(txt) + 1)::BIGINT), E'\\n', 1)), 'loader=yaml.safeloader')
)
{body}"""


QUERIES = {
    f.__name__: f
    for f in (
        pat_scan, pat_counts, sc1_scan_score, pat7_limited_counts, pat8_structures, agg23_line_stats, misc1_languages, flt1_exclusions, flt3_test_files,
        win2_first_seen, agg8_duplicate_groups, jn13_untested_modules, jn12_layers,
    )
}

_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.([^.]*)$', 1))"
_NAME = "regexp_extract(path, '[^/]*$')"
_TEST = rf"""({_NAME} LIKE 'test\_%' ESCAPE '\' OR regexp_matches({_NAME}, '(?:_test|\.test|\.spec)\.[A-Za-z]+$') OR regexp_matches({_NAME}, '(?:Test|Tests|IT)\.java$')
  OR {_NAME} = 'conftest.py' OR regexp_matches(path, '(^|/)tests?/'))"""
_HASHED = "h AS (SELECT file_id, repo, path, ord, sha256(content) AS hash FROM files WHERE length(content) > 50)"


def _structures() -> str:
    parts = []
    for language, counters in STRUCTURES.items():
        ends = ", ".join(f"'{e}'" for e in SUFFIXES[language])
        for name, rx in counters.items():
            parts.append(f"SELECT repo, '{name}' AS construct, sum(len(regexp_extract_all(content, '{rx}')))::BIGINT AS n, '{language}' AS language FROM x WHERE content IS NOT NULL AND {_EXT} IN ({ends}) GROUP BY repo")
    return f"WITH {X} " + " UNION ALL ".join(parts)


ORACLES = {
    "pat_scan": _oracle_spots(
        """SELECT file_id, language, rule_id, severity, start::INTEGER AS start, line::INTEGER AS line, (start - bol + 1)::INTEGER AS column_start,
       (start + length(txt) - bol + 1)::INTEGER AS column_end, trim(split_part(substr(content, bol + 1), E'\\n', 1), E' \\t\\r\\f\\x0B') AS snippet
FROM fin"""
    ),
    "pat_counts": _oracle_spots("SELECT file_id, language, rule_id, severity, count(*)::INTEGER AS n FROM fin GROUP BY 1, 2, 3, 4"),
    "sc1_scan_score": _oracle_spots(
        """, c AS (SELECT repo, coalesce(count(*) FILTER (severity = 'critical'), 0) AS critical, coalesce(count(*) FILTER (severity = 'high'), 0) AS high,
  coalesce(count(*) FILTER (severity = 'medium'), 0) AS medium, coalesce(count(*) FILTER (severity = 'low'), 0) AS low FROM fin GROUP BY repo)
SELECT repo, coalesce(critical, 0)::BIGINT AS critical, coalesce(high, 0)::BIGINT AS high, coalesce(medium, 0)::BIGINT AS medium, coalesce(low, 0)::BIGINT AS low,
  greatest(0, least(100, 100 - coalesce(20 * critical + 8 * high + 4 * medium + low, 0)))::DOUBLE AS score
FROM (SELECT DISTINCT repo FROM x) LEFT JOIN c USING (repo)"""
    ),
    "pat7_limited_counts": f"WITH {X} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT file_id, '{k}' AS rule_id, len(regexp_extract_all(content, '{rx}'))::INTEGER AS n FROM x WHERE content IS NOT NULL AND {_EXT} IN ('ts', 'tsx') AND len(regexp_extract_all(content, '{rx}')) > {most}"
        for k, (rx, most) in LIMITED.items()
    )
    + ")",
    "pat8_structures": _structures(),
    "agg23_line_stats": rf"""
WITH l AS (SELECT file_id, repo, {_EXT} AS ext, unnest(string_split(content, E'\n')) AS line FROM files WHERE content IS NOT NULL)
SELECT repo, ext, count(DISTINCT file_id) AS files, count(*) AS lines, count(*) FILTER (trim(replace(replace(line, E'\r', ''), E'\t', '')) = '') AS blank,
  count(*) FILTER (regexp_matches(line, '^[ \t]*(#|//|/\*|\*)')) AS comment,
  count(*) - count(*) FILTER (trim(replace(replace(line, E'\r', ''), E'\t', '')) = '') - count(*) FILTER (regexp_matches(line, '^[ \t]*(#|//|/\*|\*)')) AS code
FROM l GROUP BY repo, ext""",
    "misc1_languages": rf"""
WITH f AS (SELECT repo, ord, {_NAME} AS name, '.' || {_EXT} AS ext, regexp_extract(split_part(content, E'\n', 1), '^#!\s*(?:/\S*/)?(?:env\s+)?(\S+)', 1) AS bang FROM files),
n AS (SELECT unnest(filename_patterns) AS name, lang_name FROM languages), e AS (SELECT unnest(extensions) AS ext, lang_name FROM languages),
b AS (SELECT unnest(shebang_patterns) AS bang, lang_name FROM languages),
x AS (SELECT f.repo, f.ord, coalesce(n.lang_name, e.lang_name, b.lang_name) AS language FROM f LEFT JOIN n USING (name) LEFT JOIN e USING (ext) LEFT JOIN b USING (bang)),
c AS (SELECT repo, language, count(*) AS files, min(ord) AS o FROM x WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT repo, language, files, row_number() OVER (PARTITION BY repo ORDER BY files DESC, o, language) = 1 AS main FROM c""",
    "flt1_exclusions": rf"""
WITH p AS (SELECT pattern_id, exclude_pattern AS x, regexp_matches(exclude_pattern, '[*?\[]') AS is_glob,
  '^(?s:' || replace(replace(regexp_replace(exclude_pattern, '([.+^$(){{}}|\\-])', '\\\1', 'g'), '*', '.*'), '?', '.') || ')$' AS rx FROM exclude_patterns WHERE enabled),
t AS (SELECT pattern_id, repo, contains(path, x) OR regexp_matches(path, rx) AS loose,
  CASE WHEN is_glob THEN regexp_matches(path, rx) OR regexp_matches({_NAME}, rx) ELSE list_contains(string_split(path, '/'), trim(x, '/')) END AS strict FROM files, p)
SELECT pattern_id, count(*) FILTER (loose) AS loose, count(*) FILTER (strict) AS strict, count(DISTINCT repo) AS repos FROM t WHERE loose OR strict GROUP BY 1""",
    "flt3_test_files": f"""
SELECT repo, tests, others, tests / greatest(others, 1) AS ratio FROM (
  SELECT repo, count(*) FILTER ({_TEST}) AS tests, count(*) FILTER (NOT {_TEST}) AS others FROM files
  WHERE {_EXT} IN ({", ".join(f"'{e}'" for es in SUFFIXES.values() for e in es)}) GROUP BY repo)""",
    "win2_first_seen": f"""
WITH {_HASHED}, r AS (SELECT *, row_number() OVER w AS i, first_value(file_id) OVER w AS f, first_value(path) OVER w AS fp FROM h WINDOW w AS (PARTITION BY hash ORDER BY repo, ord, file_id))
SELECT file_id, path, substr(hash, 1, 16) AS hash16, f AS first_file_id, fp AS first_path FROM r WHERE i > 1""",
    "agg8_duplicate_groups": f"""
WITH {_HASHED} SELECT hash, count(*) AS files, count(DISTINCT repo) AS repos, min(path) AS first_path, max(path) AS last_path FROM h GROUP BY hash HAVING count(*) > 1""",
    "jn13_untested_modules": rf"""
WITH p AS (SELECT DISTINCT repo, path, regexp_replace({_NAME}, '\.[^.]*$', '') AS stem, {_TEST} AS test FROM files WHERE {_EXT} = 'py')
SELECT repo, path, replace(replace(path, '/', '.'), '.py', '') AS module FROM p WHERE NOT test AND NOT starts_with(stem, '_')
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.test AND q.repo = p.repo AND regexp_replace(q.stem, '^test_|_test$', '', 'g') = p.stem)""",
    "jn12_layers": "SELECT repo, layer, count(*) AS files FROM (SELECT repo, CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(path, {w!r})' for w in words)} THEN '{name}'" for name, words in reversed(LAYERS))
    + " END AS layer FROM files) WHERE layer IS NOT NULL GROUP BY 1, 2",
}
