"""Manifests, build files and packages: the files table and the samples of every reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import builds
from codestrata.operators import dependencies as deps
from codestrata.plans.samples import X, files_and_samples, quote, values
from codestrata.sources.reports import DOCUMENT_FINDINGS


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_and_samples(spark, sf_dir).filter(F.col("content").isNotNull())


def src10_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, SRC12, PRJ9: lines of requirements files with name, specifier, version and package URL."""
    return deps.requirements_txt(_files(spark, sf_dir))


def src11_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, SRC13, SRC15: project, poetry and Pipfile dependencies of TOML manifests."""
    return deps.toml_manifests(_files(spark, sf_dir))


def src16_setup_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.setup_py(_files(spark, sf_dir))


def src18_package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18, map family: dependencies and development dependencies, the latter winning."""
    return deps.package_json(_files(spark, sf_dir))


def src19_system_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.dockerfile_packages(_files(spark, sf_dir))


def src17_all_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, AGG26: every manifest routed to its reader; dependencies and pinned ones per repository and manifest."""
    return builds.pinned(deps.all_dependencies(_files(spark, sf_dir)), ["repo", "ecosystem", "source_file"])


def snk7_spdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: SPDX 2.3 documents."""
    return builds.spdx_documents(deps.all_dependencies(_files(spark, sf_dir)), DOCUMENT_FINDINGS)


def snk7_cyclonedx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: CycloneDX 1.5 documents."""
    return builds.cyclonedx_documents(deps.all_dependencies(_files(spark, sf_dir)), DOCUMENT_FINDINGS)


def misc12_sbom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC12: numbers of an inventory per repository: components, ecosystems and components without a version."""
    d = deps.all_dependencies(_files(spark, sf_dir)).select("repo", "name", "version", "ecosystem", "purl").distinct()
    unknown = F.coalesce("version", F.lit("")).isin("", "unknown", "*")
    return d.groupBy("repo").agg(F.count("*").alias("components"), F.countDistinct("ecosystem").alias("ecosystems"), F.count_if(unknown).alias("unversioned"))


#: Advisories of three sources, as delivered.
ADVISORIES = [
    ("osv", "Django", '{"id": "GHSA-1", "severity": [{"type": "CVSS_V3", "score": "9.8"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "4.1.9"}]}]}]}'),
    ("osv", "requests", '{"id": "GHSA-2", "severity": [{"type": "CVSS_V3", "score": "6.1"}], "affected": [{"ranges": [{"events": [{"introduced": "2.3.0"}]}]}]}'),
    ("osv", "lodash", '{"id": "GHSA-3", "affected": []}'),
    ("ossindex", "requests", '{"id": "GHSA-2", "cvssScore": 6.1}'),
    ("ossindex", "celery", '{"id": "sonatype-4", "cvssScore": 7.5}'),
    ("depsdev", "lodash", '{"advisoryKey": {"id": "GHSA-5"}, "cvss3Score": 3.1}'),
    ("depsdev", "Click", "not json"),
]


def _advisories(spark: SparkSession) -> DataFrame:
    from codestrata.sources.tool_reports import advisory_rows

    return advisory_rows(spark.createDataFrame(ADVISORIES, "source string, name string, advisory string"))


def src22_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC22, PRJ11, PRJ12: advisories of three sources in one shape, with severity and first fixed version."""
    return _advisories(spark)


def jn15_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: dependencies with an advisory."""
    return builds.advisories_of(deps.all_dependencies(_files(spark, sf_dir)), _advisories(spark))


def pat9_build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT9, PAT10, PAT11: findings in build files."""
    return builds.build_findings(_files(spark, sf_dir)).drop("file_id")


def pat12_package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT12, JN18: findings in package.json files."""
    return builds.package_findings(_files(spark, sf_dir)).drop("file_id")


def misc2_monorepo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISC2: kind of a repository by marker files at its root, in fixed order."""
    return builds.monorepo_kind(files_and_samples(spark, sf_dir))


def misc3_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23, MISC3: packages of multi-package repositories by their manifests."""
    return builds.monorepo_packages(files_and_samples(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        src10_requirements, src11_projects, src16_setup_py, src18_package_json, src19_system_packages, src17_all_dependencies, snk7_spdx, snk7_cyclonedx, misc12_sbom_metrics,
        src22_advisories, jn15_advisories, pat9_build_files, pat12_package_json, misc2_monorepo, misc3_packages,
    )
}

_OUT = "repo, path AS source_file, name, specifier, version, ecosystem, CASE WHEN version = '' OR version IS NULL THEN 'pkg:' || ecosystem || '/' || name ELSE 'pkg:' || ecosystem || '/' || name || '@' || version END AS purl"
_REQ = r"""lower(regexp_extract(trim(item), '^([a-zA-Z0-9_\-.]+)([=<>!~]+.*)?', 1)) AS name, trim(regexp_replace(regexp_extract(trim(item), '^([a-zA-Z0-9_\-.]+)([=<>!~]+.*)?', 2), '[;#].*', '')) AS specifier"""
_VER = "coalesce(nullif(ltrim(specifier, '=<>!~ '), ''), 'unknown') AS version"
_SECTION = r"""regexp_extract(chr(10) || content || chr(10) || '[', '\n\[{0}\]\n((?:[^\[\n][^\n]*\n|\n)*)', 1)"""
_PAIR = r"""SELECT repo, path, lower(regexp_extract(l, '^([\w-]+)\s*=', 1)) AS name, CASE WHEN regexp_matches(l, '^[\w-]+\s*=\s*"') THEN regexp_extract(l, '^[\w-]+\s*=\s*"([^"]*)"', 1) ELSE coalesce(nullif(regexp_extract(l, 'version = "([^"]*)"', 1), ''), 'unknown') END AS specifier
  FROM (SELECT repo, path, unnest(string_split({0}, chr(10))) AS l FROM x WHERE name = '{1}') WHERE regexp_matches(l, '^[\w-]+\s*=') AND NOT starts_with(l, 'python ')"""
_DEPS = f"""{X},
req AS (SELECT repo, path, {_REQ}, 'pypi' AS ecosystem FROM (SELECT repo, path, unnest(string_split(replace(content, E'\\r\\n', E'\\n'), E'\\n')) AS item FROM x WHERE regexp_matches(name, '^requirements.*\\.txt$'))
  WHERE trim(item) <> '' AND NOT regexp_matches(trim(item), '^[#-]')),
setup AS (SELECT repo, path, {_REQ}, 'pypi' AS ecosystem FROM (SELECT repo, path, trim(translate(trim(item), E'\\'"\\n\\r', '')) AS item
  FROM (SELECT repo, path, unnest(string_split(regexp_extract(content, '(?s)install_requires\\s*=\\s*\\[(.*?)\\]', 1), ',')) AS item FROM x WHERE name = 'setup.py')) WHERE item <> ''),
pep AS (SELECT repo, path, {_REQ}, 'pypi' AS ecosystem FROM (SELECT repo, path, unnest(regexp_extract_all(b, '"([^"]+)"', 1)) AS item
  FROM (SELECT repo, path, unnest(regexp_extract_all(content, '(?s)\\n(?:dependencies|test) = \\[(.*?)\\n?\\]', 1)) AS b FROM x WHERE name = 'pyproject.toml' AND contains(content, '[project]')))),
pair AS ({_PAIR.format(_SECTION.format('tool.poetry.dependencies'), 'pyproject.toml')} UNION ALL {_PAIR.format(_SECTION.format('tool.poetry.group.dev.dependencies'), 'pyproject.toml')}
  UNION ALL {_PAIR.format(_SECTION.format('packages'), 'Pipfile')} UNION ALL {_PAIR.format(_SECTION.format('dev-packages'), 'Pipfile')}),
toml AS (SELECT repo, path, name, specifier, {_VER}, ecosystem FROM pep UNION ALL SELECT repo, path, name, specifier, ltrim(specifier, '^~>=< '), 'pypi' FROM pair),
pkgj AS (SELECT file_id, repo, path, content::JSON AS j FROM x WHERE name = 'package.json' AND json_valid(content)),
npm0 AS (SELECT file_id, repo, path, 0 AS dev, unnest(json_keys(j, '$.dependencies')) AS name, j FROM pkgj UNION ALL SELECT file_id, repo, path, 1, unnest(json_keys(j, '$.devDependencies')), j FROM pkgj),
npm AS (SELECT file_id, repo, path, name, CASE dev WHEN 1 THEN j->'devDependencies'->>name ELSE j->'dependencies'->>name END AS specifier FROM npm0 QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY dev DESC) = 1),
lock AS (SELECT repo, path, regexp_replace(k, '^(?:.*/)?node_modules/', '') AS name, content::JSON->'packages'->k->>'version' AS version
  FROM (SELECT repo, path, content, unnest(json_keys(content::JSON, '$.packages')) AS k FROM x WHERE name = 'package-lock.json' AND json_valid(content)) WHERE k <> ''),
plock AS (SELECT repo, path, lower(unnest(regexp_extract_all(content, '\\[\\[package\\]\\]\\r?\\nname = "([^"]+)"\\r?\\nversion = "([^"]+)"', 1))) AS name,
  unnest(regexp_extract_all(content, '\\[\\[package\\]\\]\\r?\\nname = "([^"]+)"\\r?\\nversion = "([^"]+)"', 2)) AS version FROM x WHERE name = 'poetry.lock'),
sys AS (SELECT repo, path, name FROM (SELECT repo, path, unnest(regexp_split_to_array(trim(l), '\\s+')) AS name FROM (SELECT repo, path,
  unnest(regexp_extract_all(content, '(?:apt-get install|apk add|yum install)\\s+([^\\n&|;]+)', 1)) AS l FROM x WHERE regexp_matches(lower(name), '^dockerfile(?:\\..*)?$'))) WHERE NOT starts_with(name, '-') AND name NOT IN ('', '\\')),
d0 AS (SELECT repo, path, name, specifier, {_VER}, ecosystem FROM req UNION ALL SELECT repo, path, name, specifier, {_VER}, ecosystem FROM setup UNION ALL SELECT * FROM toml
  UNION ALL SELECT repo, path, name, specifier, ltrim(specifier, '^~>=< '), 'npm' FROM npm UNION ALL SELECT repo, path, name, '==' || version, version, 'npm' FROM lock
  UNION ALL SELECT repo, path, name, '==' || version, version, 'pypi' FROM plock UNION ALL SELECT repo, path, name, '', 'system', 'generic' FROM sys),
d AS (SELECT {_OUT} FROM d0)"""
_ADV = f"""a0 AS (SELECT source, name, advisory::JSON AS j FROM {values(ADVISORIES)} AS t(source, name, advisory) WHERE json_valid(advisory)),
a1 AS (SELECT source, name, coalesce(j->>'id', j->'advisoryKey'->>'id') AS id, try_cast(CASE source WHEN 'osv' THEN j->'severity'->0->>'score' WHEN 'ossindex' THEN j->>'cvssScore' ELSE j->>'cvss3Score' END AS DOUBLE) AS score,
  coalesce(j->'affected'->0->'ranges'->0->'events'->1->>'fixed', '') AS fixed_version FROM a0),
a AS (SELECT source, name, id, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score IS NOT NULL THEN 'low' ELSE 'medium' END AS severity, fixed_version FROM a1)"""


def _checks() -> str:
    parts = []
    for of, rule, severity, test, rx in builds.BUILD_RULES:
        names = ", ".join(quote(n) for n in builds.BUILD_FILES[of])
        if test in ("only", "both"):
            a, b = (f"regexp_matches(content, {quote(p)})" for p in rx.split("|"))
            cond, n = f"{a} AND {'NOT ' if test == 'only' else ''}{b}", "1"
        else:
            count = f"len(regexp_extract_all(content, {quote(rx)}))"
            cond, n = (f"{count} = 0", "1") if test == "lacks" else (f"{count} > 0", count)
        parts.append(f"SELECT repo, path, '{rule}' AS rule_id, '{severity}' AS severity, ({n})::INTEGER AS matches FROM x WHERE name IN ({names}) AND content IS NOT NULL AND {cond}")
    return f"WITH {X} " + " UNION ALL ".join(parts)


_KIND = f"""{X}, k AS (SELECT repo, CASE WHEN bool_or(path = 'nx.json') THEN 'nx' WHEN bool_or(path IN ('turbo.json', 'turbo.jsonc')) THEN 'turbo' WHEN bool_or(path IN ('WORKSPACE', 'WORKSPACE.bazel', 'MODULE.bazel')) THEN 'bazel'
  WHEN bool_or(path = 'lerna.json') THEN 'lerna' WHEN bool_or(path = 'pnpm-workspace.yaml') THEN 'pnpm'
  WHEN bool_or(path = 'yarn.lock') AND coalesce(bool_or(path = 'package.json' AND (try_cast(content AS JSON)->'workspaces') IS NOT NULL), false) THEN 'yarn'
  WHEN bool_or(regexp_matches(path, '^(packages|apps|libs|services|modules)/') AND name = 'package.json') THEN 'generic' ELSE 'none' END AS kind FROM x GROUP BY repo)"""
ORACLES = {
    "src10_requirements": f"WITH {_DEPS} SELECT {_OUT} FROM (SELECT *, {_VER} FROM req)",
    "src11_projects": f"WITH {_DEPS} SELECT {_OUT} FROM toml",
    "src16_setup_py": f"WITH {_DEPS} SELECT {_OUT} FROM (SELECT *, {_VER} FROM setup)",
    "src18_package_json": f"WITH {_DEPS} SELECT {_OUT} FROM (SELECT repo, path, name, specifier, ltrim(specifier, '^~>=< ') AS version, 'npm' AS ecosystem FROM npm)",
    "src19_system_packages": f"WITH {_DEPS} SELECT {_OUT} FROM (SELECT repo, path, name, '' AS specifier, 'system' AS version, 'generic' AS ecosystem FROM sys)",
    "src17_all_dependencies": f"WITH {_DEPS} SELECT repo, ecosystem, source_file, count(*) AS dependencies, count(*) FILTER (contains(specifier, '==')) AS pinned FROM d GROUP BY 1, 2, 3",
    "snk7_spdx": f"""WITH {_DEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY purl, name, version) - 1 AS n FROM (SELECT DISTINCT repo, name, version, purl FROM d))
SELECT repo, 0 AS part, count(*)::INTEGER AS packages, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":' || to_json(repo) || ',"packages":[' || string_agg('{{"SPDXID":"SPDXRef-Package-' || n || '","name":' || to_json(name)
  || ',"versionInfo":' || to_json(version) || ',"downloadLocation":"NOASSERTION","filesAnalyzed":false,"licenseConcluded":"NOASSERTION","licenseDeclared":"NOASSERTION","copyrightText":"NOASSERTION","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":'
  || to_json(purl) || '}}]}}', ',' ORDER BY n) || ']}}' AS document FROM n GROUP BY repo""",
    "snk7_cyclonedx": f"""WITH {_DEPS}, n AS (SELECT DISTINCT repo, name, version, purl FROM d)
SELECT repo, 0 AS part, count(*)::INTEGER AS components, '{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[' || string_agg('{{"type":"library","name":' || to_json(name) || ',"version":' || to_json(version) || ',"purl":' || to_json(purl) || '}}', ',' ORDER BY purl, name, version) || ']}}' AS document
FROM n GROUP BY repo""",
    "misc12_sbom_metrics": f"WITH {_DEPS} SELECT repo, count(*) AS components, count(DISTINCT ecosystem) AS ecosystems, count(*) FILTER (coalesce(version, '') IN ('', 'unknown', '*')) AS unversioned FROM (SELECT DISTINCT repo, name, version, ecosystem, purl FROM d) GROUP BY 1",
    "src22_advisories": f"WITH {_ADV} SELECT source, name, id, severity, fixed_version FROM a",
    "jn15_advisories": f"""WITH {_DEPS}, {_ADV}, b AS (SELECT lower(name) AS name, id, min(struct_pack(source := source, severity := severity, fixed_version := fixed_version)) AS s FROM a GROUP BY 1, 2)
SELECT DISTINCT repo, b.name, version, id, s.severity AS severity, s.fixed_version AS fixed_version, s.source AS source FROM d JOIN b ON lower(d.name) = b.name""",
    "pat9_build_files": _checks(),
    "pat12_package_json": f"""WITH {_DEPS} SELECT repo, path, 'unpinned' AS rule_id, 'medium' AS severity, name AS package, specifier AS version FROM npm WHERE specifier IN ('*', 'latest', 'next')
UNION ALL SELECT repo, path, 'vulnerable_package', 'high', name, specifier FROM npm WHERE name IN ('event-stream', 'flatmap-stream', 'lodash', 'axios')
UNION ALL SELECT repo, path, 'invalid_package_json', 'high', NULL, NULL FROM x WHERE name = 'package.json' AND content IS NOT NULL AND NOT json_valid(content)
UNION ALL SELECT repo, path, 'missing_license', 'low', NULL, NULL FROM pkgj WHERE coalesce(j->>'license', '') = '' UNION ALL SELECT repo, path, 'missing_repository', 'low', NULL, NULL FROM pkgj WHERE coalesce(j->>'repository', '') = ''""",
    "misc2_monorepo": f"WITH {_KIND} SELECT repo, kind FROM k",
    "misc3_packages": f"""WITH {_KIND}, m AS (SELECT x.*, k.kind, try_cast(content AS JSON) AS j FROM x JOIN k USING (repo) WHERE kind <> 'none'),
g AS (SELECT repo, kind, unnest(from_json(j->'workspaces', '["VARCHAR"]')) AS g FROM m WHERE kind IN ('turbo', 'yarn') AND path = 'package.json' UNION ALL SELECT repo, kind, unnest(from_json(j->'packages', '["VARCHAR"]')) FROM m WHERE kind = 'lerna' AND path = 'lerna.json'
  UNION ALL SELECT repo, kind, unnest(regexp_extract_all(content, '(?m)^\\s+-\\s*[''"]?([^''"\\s]+)[''"]?\\s*$', 1)) FROM m WHERE kind = 'pnpm' AND path = 'pnpm-workspace.yaml'
  UNION ALL SELECT repo, kind, j->'projects'->u->>'root' FROM (SELECT *, unnest(json_keys(j, '$.projects')) AS u FROM m WHERE kind = 'nx' AND path = 'workspace.json')),
r AS (SELECT repo, kind, '^' || replace(g, '*', '[^/]*') || '$' AS rx FROM g UNION ALL SELECT repo, kind, '^(packages|apps|libs|services|modules)/.+$' FROM k WHERE kind = 'generic'),
p AS (SELECT repo, regexp_replace(path, '/?[^/]*$', '') AS folder, try_cast(content AS JSON) AS j FROM x WHERE name = 'package.json' AND content IS NOT NULL),
h AS (SELECT DISTINCT p.repo, kind, folder, j FROM p JOIN r ON p.repo = r.repo AND regexp_matches(folder, rx))
SELECT repo, kind, folder AS path, coalesce(j->>'name', regexp_extract(folder, '[^/]*$')) AS name, CASE WHEN kind IN ('pnpm', 'yarn', 'generic') THEN kind ELSE 'npm' END AS manager,
  coalesce(array_to_string(list_sort(json_keys(j, '$.dependencies')), ','), '') AS dependencies, coalesce(array_to_string(list_sort(json_keys(j, '$.devDependencies')), ','), '') AS dev_dependencies, coalesce(array_to_string(list_sort(json_keys(j, '$.scripts')), ','), '') AS scripts FROM h""",
}
