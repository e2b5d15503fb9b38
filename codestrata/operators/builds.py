"""Checks of build files and package descriptions, packages of multi-package repositories, and inventories.

Every check is a condition on one text; all checks of a file are one array of structs in one pass over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import any_of, basename
from codestrata.functions.severity import lookup

# ---- Fixed values: rules of build files; (kind, rule, severity, test, pattern), ``lacks`` rules hold where nothing matches ----
BUILD_FILES = {
    "pom": ["pom.xml"],
    "gradle": ["build.gradle", "build.gradle.kts"],
    "settings": ["settings.gradle"],
    "gomod": ["go.mod"],
    "cmake": ["CMakeLists.txt", "cmake", "CMakeCache.txt"],
    "make": ["Makefile", "makefile", "GNUmakefile"],
}
BUILD_RULES = [
    ("pom", "unmanaged_dependencies", "medium", "lacks", r"<version>|<dependencyManagement>"),
    ("pom", "snapshot_dependencies", "medium", "has", r"<version>[^<]*-SNAPSHOT</version>"),
    ("pom", "vulnerable_log4j", "high", "has", r"<artifactId>log4j</artifactId>\s*<version>1\."),
    ("pom", "vulnerable_struts2", "high", "has", r"<artifactId>struts2-core</artifactId>\s*<version>2\.(0|1|2|3|4|5)\."),
    ("pom", "vulnerable_spring-boot", "high", "has", r"<artifactId>spring-boot-starter</artifactId>\s*<version>1\.|2\.[0-4]\."),
    ("gradle", "dynamic_version", "medium", "has", r"version\s+[\"']\+\.['\"]"),
    ("gradle", "insecure_repository", "medium", "only", r"mavenCentral\(\)|https://repo\.maven\.apache\.org/maven2"),
    ("settings", "insecure_http_repository", "high", "both", r"http://|(?i)maven"),
    ("gomod", "go_mod_replace", "low", "has", r"replace"),
    ("gomod", "go_mod_local_replace", "medium", "has", r"replace\s+\S+\s+=>\s*\./"),
    ("gomod", "go_mod_indirect", "low", "has", r"// indirect"),
    ("cmake", "cmake_minimum_required", "low", "lacks", r"cmake_minimum_required\s*\("),
    ("cmake", "cmake_cxx_standard", "medium", "lacks", r"set\s*\(\s*CMAKE_CXX_STANDARD\s+\d+"),
    ("cmake", "cmake_warnings", "low", "lacks", r"(Wall|Wextra|Wpedantic|Werror)"),
    ("cmake", "cmake_hardening", "medium", "lacks", r"(FORTIFY_SOURCE|stack-protector|PIE)"),
    ("make", "makefile_hardening", "medium", "lacks", r"-fstack-protector|-D_FORTIFY_SOURCE|-fPIE|-fPIC"),
    ("make", "makefile_warnings", "low", "lacks", r"-Wall|-Wextra|-Wpedantic|-Werror"),
]
FLOATING_VERSIONS = ["*", "latest", "next"]
VULNERABLE_PACKAGES = {"event-stream": "3.3.6", "flatmap-stream": "0.1.1", "lodash": "<4.17.21", "axios": "<0.21.1"}
PACKAGE_FOLDERS = ["packages", "apps", "libs", "services", "modules"]
# ------------------------------------------------------------------------------------------------------------------


def build_findings(files: DataFrame) -> DataFrame:
    """PAT9-PAT11: ``file_id, repo, path, rule_id, severity, matches`` of pom, gradle, go.mod, CMake and make files."""
    kind = lookup(basename("path"), {name: kind for kind, names in BUILD_FILES.items() for name in names})
    some = files.filter(F.col("content").isNotNull()).select("file_id", "repo", "path", "content", kind.alias("kind")).filter("kind IS NOT NULL")
    tests = []
    for of, rule, severity, test, rx in BUILD_RULES:
        n = F.regexp_count("content", F.lit(rx))
        if test in ("only", "both"):
            a, b = (F.col("content").rlike(x) for x in rx.split("|"))
            hit, n = (a & ~b if test == "only" else a & b), F.lit(1)
        else:
            hit, n = (n == 0, F.lit(1)) if test == "lacks" else (n > 0, n)
        tests.append(F.when((F.col("kind") == of) & hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), n.alias("matches"))))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return some.select("file_id", "repo", "path", F.explode(found).alias("f")).select("file_id", "repo", "path", "f.*")


_PACKAGE = "name STRING, license STRING, repository STRING, workspaces STRING, dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, scripts MAP<STRING,STRING>"


def _package(files: DataFrame, *names: str) -> DataFrame:
    some = files.filter(basename("path").isin(*names) & F.col("content").isNotNull()).select(*[c for c in ("file_id", "repo", "path", "content") if c in files.columns])
    valid = F.try_parse_json("content").isNotNull()
    return some.withColumn("valid", valid).withColumn("p", F.when(valid, F.from_json("content", _PACKAGE)))


def _merged(main: Column, winner: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    main, winner = F.coalesce(main, empty), F.coalesce(winner, empty)
    return F.map_concat(F.map_filter(main, lambda k, v: ~F.map_contains_key(winner, k)), winner)


def package_findings(files: DataFrame) -> DataFrame:
    """PAT12, JN18: ``file_id, repo, path, rule_id, severity, package, version`` of package.json files."""
    rows = _package(files, "package.json").withColumn("deps", _merged(F.col("p.dependencies"), F.col("p.devDependencies")))

    def of(rule: str, severity: str, package: Column, version: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), package.cast("string").alias("package"), version.cast("string").alias("version"))

    none = F.lit(None)
    entries = F.map_entries("deps")
    floating = F.transform(F.filter(entries, lambda e: e["value"].isin(FLOATING_VERSIONS)), lambda e: of("unpinned", "medium", e["key"], e["value"]))
    known = F.transform(F.filter(entries, lambda e: e["key"].isin(list(VULNERABLE_PACKAGES))), lambda e: of("vulnerable_package", "high", e["key"], e["value"]))
    single = F.filter(
        F.array(
            F.when(~F.col("valid"), of("invalid_package_json", "high", none, none)),
            F.when(F.col("valid") & (F.coalesce("p.license", F.lit("")) == ""), of("missing_license", "low", none, none)),
            F.when(F.col("valid") & (F.coalesce("p.repository", F.lit("")) == ""), of("missing_repository", "low", none, none)),
        ),
        lambda x: x.isNotNull(),
    )
    found = F.concat(floating, known, single)
    return rows.select("file_id", "repo", "path", F.explode(F.when(F.col("valid"), found).otherwise(single)).alias("f")).select("file_id", "repo", "path", "f.*")


def monorepo_kind(files: DataFrame) -> DataFrame:
    """MISC2: ``repo, kind`` by marker files at the root, in fixed order."""
    has = lambda *names: F.bool_or(F.col("path").isin(*names))
    manifest = F.bool_or((F.col("path") == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull())
    generic = F.bool_or(any_of(F.col("path").startswith(d + "/") for d in PACKAGE_FOLDERS) & (basename("path") == "package.json"))
    kind = (
        F.when(has("nx.json"), "nx").when(has("turbo.json", "turbo.jsonc"), "turbo").when(has("WORKSPACE", "WORKSPACE.bazel", "MODULE.bazel"), "bazel").when(has("lerna.json"), "lerna")
        .when(has("pnpm-workspace.yaml"), "pnpm").when(has("yarn.lock") & manifest, "yarn").when(generic, "generic").otherwise("none")
    )
    return files.groupBy("repo").agg(kind.alias("kind"))


def monorepo_packages(files: DataFrame) -> DataFrame:
    """SRC23, MISC3: ``repo, kind, path, name, manager, dependencies, dev_dependencies, scripts`` of the packages that a repository's manifests list.

    Globs of manifests match one path segment per star, as file globs do; a package whose description cannot be
    read has the name of its folder and nothing else. Lists are sorted. Bazel repositories list no packages.
    """
    kinds = monorepo_kind(files).filter(F.col("kind") != "none")
    marks = files.filter(F.col("path").isin("workspace.json", "package.json", "lerna.json", "pnpm-workspace.yaml")).select("repo", "path", "content").join(kinds, "repo")
    listed = F.when(F.col("kind").isin("turbo", "yarn") & (F.col("path") == "package.json"), F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"))
    listed = listed.when((F.col("kind") == "lerna") & (F.col("path") == "lerna.json"), F.from_json(F.get_json_object("content", "$.packages"), "array<string>"))
    items = F.regexp_extract_all("content", F.lit(r"(?m)^\s+-\s*['\"]?([^'\"\s]+)['\"]?\s*$"), F.lit(1))
    listed = listed.when((F.col("kind") == "pnpm") & (F.col("path") == "pnpm-workspace.yaml"), items)
    roots = F.transform(F.map_values(F.from_json(F.get_json_object("content", "$.projects"), "map<string,struct<root:string>>")), lambda x: x["root"])
    listed = listed.when((F.col("kind") == "nx") & (F.col("path") == "workspace.json"), roots)
    globs = marks.select("repo", "kind", F.explode(listed).alias("glob"))
    folders = kinds.filter("kind = 'generic'").select("repo", "kind", F.explode(F.array(*[F.lit(d + "/**") for d in PACKAGE_FOLDERS])).alias("glob"))
    globs = globs.unionByName(folders)
    escaped = F.regexp_replace(F.regexp_replace("glob", r"([.+^$(){}|\\\[\]])", r"\\$1"), r"\*\*", "\x01")
    rx = F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".+")), F.lit("$"))
    packages = _package(files, "package.json").withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    hit = packages.join(globs.withColumn("rx", rx).select("repo", "kind", "rx"), "repo").filter(F.expr("folder RLIKE rx"))
    manager = F.when(F.col("kind").isin("pnpm", "yarn", "generic"), F.col("kind")).otherwise("npm")
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(F.coalesce(m, F.create_map().cast("map<string,string>")))), ",")
    return hit.select(
        "repo", "kind", F.col("folder").alias("path"), F.coalesce("p.name", basename("folder")).alias("name"), manager.alias("manager"),
        keys(F.col("p.dependencies")).alias("dependencies"), keys(F.col("p.devDependencies")).alias("dev_dependencies"), keys(F.col("p.scripts")).alias("scripts"),
    ).distinct()


def spdx_documents(deps: DataFrame, size: int) -> DataFrame:
    """SNK7: ``repo, part, packages, document``: SPDX 2.3 texts per repository, packages by package URL.

    A repository of more than ``size`` packages has several documents.
    """
    rows = _numbered(deps, size)
    reference = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    no = F.lit("NOASSERTION")
    package = F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), no.alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        no.alias("licenseConcluded"), no.alias("licenseDeclared"), no.alias("copyrightText"), reference.alias("externalRefs"),
    )
    per = rows.groupBy("repo", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", package.alias("p")))), lambda x: x["p"]).alias("packages"))
    doc = F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("repo").alias("name"), "packages"))
    return per.select("repo", "part", F.size("packages").alias("packages"), doc.alias("document"))


def cyclonedx_documents(deps: DataFrame, size: int) -> DataFrame:
    """SNK7: ``repo, part, components, document``: CycloneDX 1.5 texts, as ``spdx_documents``."""
    rows = _numbered(deps, size)
    component = F.struct("n", F.struct(F.lit("library").alias("type"), "name", "version", "purl").alias("c"))
    per = rows.groupBy("repo", "part").agg(F.transform(F.array_sort(F.collect_list(component)), lambda x: x["c"]).alias("components"))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components"))
    return per.select("repo", "part", F.size("components").alias("components"), doc.alias("document"))


def _numbered(deps: DataFrame, size: int) -> DataFrame:
    """Distinct packages with ``part`` by hash and ``n``, their place in the part."""
    from pyspark.sql import Window

    some = deps.select("repo", "name", "version", "purl").distinct()
    counts = some.groupBy("repo").agg(F.count("*").alias("all"))
    part = F.pmod(F.xxhash64("purl"), F.floor((F.col("all") - 1) / size) + 1)
    order = Window.partitionBy("repo", "part").orderBy("purl", "name", "version")
    return some.join(counts, "repo").withColumn("part", part).withColumn("n", F.row_number().over(order) - 1)


def advisories_of(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """JN15: ``repo, name, version, id, severity, fixed_version, source`` of every dependency with an advisory.

    Advisories of all sources are one table; the same advisory from several sources counts once, by its first source.
    """
    a = advisories.groupBy(F.lower("name").alias("name"), "id").agg(F.min(F.struct("source", "severity", "fixed_version")).alias("a"))
    d = deps.select("repo", F.lower("name").alias("name"), "version").distinct()
    return d.join(a, "name").select("repo", "name", "version", "id", "a.severity", "a.fixed_version", "a.source")


def pinned(deps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AGG26: dependencies and the pinned ones (``==``) per group."""
    return deps.groupBy(*groups).agg(F.count("*").alias("dependencies"), F.count_if(F.contains("specifier", F.lit("=="))).alias("pinned"))
