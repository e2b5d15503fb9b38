"""Dependencies: manifests to one table, package URLs, licenses, look-alike names, outdated versions, inventories.

Line- and pattern-shaped manifests are read by built-in functions; TOML, for which Spark has none, by Arrow
batches in Python.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import basename
from codestrata.functions.severity import lookup
from codestrata.operators.builds import cyclonedx_documents

# ---- Fixed values ------------------------------------------------------------------------------------
#: Spellings of licenses and their SPDX identifiers; any other spelling is its own upper case.
SPDX = {
    "mit": "MIT",
    "apache 2.0": "Apache-2.0",
    "apache-2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "bsd 3-clause": "BSD-3-Clause",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "bsd-2-clause": "BSD-2-Clause",
    "gpl 3.0": "GPL-3.0-only",
    "gpl-3.0": "GPL-3.0-only",
    "gpl 2.0": "GPL-2.0-only",
    "gpl-2.0": "GPL-2.0-only",
    "lgpl 3.0": "LGPL-3.0-only",
    "lgpl-3.0": "LGPL-3.0-only",
    "lgpl 2.1": "LGPL-2.1-only",
    "lgpl-2.1": "LGPL-2.1-only",
    "agpl 3.0": "AGPL-3.0-only",
    "agpl-3.0": "AGPL-3.0-only",
    "mpl 2.0": "MPL-2.0",
    "mpl-2.0": "MPL-2.0",
    "apache": "Apache-2.0",
    "bsd": "BSD-3-Clause",
    "gpl": "GPL-3.0-only",
    "lgpl": "LGPL-3.0-only",
    "mpl": "MPL-2.0",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "public domain": "Unlicense",
}
ALLOWED_LICENSES = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC"]
BLOCKED_LICENSES = ["GPL-3.0", "AGPL-3.0", "LGPL-3.0"]
#: Endings that look-alike packages add to a name.
LOOKALIKE_ENDINGS = ["s", "2", "-utils", "-tools", "-lib", "-client"]
REQUIREMENT = r"^([a-zA-Z0-9_\-.]+)([=<>!~]+.*)?"
SYSTEM_INSTALL = r"(?:apt-get install|apk add|yum install)\s+([^\n&|;]+)"
# ------------------------------------------------------------------------------------------------------

DEPS = "repo string, source_file string, name string, specifier string, version string, ecosystem string, purl string"
_COLUMNS = ["repo", "source_file", "name", "specifier", "version", "ecosystem", "purl"]


def spdx(license_text: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(license_text)), SPDX), F.upper(license_text))


def license_status(license_text: Column) -> Column:
    """blocked or allowed by substring either way; else unknown."""
    either = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(license_text, n) | F.contains(n, license_text))
    return F.when(either(BLOCKED_LICENSES), "blocked").when(either(ALLOWED_LICENSES), "allowed").otherwise("unknown")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.when(version.isNull() | (version == ""), F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name)).otherwise(
        F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name, F.lit("@"), version)
    )


def _rows(df: DataFrame, name: Column, specifier: Column, version: Column, ecosystem: str) -> DataFrame:
    eco = F.lit(ecosystem)
    return df.select("repo", F.col("path").alias("source_file"), name.alias("name"), specifier.alias("specifier"), version.alias("version"), eco.alias("ecosystem"), purl(eco, name, version).alias("purl"))


def requirement(line: Column) -> tuple[Column, Column, Column]:
    """Name (lower case), specifier and bare version of a requirement line."""
    text = F.trim(line)
    specifier = F.trim(F.split(F.regexp_extract(text, REQUIREMENT, 2), r"[;#]")[0])
    return F.lower(F.regexp_extract(text, REQUIREMENT, 1)), specifier, F.coalesce(F.nullif(F.ltrim(specifier, F.lit("=<>!~ ")), F.lit("")), F.lit("unknown"))


def requirements_txt(files: DataFrame) -> DataFrame:
    rows = files.filter(basename("path").rlike(r"^requirements.*\.txt$")).select("repo", "path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    rows = rows.filter((F.trim("line") != "") & ~F.trim("line").rlike(r"^[#-]"))
    n, s, v = requirement(F.col("line"))
    return _rows(rows, n, s, v, "pypi")


def setup_py(files: DataFrame) -> DataFrame:
    inner = F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    rows = files.filter(basename("path") == "setup.py").select("repo", "path", F.explode(F.split(inner, ",")).alias("item"))
    rows = rows.withColumn("line", F.trim(F.translate(F.trim("item"), "'\"\n\r", ""))).filter("line <> ''")
    n, s, v = requirement(F.col("line"))
    return _rows(rows, n, s, v, "pypi")


def package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies of package.json, the latter winning."""
    maps = F.from_json("content", "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>")
    rows = files.filter(basename("path") == "package.json").select("repo", "path", maps.alias("m"))
    empty = F.create_map().cast("map<string,string>")
    dev, main = F.coalesce("m.devDependencies", empty), F.coalesce("m.dependencies", empty)
    kept = F.map_concat(F.map_filter(main, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    rows = rows.select("repo", "path", F.explode(kept).alias("name", "spec"))
    return _rows(rows, F.col("name"), F.col("spec"), F.ltrim("spec", F.lit("^~>=< ")), "npm")


def package_lock(files: DataFrame) -> DataFrame:
    """packages of package-lock.json; cut-off files give nothing."""
    parsed = F.from_json("content", "packages MAP<STRING,STRUCT<version:STRING,resolved:STRING,integrity:STRING>>")
    rows = files.filter(basename("path") == "package-lock.json").select("repo", "path", F.explode(parsed["packages"]).alias("key", "p"))
    rows = rows.filter("key <> ''").withColumn("name", F.regexp_replace("key", r"^(?:.*/)?node_modules/", ""))
    return _rows(rows, F.col("name"), F.concat(F.lit("=="), F.col("p.version")), F.col("p.version"), "npm")


def poetry_lock(files: DataFrame) -> DataFrame:
    """[[package]] entries of poetry.lock, by their two leading lines."""
    entry = r"\[\[package\]\]\r?\nname = \"([^\"]+)\"\r?\nversion = \"([^\"]+)\""
    f = files.filter(basename("path") == "poetry.lock")
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(entry), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(entry), F.lit(2)).alias("v"))
    rows = f.select("repo", "path", F.explode(both).alias("x"))
    return _rows(rows, F.lower("x.n"), F.concat(F.lit("=="), F.col("x.v")), F.col("x.v"), "pypi")


def dockerfile_packages(files: DataFrame) -> DataFrame:
    """System packages that image files install."""
    found = F.regexp_extract_all("content", F.lit(SYSTEM_INSTALL), F.lit(1))
    rows = files.filter(F.lower(basename("path")).rlike(r"^dockerfile(?:\..*)?$")).select("repo", "path", F.explode(found).alias("line"))
    rows = rows.select("repo", "path", F.explode(F.split(F.trim("line"), r"\s+")).alias("name")).filter("name NOT LIKE '-%' AND name <> '' AND name <> '\\\\'")
    return _rows(rows, F.col("name"), F.lit(""), F.lit("system"), "generic")


def _toml_deps(text: str) -> Iterator[tuple[str, str]]:
    try:
        doc = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return
    project = doc.get("project")
    if isinstance(project, dict):
        groups = [project.get("dependencies")]
        extra = project.get("optional-dependencies")
        groups += list(extra.values()) if isinstance(extra, dict) else []
        for group in groups:
            for item in group if isinstance(group, list) else []:
                if isinstance(item, str):
                    yield "line", item
    tool = doc.get("tool")
    poetry = tool.get("poetry") if isinstance(tool, dict) else None
    tables = []
    if isinstance(poetry, dict):
        tables.append(poetry.get("dependencies"))
        tables.append(poetry.get("dev-dependencies"))
        for g in (poetry.get("group") or {}).values() if isinstance(poetry.get("group"), dict) else []:
            tables.append(g.get("dependencies") if isinstance(g, dict) else None)
    tables += [doc.get("packages"), doc.get("dev-packages")]
    for t in tables:
        for name, spec in t.items() if isinstance(t, dict) else []:
            if name.lower() == "python":
                continue
            version = spec if isinstance(spec, str) else spec.get("version", "unknown") if isinstance(spec, dict) else "unknown"
            yield "pair", json.dumps([name.lower(), version if isinstance(version, str) else "unknown"])


def toml_manifests(files: DataFrame, names: str = r"^(?:pyproject\.toml|Pipfile)$") -> DataFrame:
    """Project, poetry and Pipfile dependencies; files that are no TOML give nothing."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r, p, kind, item) for r, p, text in zip(pdf["repo"], pdf["path"], pdf["content"], strict=True) for kind, item in _toml_deps(text)]
            if out:
                yield pd.DataFrame(out, columns=["repo", "path", "kind", "item"])

    some = files.filter(basename("path").rlike(names) & F.col("content").isNotNull()).select("repo", "path", "content")
    rows = some.mapInPandas(walk, "repo string, path string, kind string, item string")
    n, s, v = requirement(F.col("item"))
    lines = _rows(rows.filter("kind = 'line'"), n, s, v, "pypi")
    pair = F.from_json("item", "array<string>")
    pairs = _rows(rows.filter("kind = 'pair'"), pair[0], pair[1], F.ltrim(pair[1], F.lit("^~>=< ")), "pypi")
    return lines.unionByName(pairs)


def all_dependencies(files: DataFrame, toml_names: str = r"^(?:pyproject\.toml|Pipfile)$") -> DataFrame:
    """SRC17: every manifest routed to its reader; one table."""
    f = files.filter(F.col("content").isNotNull())
    parts = [requirements_txt(f), setup_py(f), package_json(f), package_lock(f), poetry_lock(f), dockerfile_packages(f), toml_manifests(f, toml_names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookalikes(names: DataFrame) -> DataFrame:
    """``name, other``: declared names that another declared name becomes by a usual look-alike change (self-join on variants)."""
    n = names.select(F.lower("name").alias("name")).distinct()
    x = F.col("name")
    shorter = F.when(F.length(x) > 3, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    variants = F.array(F.translate(x, "-", "_"), F.translate(x, "_", "-"), shorter, *[F.concat(x, F.lit(e)) for e in LOOKALIKE_ENDINGS])
    v = n.select("name", F.explode(F.array_distinct(variants)).alias("other")).filter("other <> name")
    return v.join(n.select(F.col("name").alias("other")), "other").select("name", "other")


def outdated(deps: DataFrame) -> DataFrame:
    """Packages whose major version is behind the newest one seen anywhere (version family, guarded casts)."""
    major = F.split_part("version", F.lit("."), F.lit(1)).try_cast("int")
    d = deps.select("repo", "ecosystem", "name", "version", major.alias("major")).filter("major IS NOT NULL").distinct()
    newest = F.max("major").over(Window.partitionBy("ecosystem", "name"))
    return d.withColumn("newest", newest).filter("major < newest")


def cyclonedx(deps: DataFrame, size: int = 10_000) -> DataFrame:
    """SNK7: CycloneDX documents per repository, components by package URL, at most ``size`` in each."""
    return cyclonedx_documents(deps, size)
