"""Build files, packages, inventories, advisories, caches, settings, components and report texts on small cases."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from codestrata import config
from codestrata.operators import builds, cache
from codestrata.operators import dependencies as deps
from codestrata.operators.graph import strong_components
from codestrata.operators.syntax_tree import doc_quality
from codestrata.sources import reports
from codestrata.sources import tool_reports as tools

FILES = "file_id bigint, repo string, path string, content string, kind string, part string"


def files(spark, *rows):
    return spark.createDataFrame([(i, r, p, c, "k", "p") for i, (r, p, c) in enumerate(rows)], FILES)


def test_build_files_with_odd_contents(spark):
    df = files(spark, ("r", "pom.xml", None), ("r", "pom.xml", ""), (None, "a/go.mod", "replace x => ./y"), ("r", None, "x"), ("r", "Makefile", "x" * 200_000), ("r", "notpom.xml", "1.0-SNAPSHOT"))
    got = sorted((r.file_id, r.rule_id) for r in builds.build_findings(df).collect())
    assert got == [(1, "unmanaged_dependencies"), (2, "go_mod_local_replace"), (2, "go_mod_replace"), (4, "makefile_hardening"), (4, "makefile_warnings")]
    assert builds.build_findings(df.limit(0)).count() == 0 and builds.package_findings(df.limit(0)).count() == 0


def test_packages_and_kinds(spark):
    df = files(spark, ("y", "yarn.lock", ""), ("y", "package.json", '{"workspaces": ["w.x/*"]}'), ("y", "w.x/a/package.json", '{"name": "a"}'), ("y", "wyx/b/package.json", '{"name": "b"}'), ("plain", "yarn.lock", None), ("plain", "package.json", "{}"), (None, "lerna.json", '{"packages": null}'))
    assert {r.repo: r.kind for r in builds.monorepo_kind(df).collect()} == {"y": "yarn", "plain": "none", None: "lerna"}
    assert [(r.path, r.name, r.manager) for r in builds.monorepo_packages(df).collect()] == [("w.x/a", "a", "yarn")]  # a dot is a dot


def test_inventories_in_parts(spark):
    d = spark.createDataFrame([("r", f"p{i}", "1", f"pkg:npm/p{i}@1") for i in range(25)] * 2 + [("q", 'a"b', None, "pkg:x")], "repo string, name string, version string, purl string")
    for make, field in ((builds.spdx_documents, "packages"), (builds.cyclonedx_documents, "components")):
        rows = make(d, 10).collect()
        docs = [json.loads(r.document) for r in rows if r.repo == "r"]
        assert sum(len(x[field]) for x in docs) == 25 and len(docs) > 1
        assert json.loads(next(r.document for r in rows if r.repo == "q"))[field][0]["name"] == 'a"b'


def test_advisories_once_per_id(spark):
    a = spark.createDataFrame([("osv", "Foo", "1", "high", "2"), ("depsdev", "foo", "1", "low", ""), ("osv", "bar", "9", "low", "")], "source string, name string, id string, severity string, fixed_version string")
    d = spark.createDataFrame([("r", "foo", "1.0"), ("r", "FOO", "1.0"), ("r", "none", None)], "repo string, name string, version string")
    assert [(r.name, r.id, r.severity, r.source) for r in builds.advisories_of(d, a).collect()] == [("foo", "1", "low", "depsdev")]


def test_readers_of_unreadable_reports(spark):
    bad = spark.createDataFrame([("r", None), ("r", ""), ("r", "no report"), (None, "{}"), ("r", "[]")], "repo string, report string")
    for reader in (tools.audit_findings, tools.outdated_packages, tools.installed_packages, tools.package_licenses, tools.native_findings, tools.build_log_findings):
        assert reader(bad).count() == 0
    assert {r.decision for r in tools.policy_decisions(bad).collect()} == {"WARN", "ALLOW"} and not any(r.verified for r in tools.signatures(bad).collect())
    assert {r.score for r in tools.mutation_totals(bad).collect()} == {0.0}


def test_cache(spark):
    t = dt.datetime(2025, 1, 10)
    e = [("k", "s1", t, "new"), ("k", "s1", t - dt.timedelta(1), "old"), ("k", "s2", t - dt.timedelta(9), "aged"), ("z", "s1", t, "other")]
    entries = spark.createDataFrame(e, "key string, state string, created_at timestamp_ntz, value string")
    wanted = spark.createDataFrame([("k", "s1"), ("k", "s2"), ("k", "s3"), ("x", "s1")], "key string, state string")
    got = {(r.key, r.state): (r.outcome, r.value) for r in cache.lookup(wanted, entries, F.lit(t).cast("timestamp_ntz"), 86400).collect()}
    assert got == {("k", "s1"): ("hit", "new"), ("k", "s2"): ("expired", None), ("k", "s3"): ("changed", None), ("x", "s1"): ("miss", None)}
    assert cache.stats(cache.invalidate(entries, wanted)).first().entries == 1 and cache.stats(entries.limit(0)).first().chars == 0
    a = spark.createDataFrame([("r", "a", "1"), ("r", "b", None)], "repo string, path string, content string")
    b = spark.createDataFrame([("r", "b", ""), ("r", "a", "1")], "repo string, path string, content string")
    c = spark.createDataFrame([("r", "b", "1"), ("r", "a", "")], "repo string, path string, content string")
    one, two, three = (cache.state_hash(x, ["repo"]).first().state for x in (a, b, c))
    assert one == two != three


def test_settings():
    base = {"a": {"n": 1, "f": 0.5, "b": True, "l": ["x"]}, "s": "t"}
    got = config.with_environment(config.merged(base, {"a": {"n": 2}}), {"CODESTRATA_A_N": "7", "CODESTRATA_A_F": "x", "CODESTRATA_A_B": "off", "CODESTRATA_A_L": "p, q,", "CODESTRATA_S": "u"})
    assert got == {"a": {"n": 7, "f": 0.5, "b": False, "l": ["p", "q"]}, "s": "u"} and base["a"]["n"] == 1
    assert config.flat(got)["a.l"] == "p,q"


@pytest.mark.parametrize("seed", range(3))
def test_components_against_reachability(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(20)}
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for i in range(n):
                if a in reach[i]:
                    reach[i].add(b)
    want = {}
    for i in range(n):
        group = {j for j in reach[i] if i in reach[j]}
        if len(group) > 1:
            want[i] = (min(group), len(group))
    df = spark.createDataFrame(sorted(edges) * 2, "src bigint, dst bigint")
    assert {r.node: (r.component, r.size) for r in strong_components(df).collect()} == want
    assert strong_components(df.limit(0)).count() == 0


def test_pages_escape_and_comparisons_hide(spark):
    s = spark.createDataFrame([("<r>", "a&b", 55.0), ("<r>", "null", None)], "repo string, category string, score double")
    f = spark.createDataFrame([("<r>", i, "high", "<x>", "p") for i in range(30)] + [("<r>", 99, "low", "y", "p")], "repo string, ord bigint, severity string, rule_id string, file_path string")
    page = reports.html(s, f, 3).first().document
    assert "&lt;r&gt;" in page and "a&amp;b" in page and page.count("<li>") == 3 and "<x>" not in page
    d = spark.createDataFrame([("r", 2, "a", 50.0, 50.05, 0.0, "unchanged"), ("r", 2, "b", 50.0, 20.0, -30.0, "regressed"), ("r", 2, "c", None, 90.0, 90.0, "new")], "repo string, snapshot_no int, category string, before double, after double, delta double, change string")
    text = reports.comparison(d).first().document
    assert text.splitlines()[1:] == ["  [-] b                     50.0 ->  20.0 (-30.0)", "  [+] c                      0.0 ->  90.0 (+90.0)"]
    assert [c["category"] for c in json.loads(reports.comparison(d, "json").first().document)["categories"]] == ["b", "c"]


def test_docstring_points(spark):
    full = "Sum.\n\n:param a: x\n:returns: y\n:raises E: z\nExample: " + "long " * 30
    df = spark.createDataFrame([(0, None), (1, ""), (2, "Sum."), (3, full), (4, "\n  \n>>> f()")], "i int, doc string")
    assert {r.i: r.q for r in df.select("i", doc_quality(F.col("doc")).alias("q")).collect()} == {0: 0, 1: 0, 2: 20, 3: 100, 4: 30}


def test_pinned(spark):
    df = spark.createDataFrame([("r", "requirements.txt", "a==1\nb>=2\nc"), ("r", "requirements.txt", None)], "repo string, path string, content string")
    assert builds.pinned(deps.all_dependencies(df), ["repo"]).first().asDict() == {"repo": "r", "dependencies": 3, "pinned": 1}


@pytest.mark.parametrize("key", ["", "k", "long " * 40, "é"])
def test_keyed_hashes(spark, key):
    import hashlib
    import hmac

    from codestrata.functions.hashes import hmac_sha256

    df = spark.createDataFrame([("",), ("text é",), (None,)], "m string")
    got = [r.h for r in df.select(hmac_sha256(key, F.col("m")).alias("h")).collect()]
    assert got == [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in ("", "text é")] + [None]
