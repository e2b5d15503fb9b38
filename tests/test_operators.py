"""Core operators on small cases."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths, severity
from codestrata.operators import dependencies as deps
from codestrata.operators import graph, rules
from codestrata.operators import syntax_tree as trees
from codestrata.operators.compare import change_type, full_diff, latest
from codestrata.operators.patterns import CPP, SETS
from codestrata.operators.scan import java_regex, scan
from codestrata.operators.scoring import overall
from codestrata.sources import reports, repository

SCORES = [("complexity", 85.0, 2.0), ("security", 100.0, 3.0), ("testing", 20.0, 2.0), ("architecture", 100.0, 2.0), ("maintainability", 85.0, 1.5), ("dependencies", 100.0, 1.0), ("documentation", 0.0, 0.5), ("git_history", 50.0, 0.5)]
BAD = [("complexity", 65.0, 2.0), ("security", 16.0, 3.0), ("testing", 0.0, 2.0), ("architecture", 100.0, 2.0), ("maintainability", 73.0, 1.5), ("dependencies", 100.0, 1.0), ("documentation", 0.0, 0.5), ("git_history", 50.0, 0.5)]


def test_golden_scores(spark):
    lang = [(x, 100.0, 1.5) for x in ("javascript", "java", "go", "cpp")]
    rows = [("good", *r) for r in SCORES] + [("bad", *r) for r in BAD] + [("twelve", *r) for r in SCORES + lang] + [("none", "security", None, 3.0)]
    df = spark.createDataFrame(rows, "repo string, category string, score double, weight double")
    got = {r["repo"]: (r["overall_score"], r["risk_level"]) for r in overall(df, ["repo"]).collect()}
    assert got == {"good": (80.2, "low"), "bad": (61.2, "critical"), "twelve": (86.8, "low"), "none": (0.0, "critical")}


def test_scan_places_against_python(spark):
    texts = [
        "password = 'x'\n  token=\"y\"\r\néval(1) eval (2)\n",
        "yaml.load(a)\nyaml.load(b, Loader=yaml.SafeLoader)\n\nDEBUG  =\n True # debug=true",
        "subprocess.run('a' + b)\n" * 3,
        "",
        None,
        "no hit",
        "pickle.load(f)" + "x y" * 60_000 + "\npickle.loads(g)",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    for language, patterns in SETS.items():
        got = sorted((r.file_id, r.rule_id, r.start, r.line, r.column_start, r.column_end, r.snippet) for r in scan(df, patterns).collect())
        want = []
        for i, t in enumerate(texts):
            for p in patterns:
                for m in re.finditer(p.regex, t or "", (re.I if p.ignore_case else 0) | re.A):
                    bol = t.rfind("\n", 0, m.start()) + 1
                    want.append((i, p.id, m.start(), t.count("\n", 0, m.start()) + 1, m.start() - bol + 1, m.end() - bol + 1, t[bol:].split("\n")[0].strip()))
        assert got == sorted(want), language
    assert all("(?d)" in java_regex(p) or "(?id)" in java_regex(p) for p in CPP)


def test_paths(spark):
    rows = [("src/vendor_portal/a.py",), ("env/x.py",), ("environment/x.py",), ("a/b.min.js",), ("tests/t.go",), ("test_a.py",), ("attest.py",)]
    df = spark.createDataFrame(rows, "path string")
    got = df.select(
        "path", paths.excluded("path", ["env", "*.min.js"]).alias("loose"), paths.excluded("path", ["env", "*.min.js"], by_segment=True).alias("strict"),
        paths.is_test_file("path").alias("test"), paths.module_name("path").alias("m"),
    ).collect()
    assert [r.path for r in got if r.loose] == ["env/x.py", "environment/x.py", "a/b.min.js"]
    assert [r.path for r in got if r.strict] == ["env/x.py", "a/b.min.js"]
    assert [r.path for r in got if r.test] == ["tests/t.go", "test_a.py"]
    assert got[0].m == "src.vendor_portal.a"
    prefixes = spark.range(1).select(paths.module_prefixes(F.lit("a.b.c")).alias("p")).first().p
    assert prefixes == ["a", "a.b", "a.b.c"]
    assert re.match(paths.glob_regex("a[!b]?*.py"), "acd/e.py") and not re.match(paths.glob_regex("a[!b]*"), "ab")


def test_severity(spark):
    df = spark.createDataFrame([("critical", "9.8"), ("odd", "x"), (None, None)], "s string, c string")
    got = df.select(severity.rank(F.col("s")), severity.sarif_level(F.col("s")), severity.cvss_severity(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(0, "error", "critical"), (4, "warning", None), (4, "warning", None)]
    v = spark.range(1).select(severity.threshold_status(F.lit(16.0), F.lit(10.0)), severity.status(F.lit(40.0)), severity.clamp(F.lit(-3.0))).first()
    assert tuple(v) == ("fail", "WARN", 0.0)


def test_compare(spark):
    a = spark.createDataFrame([("k", 1.0), ("g", 5.0), (None, 2.0)], "key string, v double")
    b = spark.createDataFrame([("k", 4.0), ("n", 1.0), (None, 2.5)], "key string, v double")
    got = {r[0]: (r[1], r[2]) for r in full_diff(a, b, ["key"], "v").select("key", "before", "after").collect()}
    assert got == {"k": (1.0, 4.0), "g": (5.0, None), "n": (None, 1.0), None: (2.0, 2.5)}
    types = [r[0] for r in full_diff(a, b, ["key"], "v").orderBy("key").select(change_type(F.col("before"), F.col("after"))).collect()]
    assert types == ["unchanged", "removed", "improved", "new"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(r.v for r in latest(rows, ["k"], F.desc("n")).collect()) == ["y", "z"]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("a", "b"), ("e", "e")], "src string, dst string")
    assert sorted((r.path, r.length) for r in graph.cycles(e, 4).collect()) == [("a>b>c", 3), ("c>d", 2)]
    seeds = spark.createDataFrame([("d",)], "node string")
    got = dict((r.node, r.depth) for r in graph.closure(e, seeds).collect())
    assert got == {"d": 0, "c": 1, "b": 2, "a": 3}
    deg = {r.node: (r.fan_in, r.fan_out, r.instability) for r in graph.degrees(e).collect()}
    assert deg["c"] == (2, 2, 0.5) and deg["a"] == (1, 1, 0.5)
    none = e.limit(0)
    assert graph.degrees(none).count() == 0 and graph.cycles(none, 3).count() == 0 and graph.closure(none, seeds).count() == 1


MANIFESTS = [
    ("requirements.txt", "requests==2.25.1\n# c\n\n-r other\nFlask>=1,<2 ; python_version > '3'\nplain\n"),
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b"]\n[project.optional-dependencies]\nx = ["c~=2"]\n[tool.poetry.dependencies]\npython = "^3.9"\nd = "^1.2"\n[tool.poetry.group.dev.dependencies]\ne = {version = "~3"}\n'),
    ("bad/pyproject.toml", "[project\n"),
    ("Pipfile", '[packages]\nf = "*"\n[dev-packages]\ng = "==1"\n'),
    ("package.json", '{"dependencies": {"express": "^4.18.0", "x": "1"}, "devDependencies": {"x": "~2.0"}}'),
    ("package-lock.json", '{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b/node_modules/c": {"version": "2.0.0"}}}'),
    ("sub/package-lock.json", '{"packages": {"node_mod'),
    ("poetry.lock", '[[package]]\nname = "Foo"\nversion = "3.1"\n'),
    ("setup.py", "setup(install_requires=[\n 'h==1.0',\n \"i\",\n])"),
    ("Dockerfile", "RUN apt-get install -y curl  git && apk add bash\n"),
]


def test_manifests(spark):
    df = spark.createDataFrame([("r", p, c) for p, c in MANIFESTS] + [("r", "requirements.txt", None)], "repo string, path string, content string")
    got = {(r.name, r.version) for r in deps.all_dependencies(df).collect()}
    assert got == {
        ("requests", "2.25.1"), ("flask", "1,<2"), ("plain", "unknown"), ("a", "1"), ("b", "unknown"), ("c", "2"), ("d", "1.2"), ("e", "3"), ("f", "*"), ("g", "1"),
        ("express", "4.18.0"), ("x", "2.0"), ("a", "1.0.0"), ("c", "2.0.0"), ("foo", "3.1"), ("h", "1.0"), ("i", "unknown"), ("curl", "system"), ("git", "system"), ("bash", "system"),
    }
    doc = json.loads(deps.cyclonedx(deps.all_dependencies(df)).first().document)
    assert doc["bomFormat"] == "CycloneDX" and any(c["purl"] == "pkg:pypi/requests@2.25.1" for c in doc["components"])


@pytest.mark.parametrize(("text", "want"), [("MIT", "MIT"), (" apache 2.0", "Apache-2.0"), ("BSD 3-Clause", "BSD-3-Clause"), ("GPL-3.0", "GPL-3.0-only"), ("isc", "ISC"), ("Weird", "WEIRD")])
def test_licenses(spark, text, want):
    assert spark.range(1).select(deps.spdx(F.lit(text))).first()[0] == want


CODE = '''
import os, sys
from a.b import c

class Repo(Base):
    """Docs."""
    limit: int = 3
    def get(self, x: int) -> int:
        """Short."""
        if x and self.limit or x > 3:
            for i in range(x):
                try:
                    print(i)
                except:
                    pass
        return [y for y in range(3) if y]
    def save(self): pass
    def delete(self): pass
    async def _go(self): await x
password = "hunter2-hunter2"
requests.get(u, verify=False); subprocess.run(c, shell=True)
'''


def test_syntax_trees(spark):
    df = spark.createDataFrame([(1, "m.py", CODE), (2, "broken.py", "def ("), (3, "n.py", None), (4, "e.py", ""), (5, "x.js", "a")], "file_id bigint, path string, content string")
    fn = {r.name: r for r in trees.functions(df).collect()}
    assert fn["get"].complexity == 8 and fn["get"].params == 1 and fn["get"].has_doc and fn["get"].owner == "Repo" and fn["_go"].is_async
    cls = trees.classes(df).first()
    assert (cls.methods, cls.public, cls.private, cls.attributes, cls.bases) == (4, 3, 1, 1, "Base")
    mods = {r.file_id: r for r in trees.modules(df).collect()}
    assert set(mods) == {1, 4} and mods[1].nesting == 5 and mods[4].functions == 0 and mods[1].volume > 0
    n = trees.nodes(df).filter("file_id = 1")
    assert n.filter("kind = 'ImportFrom'").first().attrs["names"] == "c"
    assert n.count() == n.select("node").distinct().count() and n.filter("parent = -1").count() == 1


def test_rules(spark):
    df = spark.createDataFrame([(1, "m.py", CODE), (2, "n.py", "x = 1\n"), (3, "broken.py", "print(")], "file_id bigint, path string, content string")
    metrics = spark.createDataFrame([(1, "loc", 20.0), (2, "loc", 1.0)], "file_id bigint, name string, value double")
    base = [
        {"id": "print", "type": "ast_pattern", "severity": "low", "ast_pattern": "Call", "ast_condition": "name == 'print'"},
        {"id": "bare", "type": "ast_pattern", "severity": "low", "ast_pattern": "ExceptHandler", "ast_condition": "attr.type == ''", "tags": ["x"]},
        {"id": "pw", "type": "regex_pattern", "severity": "high", "regex_pattern": "PASSWORD", "regex_flags": 2},
        {"id": "long", "type": "metric_threshold", "severity": "low", "metric_name": "loc", "threshold": 10, "comparison": "gte"},
        {"id": "off", "type": "regex_pattern", "severity": "low", "regex_pattern": "x", "enabled": False},
    ]
    combos = [
        {"id": "all", "type": "composite", "severity": "low", "sub_rules": ["print", "pw"], "composite_logic": "all"},
        {"id": "any", "type": "composite", "severity": "low", "sub_rules": ["long", "missing"], "composite_logic": "any"},
        {"id": "none", "type": "composite", "severity": "low", "sub_rules": ["print"], "composite_logic": "none"},
        {"id": "vacuous", "type": "composite", "severity": "low", "sub_rules": ["missing"], "composite_logic": "all"},
    ]
    got = sorted((r.file_id, r.rule_id) for r in rules.apply(df, base + combos, metrics).collect())
    assert got == [(1, "all"), (1, "any"), (1, "bare"), (1, "long"), (1, "print"), (1, "pw"), (2, "none"), (3, "none")]
    assert {r.rule_id for r in rules.apply(df, base, metrics, tags=["x"]).collect()} == {"bare"}
    with pytest.raises(ValueError):
        rules.condition("__import__('os')")
    assert rules.apply(df, []).count() == 0


def test_tool_outputs(spark):
    rows = lambda x: spark.createDataFrame([("r", x)], "repo string, report string")
    b = {"results": [{"test_id": "B1", "issue_severity": "HIGH", "issue_confidence": "LOW", "issue_text": "t", "filename": "f.py", "line_number": 3, "line_range": [3, 4], "code": "c", "issue_cwe": {"id": 78}}]}
    r = repository.bandit_findings(rows(json.dumps(b))).first()
    assert (r.rule_id, r.severity, r.line_end, r.cwe) == ("B1", "high", 4, "CWE-78")
    e = [{"filePath": "a.js", "messages": [{"ruleId": "no-eval", "severity": 2, "message": "m", "line": 1, "column": 2}, {"ruleId": "q", "severity": 1, "message": "n", "line": 2}]}]
    assert [(x.rule_id, x.severity, x.line_end) for x in repository.eslint_findings(rows(json.dumps(e))).collect()] == [("no-eval", "high", 1), ("q", "low", 2)]
    v = repository.line_findings(rows("a.go:3:7: bad thing: here\nnoise\nb.go:9: other\n"), "go", "vet").collect()
    assert [(x.file_path, x.line_start, x.column_start, x.message) for x in v] == [("a.go", 3, 7, "bad thing: here"), ("b.go", 9, None, "other")]
    c = {"totals": {"percent_covered": 81.5}, "files": {"a": {"summary": {"percent_covered": 0}}, "b": {"summary": {"percent_covered": 90}}}}
    assert tuple(repository.coverage_totals(rows(json.dumps(c))).first()) == ("r", 81.5, 2, 1)
    a = {"id": "V1", "severity": [{"type": "CVSS_V3", "score": "9.8"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}]}]}
    adv = repository.advisories(spark.createDataFrame([("p", json.dumps(a)), ("q", "{}")], "name string, advisory string")).collect()
    assert [tuple(x) for x in adv] == [("p", "V1", "critical", "1.2"), ("q", None, "medium", "")]
    bad = rows("{")
    assert repository.bandit_findings(bad).count() == 0 and repository.eslint_findings(bad).count() == 0


def test_history_and_changes(spark):
    log = "\x1e" + "\x1f".join(["h1", "Ann", "a@x", "2024-01-02T23:30:00+05:30", "p1 p2", "fix | it"]) + "\nsrc/a.py\nb.py\n\x1e" + "\x1f".join(["h2", "Bo", "b@x", "2024-01-01T01:00:00-02:00", "p1", "add"]) + "\n"
    commits, touched = repository.parse_log(spark, spark.createDataFrame([("r", log)], "repo string, log string"))
    rows = commits.orderBy("commit_ord").collect()
    assert [(r.author, r.ts, r.utc_offset_min, r.message, r.is_merge, r.files_changed) for r in rows] == [
        ("Ann", dt.datetime(2024, 1, 2, 23, 30), 330, "fix | it", True, 2), ("Bo", dt.datetime(2024, 1, 1, 1, 0), -120, "add", False, 0),
    ]
    assert sorted(r.path for r in touched.collect()) == ["b.py", "src/a.py"]
    diff = "M\x00a.py\x00R100\x00old.py\x00new.py\x00D\x00gone.py\x00"
    got = repository.parse_changes(spark.createDataFrame([(diff,)], "diff string"))
    assert [tuple(r) for r in got.collect()] == [("M", "a.py", None), ("R", "old.py", "new.py"), ("D", "gone.py", None)]
    assert not repository.full_scan_needed(got) and repository.full_scan_needed(got, 2)


def test_scan_repository(spark, tmp_path):
    for path, data in {"a/x.py": b"print(1)\n", "a/build/y.py": b"no", "env/z.py": b"no", "environment/k.py": b"caf\xe9\n", "img.png": b"x", "README.md": b"# r"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: r.content for r in repository.scan_repository(spark, str(tmp_path), "r").collect()}
    assert got == {"a/x.py": "print(1)\n", "environment/k.py": "caf\n", "README.md": "# r"}


def test_reports(spark):
    s = spark.createDataFrame([("r", "security", 90.0, 3.0), ("r", "testing", 30.0, 2.0)], "repo string, category string, score double, weight double")
    f = spark.createDataFrame([("r", "security", "b", "high", "m", "x.py", 0, None, 2), ("r", "security", "a", "low", None, None, None, None, 1)], "repo string, category string, rule_id string, severity string, message string, file_path string, line_start int, line_end int, ord int")
    doc = json.loads(reports.sarif(f).first().document)
    assert [x["ruleId"] for x in doc["runs"][0]["results"]] == ["CA0001", "CA0002"] and doc["runs"][0]["results"][1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert reports.sarif(f, size=1).count() >= 1
    full = json.loads(reports.json_reports(s, f).first().document)
    assert [c["category"] for c in full["categories"]] == ["security", "testing"]
    assert reports.markdown(s).first().document.endswith("| testing | 30.0 | FAIL |\n| security | 90.0 | OK |\n")


def test_json_reports_keep_findings_without_a_score(spark):
    s = spark.createDataFrame([("r", "security", 90.0, 3.0), ("only scores", "testing", 30.0, 2.0)], "repo string, category string, score double, weight double")
    rows = [("r", "security", "a"), ("r", "complexity", "b"), ("only findings", "complexity", "c")]
    f = spark.createDataFrame([(*x, "low", None, "x.py", 1) for x in rows], "repo string, category string, rule_id string, severity string, message string, file_path string, line_start int")
    for size in (1, 10):
        docs = [json.loads(r.document) for r in reports.json_reports(s, f, size).collect()]
        got = sorted((d["repository"], c["category"], x["rule_id"]) for d in docs for c in d["categories"] for x in c.get("findings", []))
        assert got == sorted(rows)
        names = {(d["repository"], d["part"]): [(c["category"], c.get("score")) for c in d["categories"]] for d in docs}
        assert {k for k, _ in names} == {"r", "only scores", "only findings"}
        assert all(x == [("complexity", None), ("security", 90.0)] for (repo, _), x in names.items() if repo == "r")


def test_reports_are_of_each_last_snapshot(spark, tmp_path):
    from codestrata.plans import registry

    t = dt.datetime(2025, 1, 1)
    finds = [(1, 8, "later", "old"), (2, 9, "later", "new"), (3, 2, "earlier", "old"), (4, 3, "earlier", "new"), (5, 8, "then scores", "old")]
    schema = "row_id bigint, snapshot_no int, repo string, category string, rule_id string, severity string, message string, file_path string, line_start int, line_end int, loaded_at timestamp_ntz"
    spark.createDataFrame([(i, n, r, "security", rule, "low", None, "x.py", 1, 1, t) for i, n, r, rule in finds], schema).write.parquet(f"{tmp_path}/findings.parquet")
    schema = "row_id bigint, snapshot_no int, repo string, category string, score double, weight double, loaded_at timestamp_ntz"
    spark.createDataFrame([(1, 8, "later", "testing", 10.0, 1.0, t), (2, 9, "then scores", "testing", 20.0, 1.0, t)], schema).write.parquet(f"{tmp_path}/category_scores.parquet")
    docs = [json.loads(r.document) for r in registry.queries()["snk1_json_reports"](spark, str(tmp_path)).collect()]
    got = {d["repository"]: [(c["category"], c.get("score"), [x["rule_id"] for x in c.get("findings", [])]) for c in d["categories"]] for d in docs}
    assert got == {"later": [("security", None, ["new"])], "earlier": [("security", None, ["new"])], "then scores": [("testing", 20.0, [])]}
    sarif = {r.repo: json.loads(r.document)["runs"][0]["tool"]["driver"]["rules"] for r in registry.queries()["snk2_sarif"](spark, str(tmp_path)).collect()}
    assert {repo: [x["name"] for x in rules] for repo, rules in sarif.items()} == {"later": ["new"], "earlier": ["new"]}


def test_closure_of_a_deep_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(70)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted((r.node, r.depth) for r in graph.closure(e, seeds).collect()) == [(i, i) for i in range(71)]
    with pytest.raises(ValueError):
        graph.closure(e, seeds, max_rounds=2)
