"""Syntax-tree operators on a small fixture with results worked out by hand.

SQL cannot parse Python. The queries of ``q_code`` run the same operators over the whole files table; here each is
compared with rows that were derived on paper from the sources below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import syntax_tree as trees
from codestrata.plans import q_code
from codestrata.plans.samples import values

SHOP = '''import os, sys
from shop.base import Base


class Store(Base):
    """Keeps things."""
    limit: int = 3
    size = 4

    def __init__(self, path: str, *args, **kw):
        self.path = path

    def get(self, key):
        """Return one.

        :param key: which
        :returns: the value, for example of a longer text that goes on until it is over a hundred characters
        """
        if key and self.limit or key > 3:
            for i in range(key):
                try:
                    print(i)
                except:
                    pass
        return [y for y in range(3) if y]

    def create(self):
        return make_query("SELECT a FROM t WHERE b = " + self.path)

    def save(self): pass


class Once:
    def __new__(cls): return object()
    def get_factory(self): pass


def plain(a, b, c, d, e, f) -> int:
    x = 1
    x = x + 1
    x = 2
    x = 3
    return x
'''
TESTS = '''import random, subprocess, requests
password = "winter-garden"
token = "short"

@pytest.fixture
def box(): return random.choice([1])

@pytest.mark.parametrize("a", [1])
def test_one(self, a):
    self.assertEqual(a, 1)
    assert_close(a, 1)

def test_two():
    subprocess.run(cmd, shell=True)
    requests.get(url, verify=False)
    try:
        go()
    except ValueError:
        eval("1")
    # TODO: more
'''
SOURCES = [(1, "a", "shop/store.py", SHOP), (2, "a", "tests/test_store.py", TESTS), (3, "b", "copy.py", SHOP.replace("Store", "Shelf")), (4, "b", "broken.py", "def ("), (5, "b", "empty.py", ""), (6, "b", "none.py", None), (7, "b", "x.js", "def x(): pass")]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "file_id bigint, repo string, path string, content string")


def ast1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST1: nodes of some kinds by file; what does not parse has none."""
    n = trees.nodes(_files(spark)).filter(F.col("kind").isin("Module", "ClassDef", "FunctionDef", "Import", "ImportFrom", "Try", "For", "If", "ListComp", "Return"))
    return n.groupBy("file_id", "kind").agg(F.count("*").alias("n"))


def ast2_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST2, AST3, AST4, AST5, AST6, AST14."""
    return q_code.risky_nodes(trees.nodes(_files(spark)))


def ast7_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST7, AST8, AST9: functions, complexity, cognitive count, nesting, lines."""
    return trees.modules(_files(spark)).select("file_id", "functions", "max_complexity", "cognitive", "nesting", "loc", "lloc", "comments", "blank")


def ast10_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST10, AST12, AST13, FLT10: functions with their measures."""
    return trees.functions(_files(spark)).filter("file_id < 3").select("file_id", "name", "owner", "line", "length", "params", "returns", "complexity", "has_doc", "typed", "assert_calls", "injected", "decorators", "bare_excepts")


def ast11_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST11, AST16, MISC11, SET3: classes with their measures and flags."""
    return q_code._class_flags(trees.classes(_files(spark)).filter("file_id = 1"))


def ast13_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST13, AST14: tests with assertion calls, parameters and fixtures, and those without assertions."""
    return q_code.test_structure(_files(spark))


def agg11_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AST16: patterns that a repository shows anywhere."""
    return q_code.pattern_flags(_files(spark))


def ast15_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST15: imports with the names they bring."""
    n = trees.nodes(_files(spark)).filter(F.col("kind").isin("Import", "ImportFrom"))
    return n.select("file_id", "kind", "name", F.element_at("attrs", "names").alias("names"), "line")


def ast18_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST18: files of one structure, however their names differ."""
    return trees.signatures(_files(spark)).groupBy("sig").agg(F.count("*").alias("files"), F.min("file_id").alias("first")).drop("sig")


def ast19_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AST19: names that are set more than three times."""
    n = trees.nodes(_files(spark)).filter(F.col("kind").isin("FunctionDef", "ClassDef") | (F.col("kind") == "Name") & (F.element_at("attrs", "stored") == "True"))
    return n.groupBy("file_id", "name").agg(F.count("*").alias("n")).filter("n > 3")


def pat14_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT14: quality of docstrings."""
    return trees.functions(_files(spark)).filter("has_doc").select("file_id", "name", trees.doc_quality(F.col("doc")).alias("quality"))


#: Rules beside the shipped ones: combinations of each logic, one with an unknown part, and a disabled rule.
MORE_RULES = [
    {"id": "any-risk", "type": "composite", "severity": "low", "sub_rules": ["eval-usage", "no-bare-except"], "composite_logic": "any"},
    {"id": "all-risks", "type": "composite", "severity": "high", "sub_rules": ["eval-usage", "todo-comments", "hardcoded-password"], "composite_logic": "all"},
    {"id": "never", "type": "composite", "severity": "high", "sub_rules": ["eval-usage", "unknown"], "composite_logic": "all"},
    {"id": "calm", "type": "composite", "severity": "info", "sub_rules": ["no-print-statements", "eval-usage", "unknown"], "composite_logic": "none"},
    {"id": "off", "type": "regex_pattern", "severity": "low", "regex_pattern": "import", "enabled": False},
]


def ext3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT2, EXT3, EXT4, EXT5, AST17, PAT6, JN7, FLT9: the shipped rules and all kinds of combinations."""
    return q_code.counted_rules(_files(spark).filter("content IS NOT NULL AND path LIKE '%.py'"), q_code.RULES + MORE_RULES)


QUERIES = {f.__name__: f for f in (ast1_nodes, ast2_risks, ast7_measures, ast10_functions, ast11_classes, ast13_tests, agg11_flags, ast15_imports, ast18_signatures, ast19_identifiers, pat14_quality, ext3_rules)}

_SHOP_KINDS = [("Module", 1), ("Import", 1), ("ImportFrom", 1), ("ClassDef", 2), ("FunctionDef", 7), ("If", 1), ("For", 1), ("Try", 1), ("ListComp", 1), ("Return", 4)]
_NODES = [*((1, k, n) for k, n in _SHOP_KINDS), *((3, k, n) for k, n in _SHOP_KINDS), (2, "Module", 1), (2, "Import", 1), (2, "FunctionDef", 3), (2, "Try", 1), (2, "Return", 1), (5, "Module", 1)]
_SHOP_RISKS = [(22, "print-call"), (23, "bare-except"), (28, "sql-concat")]
_RISKS = [*((1, *r) for r in _SHOP_RISKS), *((3, *r) for r in _SHOP_RISKS), (2, 2, "literal-credential"), (2, 6, "weak-random"), (2, 14, "shell-true"), (2, 15, "verify-false")]
ORACLES = {
    "ast1_nodes": f"SELECT file_id::BIGINT AS file_id, kind, n::BIGINT AS n FROM {values(_NODES)} AS t(file_id, kind, n)",
    "ast2_risks": f"SELECT file_id::BIGINT AS file_id, line::INTEGER AS line, rule_id FROM {values(_RISKS)} AS t(file_id, line, rule_id)",
    "ast15_imports": "SELECT * FROM (VALUES (1::BIGINT, 'Import', 'os,sys', NULL, 1), (1, 'ImportFrom', 'shop.base', 'Base', 2), (3, 'Import', 'os,sys', NULL, 1), (3, 'ImportFrom', 'shop.base', 'Base', 2), (2, 'Import', 'random,subprocess,requests', NULL, 1)) AS t(file_id, kind, name, names, line)",
    "ast18_signatures": "SELECT * FROM (VALUES (2::BIGINT, 1::BIGINT), (1, 2), (1, 5)) AS t(files, first)",
    "ast19_identifiers": "SELECT * FROM (VALUES (1::BIGINT, 'x', 4::BIGINT), (3, 'x', 4)) AS t(file_id, name, n)",
    "pat14_quality": "SELECT * FROM (VALUES (1::BIGINT, 'get', 90), (3, 'get', 90)) AS t(file_id, name, quality)",
    "ast7_measures": """SELECT * FROM (VALUES (1::BIGINT, 7, 8, 7, 5, 44, 31, 0, 12), (3, 7, 8, 7, 5, 44, 31, 0, 12), (2, 3, 2, 2, 2, 21, 14, 1, 4), (5, 0, 0, 0, 0, 1, 0, 0, 1))
AS t(file_id, functions, max_complexity, cognitive, nesting, loc, lloc, comments, blank)""",
    "ast10_functions": """SELECT * FROM (VALUES (1::BIGINT, '__init__', 'Store', 10, 2, 3, 0, 1, false, true, 0, true, '', 0), (1, 'get', 'Store', 13, 13, 1, 1, 8, true, false, 0, false, '', 1),
(1, 'create', 'Store', 27, 2, 0, 1, 1, false, false, 0, false, '', 0), (1, 'save', 'Store', 30, 1, 0, 0, 1, false, false, 0, false, '', 0), (1, '__new__', 'Once', 34, 1, 0, 1, 1, false, false, 0, false, '', 0),
(1, 'get_factory', 'Once', 35, 1, 0, 0, 1, false, false, 0, false, '', 0), (1, 'plain', NULL, 38, 6, 6, 1, 1, false, true, 0, false, '', 0), (2, 'box', NULL, 6, 1, 0, 1, 1, false, false, 0, false, 'pytest.fixture', 0),
(2, 'test_one', NULL, 9, 3, 1, 0, 1, false, false, 2, false, 'pytest.mark.parametrize(''a'', [1])', 0), (2, 'test_two', NULL, 13, 7, 0, 0, 2, false, false, 0, false, '', 0))
AS t(file_id, name, owner, line, length, params, returns, complexity, has_doc, typed, assert_calls, injected, decorators, bare_excepts)""",
    "ast11_classes": """SELECT * FROM (VALUES ('a', 1::BIGINT, 'Store', 4, 3, 0, 2, true, true, false, false, false), ('a', 1, 'Once', 2, 1, 0, 0, false, false, true, true, false))
AS t(repo, file_id, name, methods, public, private, attributes, has_doc, is_repository, is_factory, is_singleton, is_god_class)""",
    "ext3_rules": """SELECT repo, rule_id, severity, n::BIGINT AS matches FROM (VALUES ('a', 'eval-usage', 'high', 1), ('a', 'hardcoded-password', 'high', 2), ('a', 'high-complexity', 'medium', 1), ('a', 'no-bare-except', 'medium', 1),
('a', 'no-print-statements', 'low', 1), ('a', 'todo-comments', 'info', 1), ('b', 'high-complexity', 'medium', 1), ('b', 'no-bare-except', 'medium', 1), ('b', 'no-print-statements', 'low', 1),
('a', 'any-risk', 'low', 2), ('b', 'any-risk', 'low', 1), ('a', 'all-risks', 'high', 1), ('b', 'calm', 'info', 2)) AS t(repo, rule_id, severity, n)""",
    "ast13_tests": "SELECT * FROM (VALUES ('a', 2::BIGINT, 2::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 0::BIGINT)) AS t(repo, tests, assert_calls, without_assertions, parametrized, fixtures, bare_excepts)",
    "agg11_flags": "SELECT * FROM (VALUES ('a', true, true, true, true, false, false), ('b', true, true, true, true, false, false)) AS t(repo, repository, factory, singleton, injection, mvc, clean)",
}
