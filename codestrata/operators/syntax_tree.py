"""Syntax trees of Python files as tables.

A file is parsed once, in Arrow batches; everything after that is relational. Files that do not parse give no
rows. Measures follow published formulas: McCabe's cyclomatic number, Halstead's volume, the maintainability
index.
"""

from __future__ import annotations

import ast
import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import extension

NODES = "file_id bigint, node bigint, parent bigint, kind string, name string, line int, end_line int, depth int, attrs map<string,string>"
FUNCTIONS = (
    "file_id bigint, name string, owner string, line int, length int, params int, returns int, complexity int, has_doc boolean, typed boolean, "
    "doc string, is_async boolean, assert_calls int, injected boolean, decorators string, bare_excepts int"
)
CLASSES = "file_id bigint, name string, line int, methods int, public int, private int, attributes int, has_doc boolean, bases string, method_names array<string>"
MODULES = (
    "file_id bigint, functions int, avg_complexity double, max_complexity int, cognitive int, nesting int, loc int, lloc int, comments int, blank int, "
    "volume double, difficulty double, effort double, bugs double, maintainability double"
)
_NESTING = (ast.If, ast.While, ast.For, ast.Try, ast.With, ast.FunctionDef, ast.ClassDef)
_DECISIONS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.match_case)
_HARD = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _parse(text: str | None) -> ast.Module | None:
    if text is None:
        return None
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _decisions(node: ast.AST) -> int:
    """What a node adds to the cyclomatic number of the code around it."""
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    return int(isinstance(node, _DECISIONS))


def _hardness(node: ast.AST) -> int:
    """What a node adds to the weighted count of constructs that make code hard to follow."""
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.Try):
        return len(node.handlers)
    return int(isinstance(node, _HARD))


class _Function:
    """Counts over the body of a function, with those of the functions in it."""

    __slots__ = ("assert_calls", "bare_excepts", "complexity", "node", "owner", "returns")

    def __init__(self, node: ast.AST, owner: str | None):
        self.node, self.owner, self.complexity, self.returns, self.assert_calls, self.bare_excepts = node, owner, 1, 0, 0, 0


class _Walk:
    """All counts of a file in one walk over its tree."""

    def __init__(self, tree: ast.Module):
        self.functions: list[_Function] = []
        self.complexity, self.cognitive, self.nesting, self.statements = 1, 0, 0, 0
        self.operators: Counter = Counter()
        self.operands: Counter = Counter()
        todo: list[tuple[ast.AST, ast.AST | None, int, tuple[_Function, ...]]] = [(tree, None, 0, ())]
        while todo:
            node, parent, depth, inside = todo.pop()
            if isinstance(node, _FUNCS):
                here = _Function(node, parent.name if isinstance(parent, ast.ClassDef) else None)
                self.functions.append(here)
                inside = (*inside, here)
            self._count(node, inside)
            self.nesting = max(self.nesting, depth)
            below = depth + isinstance(node, _NESTING)
            todo += [(child, node, below, inside) for child in ast.iter_child_nodes(node)]

    def _count(self, node: ast.AST, inside: tuple[_Function, ...]) -> None:
        n = _decisions(node)
        self.complexity += n
        self.cognitive += _hardness(node)
        self.statements += isinstance(node, ast.stmt)
        returns = isinstance(node, ast.Return)
        asserts = isinstance(node, ast.Call) and _last_name(node.func).startswith("assert")
        bare = isinstance(node, ast.ExceptHandler) and node.type is None
        if n or returns or asserts or bare:
            for f in inside:
                f.complexity += n
                f.returns += returns
                f.assert_calls += asserts
                f.bare_excepts += bare
        if isinstance(node, ast.BinOp | ast.UnaryOp | ast.BoolOp | ast.AugAssign):
            self.operators[type(node.op).__name__] += 1
        elif isinstance(node, ast.Compare):
            self.operators.update(type(op).__name__ for op in node.ops)
        elif isinstance(node, ast.Name):
            self.operands[node.id] += 1
        elif isinstance(node, ast.Constant):
            self.operands[repr(node.value)] += 1
        elif isinstance(node, ast.Attribute):
            self.operands[node.attr] += 1

    def halstead(self) -> tuple[float, float, float, float]:
        """Volume, difficulty, effort and expected faults."""
        n1, n2, m1, m2 = len(self.operators), len(self.operands), sum(self.operators.values()), sum(self.operands.values())
        if not n2 or n1 + n2 < 2:
            return 0.0, 0.0, 0.0, 0.0
        volume = (m1 + m2) * math.log2(n1 + n2)
        difficulty = n1 / 2 * m2 / n2
        return volume, difficulty, volume * difficulty, volume / 3000


def _last_name(func: ast.AST) -> str:
    """The name that a call ends with."""
    return func.attr if isinstance(func, ast.Attribute) else func.id if isinstance(func, ast.Name) else ""


def _doc(node: ast.AST) -> str | None:
    return ast.get_docstring(node, clean=False)


def _functions(file_id: int, tree: ast.Module) -> Iterator[tuple]:
    for f in _Walk(tree).functions:
        node, a = f.node, f.node.args
        args = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
        own = [x for x in args if x.arg not in ("self", "cls")]
        typed = node.returns is not None or any(x.annotation is not None for x in own)
        doc = _doc(node)
        injected = node.name == "__init__" and any(x.annotation is not None for x in a.args)
        yield (
            file_id, node.name, f.owner, node.lineno, (node.end_lineno or node.lineno) - node.lineno + 1, len(own), f.returns, f.complexity, doc is not None, typed, doc,
            isinstance(node, ast.AsyncFunctionDef), f.assert_calls, injected, ",".join(ast.unparse(d) for d in node.decorator_list), f.bare_excepts,
        )


def _classes(file_id: int, tree: ast.Module) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            names = [n.name for n in node.body if isinstance(n, _FUNCS)]
            attrs = [n for n in node.body if isinstance(n, ast.AnnAssign) or isinstance(n, ast.Assign) and not isinstance(n.value, ast.Call)]
            private = sum(n.startswith("_") and not n.startswith("__") for n in names)
            yield (
                file_id, node.name, node.lineno, len(names), sum(not n.startswith("_") for n in names), private, len(attrs), _doc(node) is not None,
                ",".join(ast.unparse(b) for b in node.bases), names,
            )


def _module(file_id: int, tree: ast.Module, text: str) -> Iterator[tuple]:
    walk = _Walk(tree)
    each = [f.complexity for f in walk.functions]
    lines = text.split("\n")
    blank = sum(not ln.strip() for ln in lines)
    comments = sum(ln.lstrip().startswith("#") for ln in lines)
    lloc = walk.statements
    volume, difficulty, effort, bugs = walk.halstead()
    mi = 171 - 5.2 * math.log(max(volume, 1)) - 0.23 * walk.complexity - 16.2 * math.log(max(lloc, 1)) + 50 * math.sin(math.sqrt(2.4 * math.radians(100 * comments / max(len(lines), 1))))
    yield (
        file_id, len(each), sum(each) / len(each) if each else 0.0, max(each, default=0), walk.cognitive, walk.nesting, len(lines), lloc, comments, blank,
        volume, difficulty, effort, bugs, max(0.0, min(100.0, mi * 100 / 171)),
    )


def _name_of(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        return ast.unparse(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else None
    if isinstance(node, ast.Import | ast.ImportFrom):
        return (node.module or "") if isinstance(node, ast.ImportFrom) else ",".join(a.name for a in node.names)
    return getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)


# ---- Fixed values: words of queries ----
SQL_WORDS = ["select", "insert", "update", "delete", "from", "where", "join"]
# ----------------------------------------


def _is_sql(node: ast.AST) -> bool:
    """AST2: whether a literal text holds a word of queries."""
    return isinstance(node, ast.Constant) and isinstance(node.value, str) and any(w in node.value.lower() for w in SQL_WORDS)


def _attrs(node: ast.AST) -> dict[str, str]:
    out: dict[str, str] = {}
    if isinstance(node, ast.ExceptHandler):
        out["type"] = ast.unparse(node.type) if node.type else ""
    elif isinstance(node, ast.Call):
        out.update({f"kw_{k.arg}": ast.unparse(k.value) for k in node.keywords if k.arg})
        out["args"] = str(len(node.args))
    elif isinstance(node, ast.ImportFrom):
        out["names"] = ",".join(a.name for a in node.names)
        out["level"] = str(node.level)
    elif isinstance(node, ast.Constant):
        out["value"] = repr(node.value)
        out["type"] = type(node.value).__name__
    elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
        out["targets"] = ",".join(ast.unparse(t) for t in node.targets)
        out["length"] = str(len(node.value.value))
    elif isinstance(node, ast.BinOp):
        out["op"] = type(node.op).__name__
        if isinstance(node.op, ast.Add) and (_is_sql(node.left) or _is_sql(node.right)):
            out["sql"] = "True"
    elif isinstance(node, ast.Name):
        out["stored"] = str(isinstance(node.ctx, ast.Store))
    return out


def _nodes(file_id: int, tree: ast.Module, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    count, todo = 0, [(tree, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        here = count
        count += 1
        kind = type(node).__name__
        if kinds is None or kind in kinds:
            yield file_id, here, parent, kind, _name_of(node), getattr(node, "lineno", None), getattr(node, "end_lineno", None), depth, _attrs(node)
        todo += [(child, here, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]


def _kinds(tree: ast.Module) -> Iterator[str]:
    """Kinds of all nodes in document order."""
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        yield type(node).__name__
        todo += reversed(list(ast.iter_child_nodes(node)))


#: Node kind of the row that carries a file's measures in ``nodes(measures=True)``.
MEASURES = "<measures>"


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of every file that parses, with ``file_id`` and, where the files have them, ``repo`` and ``path``."""
    columns = [c.split()[0] for c in schema.replace("map<string,string>", "map").replace("array<string>", "array").split(", ")]
    keep = [c for c in ("repo", "path") if c in files.columns and c not in columns]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                part, out, sizes = pdf.iloc[start : start + 200], [], []
                for file_id, text in zip(part["file_id"], part["content"], strict=True):
                    tree, before = _parse(text), len(out)
                    if tree is not None:
                        out += rows(file_id, tree, text)
                    sizes.append(len(out) - before)
                if out:
                    frame = pd.DataFrame(out, columns=columns)
                    for c in ("line", "end_line"):
                        if c in frame:
                            frame[c] = frame[c].astype("Int32")
                    for c in keep:
                        frame[c] = part[c].repeat(sizes).tolist()
                    yield frame

    some = files.filter(extension("path").isin("py", "pyi") & F.col("content").isNotNull()).select("file_id", *keep, "content")
    return some.mapInPandas(walk, ", ".join([schema, *(f"{c} string" for c in keep)]))


def nodes(files: DataFrame, measures: bool = False, kinds: Iterable[str] | None = None) -> DataFrame:
    """AST1, D3: every node with its parent, in document order; with ``kinds`` only nodes of those, under the same numbers.

    With ``measures`` every file has one more row, of kind ``MEASURES``, whose attributes are its measures, so that one
    parse serves both.
    """
    names = [c.split()[0] for c in MODULES.split(", ")][1:]
    wanted = None if kinds is None else frozenset(kinds)

    def rows(i: int, tree: ast.Module, text: str) -> Iterator[tuple]:
        yield from _nodes(i, tree, wanted)
        if measures:
            values = next(_module(i, tree, text))[1:]
            yield i, -1, None, MEASURES, None, None, None, 0, {n: str(v) for n, v in zip(names, values, strict=True)}

    return _table(files, NODES, rows)


def measures_of(parsed: DataFrame, names: list[str]) -> DataFrame:
    """``file_id, name, value`` of the rows of kind ``MEASURES``."""
    m = parsed.filter(F.col("kind") == MEASURES)
    return m.select("file_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.element_at("attrs", n).cast("double").alias("value")) for n in names])).alias("m")).select("file_id", "m.*")


def functions(files: DataFrame) -> DataFrame:
    """AST10, AST12: one row per function."""
    return _table(files, FUNCTIONS, lambda i, tree, text: _functions(i, tree))


def classes(files: DataFrame) -> DataFrame:
    """AST11: one row per class."""
    return _table(files, CLASSES, lambda i, tree, text: _classes(i, tree))


def modules(files: DataFrame) -> DataFrame:
    """AST7-AST9: measures of each file."""
    return _table(files, MODULES, lambda i, tree, text: _module(i, tree, text))


def signatures(files: DataFrame) -> DataFrame:
    """AST18: ``file_id, sig, nodes``: a hash of a file's node kinds in document order, made where the file is parsed."""

    def rows(i: int, tree: ast.Module, text: str) -> Iterator[tuple]:
        kinds = list(_kinds(tree))
        yield i, hashlib.sha256("|".join(kinds).encode()).hexdigest(), len(kinds)

    return _table(files, "file_id bigint, sig string, nodes int", rows)


def doc_quality(doc: Column) -> Column:
    """PAT14: points of a docstring for a summary, a blank line behind it, parameters, results, errors, examples and length."""
    text = F.coalesce(doc, F.lit(""))
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", -1)
    has = lambda rx: F.when(text.rlike(rx), 1).otherwise(0)
    points = (
        20 * F.when(F.trim(lines[0]) != "", 1).otherwise(0)
        + 10 * F.when((F.size(lines) > 1) & (F.regexp_replace(F.get(lines, 1), r"\s", "") == ""), 1).otherwise(0)
        + 20 * has(":param|:arg") + 20 * has(":return|:rtype") + 10 * has(":raises|:exception") + 10 * has("(?i)example|>>>") + 10 * F.when(F.length(text) > 100, 1).otherwise(0)
    )
    return F.when(text == "", 0).otherwise(F.least(points, F.lit(100)))
