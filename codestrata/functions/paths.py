"""Columns over file paths: names, modules, globs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column | str) -> Column:
    """Ending after the last dot of the name, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column | str) -> Column:
    """Name without its last ending."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def module_name(path: Column | str) -> Column:
    """Dotted module of a path: slashes of both kinds become dots, every ``.py`` goes."""
    p = F.col(path) if isinstance(path, str) else path
    return F.replace(F.translate(p, "/\\", ".."), F.lit(".py"), F.lit(""))


def module_prefixes(module: Column) -> Column:
    """All dotted prefixes of a module, shortest first."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression that matches the whole text."""
    out, i = ["^(?s:"], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            stop = glob.index("]", i + 2)
            body = glob[i + 1 : stop].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = stop
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + ")$"


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false if there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def excluded(path: Column | str, patterns: Iterable[str], by_segment: bool = False) -> Column:
    """Whether an exclude pattern hits: as a substring or as a glob of the whole path.

    ``by_segment`` compares plain patterns with whole path segments, so that ``env`` spares ``environment``.
    """
    p = F.col(path) if isinstance(path, str) else path
    tests = []
    for pattern in patterns:
        if by_segment and not re.search(r"[*?\[]", pattern):
            tests.append(F.array_contains(F.split(p, "/"), pattern.strip("/")))
        else:
            tests.append(p.contains(pattern) if not by_segment else F.lit(False))
            tests.append(p.rlike(glob_regex(pattern)))
            if by_segment:
                tests.append(basename(p).rlike(glob_regex(pattern)))
    return any_of(tests)


def included(path: Column | str, patterns: Iterable[str]) -> Column:
    """Whether an include pattern hits the name of the file, as a glob or exactly."""
    return any_of(basename(path).rlike(glob_regex(g)) for g in patterns)


def is_test_file(path: Column | str) -> Column:
    """Test files by name (prefix, suffix, fixture file) or by a directory called test or tests."""
    name = basename(path)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return (
        name.startswith("test_")
        | name.rlike(r"(?:_test|\.test|\.spec)\.[A-Za-z]+$")
        | name.rlike(r"(?:Test|Tests|IT)\.java$")
        | (name == "conftest.py")
        | F.array_contains(folders, "test")
        | F.array_contains(folders, "tests")
    )
