"""Containment across repositories against brute force, and marks of generated files wherever they stand."""

from __future__ import annotations

import math
import random

import pytest

from codestrata.llm import handwritten as hw
from codestrata.llm.source_rules import reason, significant_lines

FILES = "file_id bigint, repo string, path string, content string"


def line(rng):
    return f"value_{rng.randrange(10**6)} = compute_{rng.randrange(10**6)}(argument_{rng.randrange(10**6)})"


def found(spark, rows):
    files = spark.createDataFrame([(i, r, f"src/m{i}.py", t) for i, (r, t) in enumerate(rows)], FILES)
    return {r.file_id for r in hw.not_handwritten(files).collect() if r.reason == "vendored"}


@pytest.mark.parametrize("distinct", [False, True])
def test_a_popular_file_with_half_of_a_library(spark, distinct):
    rng = random.Random(3)
    library = [line(rng) for _ in range(24)]
    edited = [*library, line(rng), line(rng)]
    popular = [[*library[:12], *([line(rng)] if distinct else [])] for _ in range(6)]
    others = [(f"o{i}", "\n".join(line(rng) for _ in range(30))) for i in range(200)]
    rows = [("v0", "\n".join(library)), ("v1", "\n".join(edited)), *[(f"p{i}", "\n".join(x)) for i, x in enumerate(popular)], *others]
    assert {0, 1} <= found(spark, rows) and not found(spark, rows) & set(range(8, len(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [line(rng) for _ in range(60)]
    rows = []
    for _ in range(40):  # libraries, edited copies, parts, and files of their own
        base = rng.sample(pool, rng.randrange(6, 25))
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy = [x for x in base if rng.random() > 0.1] + [line(rng) for _ in range(rng.choice([0, 0, 1, 3, 12]))]
            rows.append((f"r{rng.randrange(12)}", "\n".join(copy)))
    rows += [(f"r{i % 12}", "\n".join(line(rng) for _ in range(20))) for i in range(150)]
    got = found(spark, rows)

    bodies: dict[tuple, set] = {}
    for repo, text in rows:
        bodies.setdefault(tuple(significant_lines(text)), set()).add(repo)
    df: dict[str, int] = {}
    for b in bodies:
        for x in set(b):
            df[x] = df.get(x, 0) + 1
    n = len(bodies)
    known = {x: math.log(n / d) for x, d in df.items() if d <= max(3, int(hw.COMMON_SHARE * n))}
    sets = {b: {x for x in b if x in known} for b in bodies}
    weight = {b: sum(known[x] for x in s) for b, s in sets.items()}

    def holds(a, b):  # whether b holds most of a, across repositories
        both = sets[a] & sets[b]
        w = sum(known[x] for x in both)
        enough = len(both) >= hw.LEAST_LINES or len(both) >= hw.FEW_LINES and len(bodies[b]) >= hw.WIDELY_HELD
        return a != b and len(bodies[a] | bodies[b]) > 1 and enough and w >= hw.LEAST_WEIGHT and w >= hw.CONTAINED * weight[a] - 1e-9

    for i, (_, text) in enumerate(rows):
        a = tuple(significant_lines(text))
        partners = [b for b in bodies if holds(a, b)]
        if i in got:  # sound: held or contained by another repository
            assert partners or len(bodies[a]) > 1
        elif partners:  # complete, but for idioms
            telling = sum(df[x] >= 2 and df[x] <= hw.SPREAD * (len(partners) + 1) for x in sets[a])
            assert telling < hw.CONTAINED * len(sets[a])
    assert len(got) > 20


def test_marks_behind_long_headers_and_in_long_tails():
    licence = "\n".join(f"# Licence text, paragraph {i} of the usual terms" for i in range(300))
    code = "\n".join(f"field_{i} = Field(name='x{i}', kind=int)" for i in range(3))
    assert reason("a/b.py", f"{licence}\n# Code generated by schema-tool. DO NOT EDIT.\n{code}\n") == "generated"
    assert reason("a/b.py", f"{licence}\n{code}\n") is None
    assert reason("a/b.py", f"{code}\n# Code generated by schema-tool. DO NOT EDIT.\n{licence}\n") == "generated"
