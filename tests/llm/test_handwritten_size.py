"""What the containment across repositories writes grows with the lines, not with the pairs of bodies, and blocks change nothing."""

from __future__ import annotations

import os
import random

import pytest

from codestrata import session
from codestrata.llm import handwritten as hw

FILES = "file_id bigint, repo string, path string, content string"


def line(rng):
    return f"value_{rng.randrange(10**6)} = compute_{rng.randrange(10**6)}(argument_{rng.randrange(10**6)})"


@pytest.fixture(scope="module")
def scanned(spark):
    """Files made of twelve idioms of a pool each, and edited copies of a library in three repositories."""
    rng = random.Random(7)
    pool = [line(rng) for _ in range(48)]
    rows = [(f"r{i % 40}", "\n".join(rng.sample(pool, 12))) for i in range(600)]
    rows += [(f"o{i}", "\n".join(line(rng) for _ in range(10))) for i in range(300)]
    library = [line(rng) for _ in range(12)]
    rows += [(f"v{i}", "\n".join(x for j, x in enumerate(library) if j != i)) for i in range(3)]
    files = spark.createDataFrame([(i, r, f"src/m{i}.py", t) for i, (r, t) in enumerate(rows)], FILES)
    return session.cut(hw.scan(files))


def test_no_table_of_pairs(scanned, monkeypatch):
    sizes = []

    def counted(df, **how):
        table = session.cut(df, **how)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(hw, "cut", counted)
    found = {r.body for r in hw.vendored_bodies(scanned).collect()}
    copies = {r.body for r in scanned.filter("repo LIKE 'v%'").collect()}
    assert copies <= found and max(sizes) <= sum(len(r.lines) for r in scanned.collect() if r.lines)


def test_blocks(scanned):
    whole = {r.body for r in hw.vendored_bodies(scanned).collect()}
    assert whole and whole == {r.body for r in hw.vendored_bodies(scanned, block_lines=700).collect()}


@pytest.mark.parametrize("at_once", [1, 10**6])
def test_counts_of_partners(monkeypatch, at_once):
    monkeypatch.setattr(hw, "AT_ONCE", at_once)
    left = {"body": [1, 2], "one": [1, 2], "other": [1, 2], "size": [40.0, 40.0], "prefix": [2, 2], "rare": [[1, 2, 3, 4], [3, 4, 5, 6]], "weights": [[10.0] * 4] * 2}
    index = hw.Left(hw.pa.table(left))
    bodies = [(1, 1, 1, [1, 2, 3, 4]), (3, 3, 3, [1, 2, 3]), (4, 1, 4, [1, 2, 3]), (5, 1, 5, [1, 2, 3, 4, 5, 6]), (6, 1, 2, [3, 4, 5, 6]), (7, 1, 7, [8, 9])]
    body, held, one, lines = zip(*bodies, strict=True)
    args = [hw.np.array(x) for x in (body, held, one, one, [len(x) for x in lines], sum(lines, []))]
    # The first: by 3, which three repositories hold, and 5; not by itself, nor by three lines of 4. The second: by 5, not by 6 of its own repository.
    assert index.contained(*args).tolist() == [2, 1]


def test_tidy_and_drop(spark):
    table = session.cut(spark.range(50).repartition(3).groupBy("id").count(), tidy=True)
    folder = table.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert table.count() == 50 and os.path.exists(folder) and spark.conf.get(session.TIDY, "false") == "false"
    session.drop(table)
    assert not os.path.exists(folder)
