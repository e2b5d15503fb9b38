"""Changes between snapshots, against a plain implementation."""

from __future__ import annotations

import datetime as dt
import random

from codestrata.plans.p4_snapshots import changes

FIND = (
    "row_id bigint, snapshot_no int, repo string, category string, rule_id string, severity string, message string, file_path string, line_start int, metric_value double, "
    "loaded_at timestamp_ntz, state string, calendar string, tbl string, change_type string"
)
SCORE = "row_id bigint, snapshot_no int, repo string, category string, score double, loaded_at timestamp_ntz, owner string"
T0 = dt.datetime(2025, 1, 1)


def f(row_id, snap, repo="r", rule="a", path="x.py", line=1, sev="high", msg="m", metric=None, hours=0, category="security"):
    return (row_id, snap, repo, category, rule, sev, msg, path, line, metric, T0 + dt.timedelta(hours=hours) if hours is not None else None, "s", "c", "t", "z")


def run(spark, finds, scores=()):
    rows = changes(spark.createDataFrame(list(finds), FIND), spark.createDataFrame(list(scores), SCORE)).collect()
    return sorted(tuple(-9 if v is None else v for v in r) for r in rows)


def test_added_removed_changed_and_notation(spark):
    rows = [
        f(1, 1, rule="same", sev="High ", path=".\\a\\b.py", metric=11.0000003, msg=" Text "),
        f(2, 2, rule="same", sev="high", path="a/b.py", metric=10.96, msg="text"),
        f(3, 1, rule="gone"),
        f(4, 2, rule="new"),
        f(5, 1, rule="moved", sev="low"),
        f(6, 2, rule="moved", sev="high"),
        f(7, 1, rule="nopath", path=None, line=None),
        f(8, 2, rule="nopath", path=None, line=None, msg=None),
    ]
    got = {(r[4], r[7]) for r in run(spark, rows)}
    assert got == {("gone", "removed"), ("new", "added"), ("moved", "changed"), ("nopath", "changed")}


def test_latest_delivery_counts_and_ties(spark):
    rows = [
        f(1, 1, sev="low"), f(2, 2, sev="high", hours=1), f(3, 2, sev="low", hours=5), f(4, 2, sev="low", hours=5),
        # no time at all is the earliest; of equal times the larger row_id counts
        f(5, 1, rule="t", sev="low", hours=None), f(6, 1, rule="t", sev="high", hours=1), f(7, 2, rule="t", sev="low", hours=2), f(8, 2, rule="t", sev="high", hours=2),
    ]
    assert run(spark, rows) == []


def test_consecutive_over_both_tables(spark):
    finds = [f(1, 1), f(2, 3)]
    scores = [(1, 2, "r", "security", 5.0, T0, "o")]
    got = run(spark, finds, scores)
    # snapshot 2 exists through the scores: the finding is removed in it and added again in 3
    assert [(r[0], r[2], r[7]) for r in got] == [("category_scores", 2, "added"), ("category_scores", 3, "removed"), ("findings", 2, "removed"), ("findings", 3, "added")]


def test_nulls_and_empty(spark):
    assert run(spark, []) == []
    rows = [f(1, 1, repo=None), f(2, None), f(3, 1, rule=None, category=None), f(4, 2, rule=None, category=None, sev=None)]
    got = run(spark, rows)
    assert len(got) == 1 and got[0][7] == "changed"
    nan = float("nan")
    assert run(spark, [], [(1, 1, "r", "c", nan, T0, "o"), (2, 2, "r", "c", None, T0, "o")]) == []
    assert len(run(spark, [f(1, 1), f(2, 2, msg="x" * 300_000)])) == 1


def test_against_plain_python(spark):
    random.seed(4)
    rows = []
    for i in range(600):
        rows.append(f(i, random.randint(1, 4), repo=random.choice("abc"), rule=random.choice("pqr"), line=random.randint(1, 3), sev=random.choice(["low", "high", "LOW"]), hours=random.randint(0, 3)))
    latest: dict = {}
    for r in rows:
        key = (r[2], r[4], r[8])
        at = latest.setdefault((r[1], key), (r[10], r[0], r[5].lower()))
        latest[(r[1], key)] = max(at, (r[10], r[0], r[5].lower()))
    want = []
    for repo in "abc":
        snaps = sorted({r[1] for r in rows if r[2] == repo})
        for a, b in zip(snaps, snaps[1:], strict=False):
            old = {k: v[2] for (s, k), v in latest.items() if s == a and k[0] == repo}
            new = {k: v[2] for (s, k), v in latest.items() if s == b and k[0] == repo}
            for k in old.keys() | new.keys():
                if old.get(k) != new.get(k):
                    want.append((repo, b, k[1], k[2], "added" if k not in old else "removed" if k not in new else "changed"))
    got = [(r[1], r[2], r[4], r[6], r[7]) for r in run(spark, rows)]
    assert sorted(got) == sorted(want)
