"""Flat tables of nested records, against a plain walk."""

from __future__ import annotations

import json

from codestrata.operators.nested import collect_plan, parse, plan_tables, reading, schema_graph
from codestrata.plans.p2_nested import ELEMENTS, flat_table, found
from codestrata.session import table

RAW = "record_id bigint, repo string, payload string, element string, up string, pos bigint"


def raw(spark, *payloads):
    rows = [(i, "r", p if p is None or isinstance(p, str) else json.dumps(p), "e", "u", 7) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RAW)


def got(spark, *payloads):
    return sorted(tuple(r) for r in found(raw(spark, *payloads)).collect())


LIST = {"categories": [{"category": "security", "findings": [{"id": "a", "related": [{"file_path": "x"}, None, {"file_path": "y"}]}, None, {"id": "b"}], "metrics": [{"name": "loc", "value": 1}, {"name": "tool"}]}]}
KEYED = {"result": {"category_scores": {"testing": {"name": "Testing", "findings": {"id": "lone", "related": {"file_path": "z"}}, "metrics": {"loc": 3, "by_file": {"q": 1}, "none": None}}}}}


def test_lists_keyed_lone_and_null(spark):
    rows = got(spark, LIST, KEYED)
    assert rows == sorted(
        [
            (0, "category", "security", -1, -1, ""), (0, "finding", "security", -1, 0, "a"), (0, "finding", "security", -1, 2, "b"),
            (0, "related", "security", 0, 0, "x"), (0, "related", "security", 0, 2, "y"), (0, "metric", "security", -1, -1, "loc"), (0, "metric", "security", -1, -1, "tool"),
            (1, "category", "testing", -1, -1, ""), (1, "finding", "testing", -1, 0, "lone"), (1, "related", "testing", 0, 0, "z"),
            (1, "metric", "testing", -1, -1, "loc"), (1, "metric", "testing", -1, -1, "by_file"), (1, "metric", "testing", -1, -1, "none"),
        ]
    )


def test_text_inside_and_unreadable(spark):
    inside = {"categories": [{"category": "c", "findings": json.dumps([{"id": "t"}, None]), "metrics": None}]}
    rows = got(spark, LIST, inside, None, "", "{cut", "[1, 2", "NaN", '{"a": NaN}', "[]", "3", '{"categories": null}', '{"categories": []}', "[" * 100_000)
    assert [r for r in rows if r[0] == 1] == [(1, "category", "c", -1, -1, ""), (1, "finding", "c", -1, 0, "t")]
    assert not [r for r in rows if r[0] > 1]


def test_empty_table_and_repeats(spark):
    assert found(raw(spark)).collect() == []
    rows = got(spark, LIST, LIST)
    assert [r[1:] for r in rows if r[0] == 0] == [r[1:] for r in rows if r[0] == 1]


def test_long_payload(spark):
    many = {"categories": [{"category": "c", "findings": [{"id": str(i), "message": "x" * 50} for i in range(20_000)]}]}
    assert len(got(spark, many)) == 20_001


def test_foreign_keys(spark, sf_dir):
    df = table(spark, sf_dir, "analysis_raw")
    cats, finds, rel = (flat_table(df, k) for k in ("category", "finding", "related"))
    assert cats.count() == cats.select("record_id", "id").distinct().count()
    key = finds.select("record_id", "id")
    assert rel.selectExpr("record_id", "parent_id AS id").join(key, ["record_id", "id"], "left_anti").count() == 0
    assert finds.selectExpr("record_id", "parent_id AS id").join(cats.select("record_id", "id"), ["record_id", "id"], "left_anti").count() == 0


def test_against_plain_walk(spark, sf_dir):
    """A walk written for exactly these formats finds the same rows."""

    def items(v, keyed_names=()):
        v = json.loads(v) if isinstance(v, str) else v
        if isinstance(v, list):
            return [(i, None, x) for i, x in enumerate(v)]
        if isinstance(v, dict):
            return [(0, None, v)] if not keyed_names or keyed_names & v.keys() else [(0, k, x) for k, x in v.items()]
        return []

    df = table(spark, sf_dir, "analysis_raw")
    want = []
    for r in df.select("record_id", "payload").collect():
        root = parse(r["payload"])
        if root is None:
            continue
        root = root.get("result", root)
        root = root.get("data", {}).get("analysis", root) if "data" in root else root
        for _, key, c in items(root.get("categories", root.get("category_scores")), {"findings", "score"}):
            name = c.get("category", key)
            want.append((r[0], "category", name, -1, -1, ""))
            for pos, _, x in items(c.get("findings")):
                if x is not None:
                    want.append((r[0], "finding", name, -1, pos, x["id"]))
                    want += [(r[0], "related", name, pos, p, y["file_path"]) for p, _, y in items(x.get("related")) if y is not None]
            for _, key2, m in items(c.get("metrics"), {"name"}):
                want.append((r[0], "metric", name, -1, -1, key2 or m["name"]))
    assert sorted(tuple(r) for r in found(df).collect()) == sorted(want)


def test_plan_shares_inlines_and_refuses(spark):
    plan = plan_tables([("", "xs", "list", 5), ("xs", "[]", "object", 5), ("xs/[]", "a", "scalar", 5), ("xs/[]", "b", "object", 5), ("xs/[]/b", "c", "scalar", 5), ("", "b", "object", 1)])
    assert plan.of_member("xs") is not None and plan.of_member("b") is None
    tree = plan_tables([("", "node", "object", 3), ("node", "node", "object", 2), ("node", "v", "scalar", 3)])
    assert tree.of_member("node") is not None  # recursive
    assert collect_plan(schema_graph(raw(spark, LIST), "payload"), ELEMENTS).of_member("categories").name == "category"


def test_columns_come_from_the_graph(spark, sf_dir):
    """Every inlined member is in a column or in ``rest``, and categories point to the table of records."""
    df = table(spark, sf_dir, "analysis_raw")
    cats, records, metrics = (flat_table(df, k) for k in ("category", "record", "metric"))
    assert {"score", "weight", "duration_ms", "category_"} <= set(cats.columns) and dict(cats.dtypes)["score"] == "double"
    assert "overall_score" in records.columns and "value" in metrics.columns and len(metrics.columns) < 12
    assert cats.selectExpr("record_id", "parent_id AS id").join(records.select("record_id", "id"), ["record_id", "id"], "left_anti").count() == 0
    extra = spark.createDataFrame([(1, '{"categories": [{"category": "a", "Score": 1, "score": 2.5, "odd": {"x": true}, "findings": []}]}')], "record_id bigint, payload string")
    row = flat_table(extra, "category").first()
    assert (row.odd_x, row.rest) == (True, None) and {row.Score, row.score_} == {1, 2.5}


def test_reading_tells_why(spark):
    deep = "[" * 500 + "]" * 500
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, deep), (5, "{}"), (6, "NaN")], "record_id bigint, payload string")
    assert {r.record_id: r.outcome for r in reading(df, "record_id", "payload").collect()} == {1: "null", 2: "empty", 3: "unreadable", 4: "deep", 5: "read", 6: "unreadable"}
