"""Problem 2: flat tables of the categories, findings, metrics and related places of whole analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.nested import Plan, collect_plan, flatten, inline_columns, reading, schema_graph
from codestrata.session import cut, table

#: Member names of the tool versions that mean the same element.
ELEMENTS = {"categories": "category", "category_scores": "category", "findings": "finding", "metrics": "metric", "related": "related"}
#: What names an item, in order of preference; '' is the key of a keyed collection.
LABELS = {"category": ("category", "", "name"), "finding": ("id", ""), "metric": ("name", ""), "related": ("file_path",)}
#: Columns that every table has.
LINKS = ["record_id", "id", "parent_id", "category", "parent_pos", "pos", "label", "rest"]


def nodes(df: DataFrame, plan: Plan, only: list[str], attributes: bool = True) -> DataFrame:
    """Objects of the elements in ``only``, with their ancestors (see ``operators.nested.flatten``)."""
    return flatten(df, "record_id", "payload", plan, LABELS, only, attributes).withColumnRenamed("_key", "record_id")


def _ancestor(element: str, what: str) -> Column:
    return F.get(F.filter("up", lambda u: u["element"] == element), 0)[what]


def flat_table(df: DataFrame, element: str) -> DataFrame:
    """One of the four tables, or that of the records (``record``).

    ``(record_id, id)`` is its key and ``(record_id, parent_id)`` the foreign key to the parent's table; categories
    have the record as their parent, which is the row with the id 0 of ``record``. ``category`` and, for related
    places, ``parent_pos`` repeat what links the rows by name and position. The other columns are the members that the
    schema graph inlines into the element, with a ``_`` behind names that are taken; members too rare to be columns
    stand in ``rest`` as JSON.
    """
    graph = cut(schema_graph(df, "payload", types=True))
    plan = collect_plan(graph, ELEMENTS)
    columns = inline_columns([(r[0], r[1], r[2], r[3]) for r in graph.collect()], plan, element)  # at most MAX_EDGES edges
    rows = nodes(df, plan, [element])
    members = F.from_json("attrs", "map<string,string>")
    taken, named = {x.lower() for x in LINKS}, []
    for name, kind in columns.items():
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        named.append(F.col("m").getItem(name).try_cast(kind).alias(free))
    rest = F.map_filter("m", lambda k, v: ~k.isin(list(columns)) if columns else F.lit(True))
    category = F.col("label") if element == "category" else F.coalesce(_ancestor("category", "label"), F.lit(""))
    out = rows.withColumn("m", members).select(
        "record_id",
        F.col("node").alias("id"),
        F.col("parent").alias("parent_id"),
        category.alias("category"),
        _ancestor("finding", "pos").alias("parent_pos"),
        "pos",
        "label",
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("rest"),
        *named,
    )
    return out if element == "related" else out.drop("parent_pos") if element != "record" else out.drop("parent_pos", "parent_id", "category", "pos", "label")


def found(df: DataFrame) -> DataFrame:
    """The objects in one frame, in the columns of p2_found."""
    related, listed = F.col("element") == "related", F.col("element").isin("finding", "related")
    category = F.when(F.col("element") == "category", F.col("label")).otherwise(F.coalesce(_ancestor("category", "label"), F.lit("")))
    plan = collect_plan(schema_graph(df, "payload"), ELEMENTS)
    return nodes(df, plan, list(LABELS), attributes=False).select(
        "record_id",
        F.col("element").alias("kind"),
        category.alias("category"),
        F.when(related, F.coalesce(_ancestor("finding", "pos"), F.lit(-1))).otherwise(F.lit(-1)).alias("parent_pos"),
        F.when(listed, F.col("pos")).otherwise(F.lit(-1)).alias("pos"),
        F.when(F.col("element") == "category", F.lit("")).otherwise(F.col("label")).alias("label"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "analysis_raw"))


def p2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(table(spark, sf_dir, "analysis_raw"), "category")


def p2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(table(spark, sf_dir, "analysis_raw"), "finding")


def p2_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(table(spark, sf_dir, "analysis_raw"), "metric")


def p2_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(table(spark, sf_dir, "analysis_raw"), "related")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the records themselves, to which the categories' ``parent_id`` points."""
    return flat_table(table(spark, sf_dir, "analysis_raw"), "record")


def p2_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records could be read, and why the others could not."""
    return reading(table(spark, sf_dir, "analysis_raw"), "record_id", "payload").groupBy("outcome").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (p2_found, p2_categories, p2_findings, p2_metrics, p2_related, p2_records, p2_reading)}


def _items(source: str, value: str, columns: str, names: str = "") -> str:
    """Rows ``columns, pos, key, item`` of a member that is a list, a lone object or, without any of ``names``, a collection keyed by name; also written as text."""
    keyed = f"json_type(v) = 'OBJECT' AND len(list_intersect(json_keys(v), [{names}])) = 0" if names else "false"
    base = f"(SELECT {columns}, CASE json_type(v0) WHEN 'VARCHAR' THEN CASE WHEN json_valid(v0->>'$') THEN (v0->>'$')::JSON END ELSE v0 END AS v FROM (SELECT {columns}, {value} AS v0 FROM {source}))"
    return f"""SELECT {columns}, e.key::BIGINT AS pos, NULL::VARCHAR AS key, e.value::JSON AS item FROM {base}, json_each(v) AS e WHERE json_type(v) = 'ARRAY'
  UNION ALL SELECT {columns}, 0, e.key, e.value::JSON FROM {base}, json_each(v) AS e WHERE {keyed}
  UNION ALL SELECT {columns}, 0, NULL, v FROM {base} WHERE json_type(v) = 'OBJECT' AND NOT ({keyed})"""


ORACLES = {
    "p2_found": f"""
WITH j AS (SELECT record_id, payload::JSON AS j FROM analysis_raw WHERE json_valid(payload)),
r0 AS (SELECT record_id, coalesce(j->'result', j) AS j FROM j), r AS (SELECT record_id, coalesce(j->'data'->'analysis', j) AS j FROM r0),
c AS ({_items("r", "coalesce(j->'categories', j->'category_scores')", "record_id", "'findings', 'score'")}),
cat AS (SELECT record_id, coalesce(item->>'category', key) AS category, item FROM c WHERE json_type(item) = 'OBJECT'),
f AS ({_items("cat", "item->'findings'", "record_id, category")}),
m AS ({_items("cat", "item->'metrics'", "record_id, category", "'name'")}),
fi AS (SELECT record_id, category, pos AS parent_pos, item FROM f WHERE json_type(item) = 'OBJECT'),
x AS ({_items("fi", "item->'related'", "record_id, category, parent_pos")})
SELECT record_id, 'category' AS kind, category, -1::BIGINT AS parent_pos, -1::BIGINT AS pos, '' AS label FROM cat
UNION ALL SELECT record_id, 'finding', category, -1, parent_pos, item->>'id' FROM fi
UNION ALL SELECT record_id, 'metric', category, -1, -1, coalesce(key, item->>'name') FROM m WHERE json_type(item) <> 'NULL' OR key IS NOT NULL
UNION ALL SELECT record_id, 'related', category, parent_pos, pos, item->>'file_path' FROM x WHERE json_type(item) = 'OBJECT'""",
    "p2_reading": "SELECT CASE WHEN payload IS NULL THEN 'null' WHEN payload = '' THEN 'empty' WHEN json_valid(payload) THEN 'read' ELSE 'unreadable' END AS outcome, count(*) AS records FROM analysis_raw GROUP BY 1",
}
