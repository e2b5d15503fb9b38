"""Activity, ownership and graphs: events stand for commits, trade between nations for imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.operators.graph import closure, cycles, degrees, god_nodes
from codestrata.session import broadcast_if_small, cut, table


# ---- Fixed value: days that count as recent ----
RECENT_DAYS = 30
# ------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def top1_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1: the ten most active users (a top-k report); the first is flagged."""
    counts = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return counts.withColumn("top", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")) == 1)


def win1_bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: how many users it takes, most active first, to reach 80 % of the events of a type.

    Users of equal activity are one row of a histogram, so that the window runs over the distinct counts of a type and
    not over its users; within such a row the users needed follow by division.
    """
    users = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    h = users.groupBy("event_type", "n").agg(F.count("*").alias("users"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"))
    before = F.coalesce(F.sum(F.col("n") * F.col("users")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("n") * F.col("users")).over(Window.partitionBy("event_type"))
    rows = h.withColumn("before", before).withColumn("total", total)
    # in fifths, exactly: a user counts while the events before are under four fifths
    needed = F.ceil((4 * F.col("total") - 5 * F.col("before")) / (5 * F.col("n")))
    return rows.groupBy("event_type").agg(F.sum(F.least("users", F.greatest(needed, F.lit(0)))).alias("bus_factor"), F.max("total").alias("events"))


def agg12_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: events by weekday (Monday 0) and hour, as counts."""
    return _events(spark, sf_dir).groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def agg13_weekly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, AGG14, WIN5, FLT5: first and last event, events per week, share of errors, and those of the last 30 days before the newest one."""
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    weeks = F.greatest(F.floor(seconds / 86400) / 7, F.lit(1.0))
    recent = F.col("ts") >= F.lit(_events(spark, sf_dir).agg(F.max("ts")).first()[0]) - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    return _events(spark, sf_dir).groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.count("*") / weeks, 6).alias("per_week"),
        F.bround(F.avg((F.col("event_type") == "error").cast("int")) * 100, 1).alias("error_pct"), F.count_if(recent).alias("recent"),
    )


def flt6_fix_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6, AGG14: share of change notes that mention a repair, by case-insensitive substring."""
    d = table(spark, sf_dir, "documents").filter("source = 'commit_note' AND text IS NOT NULL")
    words = F.array(*[F.lit(w) for w in ("fix", "bug", "patch", "rolled back", "flaky")])
    hit = F.exists(words, lambda w: F.contains(F.lower("text"), w))
    return d.groupBy("repo").agg(F.count("*").alias("notes"), F.count_if(hit).alias("fixes"), F.bround(F.avg(hit.cast("int")) * 100, 1).alias("pct"))


def flt13_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13, JSON family: nested members of the events' JSON, grouped."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).cast("bigint").alias("sum_k"), F.count(k).alias("n"), F.max(k).alias("max_k"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the supplier's nation to the customer's, with the number of line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = broadcast_if_small(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")))
    s = broadcast_if_small(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _busy(spark: SparkSession, sf_dir: str, share: float = 1.12) -> DataFrame:
    """The edges with clearly more trade than the average edge."""
    t = cut(_trade(spark, sf_dir))
    least = t.agg(F.avg("n") * share).first()[0] or 0.0
    return t.filter(F.col("n") > least).select("src", "dst")


def agg10_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1, AGG9, AGG10, SET6: degrees and instability of the nodes of the busy edges."""
    return degrees(_busy(spark, sf_dir)).withColumn("instability", F.round("instability", 9))


def top2_god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2: nodes with many edges (a top-k report)."""
    return god_nodes(_busy(spark, sf_dir), 3, 10).select("node", "fan_in", "fan_out", "degree")


def gr3_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: everything that reaches nation 0 over busy edges, with its distance."""
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    return closure(_busy(spark, sf_dir), seeds)


def gr2_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2: simple cycles of two and three busy edges."""
    return cycles(_busy(spark, sf_dir), 3)


def jn11_layer_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: edges from a higher to a lower layer; a nation's layer is its region."""
    n = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    e = _busy(spark, sf_dir)
    a, b = n.withColumnsRenamed({"n_nationkey": "src", "n_regionkey": "from_layer"}), n.withColumnsRenamed({"n_nationkey": "dst", "n_regionkey": "to_layer"})
    return e.join(a, "src").join(b, "dst").filter("from_layer > to_layer").select("src", "dst", "from_layer", "to_layer")


def jn8_semi_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8, JN10: orders with a returned line (semi), and orders without any line (anti), per priority."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    back = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    some = o.join(back, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("kind", F.lit("returned"))
    none = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return some.unionByName(none.withColumn("kind", F.lit("no lines")))


def agg5_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: sum, average and maximum of several numeric columns, one row per metric, nulls skipped."""
    li = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = li.select("l_returnflag", *names).unpivot("l_returnflag", names, "metric", "value")
    return long.groupBy("l_returnflag", "metric").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("average"), F.max("value").alias("largest"))


def agg7_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: five buckets of a measure, empty buckets kept."""
    q = F.col("l_quantity")
    bucket = F.when(q <= 5, "1-5").when(q <= 10, "6-10").when(q <= 20, "11-20").when(q <= 50, "21-50").otherwise("50+")
    counts = table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(b,) for b in ("1-5", "6-10", "11-20", "21-50", "50+")], "bucket string")
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def pat13_readme_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT13, SET4: points of a README for sections, code, badges and length."""
    d = table(spark, sf_dir, "documents").filter("source = 'readme' AND text IS NOT NULL")
    low = F.lower("text")
    points = sum(F.when(low.rlike(rx), 10).otherwise(0) for rx in README_SECTIONS.values())
    points = points + F.when(F.contains("text", F.lit("```")), 10).otherwise(0) + F.when(F.col("text").rlike(r"!\[.*\]\(.*\)"), 5).otherwise(0)
    points = points + F.when(F.length("text") > 500, 10).when(F.length("text") > 200, 5).otherwise(0)
    missing = F.filter(F.array(*[F.when(~low.rlike(rx), F.lit(k)) for k, rx in README_SECTIONS.items()]), lambda x: x.isNotNull())
    return d.select("doc_id", F.least(points, F.lit(100)).alias("quality"), F.array_join(missing, ",").alias("missing"))


# ---- Fixed values: sections of a README and the words that show them ----
README_SECTIONS = {
    "description": "(description|overview|about)",
    "installation": "(install|setup|getting started)",
    "usage": "(usage|example|how to)",
    "api": "(api|reference|documentation)",
    "contributing": "(contribut|develop)",
    "license": "(license|legal)",
    "authors": "(author|maintainer|credit)",
    "changelog": "(changelog|history|releases)",
}
# -------------------------------------------------------------------------

QUERIES = {
    f.__name__: f
    for f in (
        top1_hotspots, win1_bus_factor, agg12_activity, agg13_weekly_rate, flt6_fix_messages, flt13_json_props, agg10_fan, top2_god_nodes, gr3_closure, gr2_cycles,
        jn11_layer_breaches, jn8_semi_returned, agg5_unpivot, agg7_histogram, pat13_readme_quality,
    )
}

_BUSY = """t AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM t WHERE n > (SELECT avg(n) * 1.12 FROM t))"""
_DEG = f"WITH {_BUSY}, d AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1)"
ORACLES = {
    "top1_hotspots": "SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) = 1 AS top FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10)",
    "win1_bus_factor": """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY event_type) AS t FROM c)
SELECT event_type, count(*) FILTER (b < 0.8 * t) AS bus_factor, max(t)::BIGINT AS events FROM x GROUP BY 1""",
    "agg12_activity": "SELECT (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1, 2",
    "agg13_weekly_rate": """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, round(count(*) / greatest(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) / 7, 1.0), 6) AS per_week,
  round_even(avg((event_type = 'error')::INT) * 100, 1) AS error_pct, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS) AS recent FROM events GROUP BY 1""",
    "flt6_fix_messages": """WITH d AS (SELECT repo, (contains(lower(text), 'fix') OR contains(lower(text), 'bug') OR contains(lower(text), 'patch') OR contains(lower(text), 'rolled back') OR contains(lower(text), 'flaky')) AS h
  FROM documents WHERE source = 'commit_note' AND text IS NOT NULL) SELECT repo, count(*) AS notes, count(*) FILTER (h) AS fixes, round_even(avg(h::INT) * 100, 1) AS pct FROM d GROUP BY 1""",
    "flt13_json_props": "SELECT event_type, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS sum_k, count(json_extract_string(props, '$.k')) AS n, max(json_extract_string(props, '$.k')::INT) AS max_k FROM events GROUP BY 1",
    "agg10_fan": f"{_DEG} SELECT node, fan_in, fan_out, round(fan_out::DOUBLE / (fan_in + fan_out), 9) AS instability FROM d",
    "top2_god_nodes": f"{_DEG} SELECT node, fan_in, fan_out, fan_in + fan_out AS degree FROM d WHERE fan_in > 3 OR fan_out > 3 ORDER BY degree DESC, node LIMIT 10",
    "gr3_closure": f"""WITH RECURSIVE {_BUSY}, r(node, depth) AS (SELECT 0, 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 26)
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""",
    "gr2_cycles": f"""WITH {_BUSY}, x AS (SELECT * FROM e WHERE src <> dst)
SELECT a.src || '>' || a.dst AS path, 2 AS length FROM x a JOIN x b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM x a JOIN x b ON a.dst = b.src JOIN x c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
    "jn11_layer_breaches": f"WITH {_BUSY} SELECT src, dst, a.n_regionkey AS from_layer, b.n_regionkey AS to_layer FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey > b.n_regionkey",
    "jn8_semi_returned": """SELECT o_orderpriority, count(*) AS n, 'returned' AS kind FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R') GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*), 'no lines' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey) GROUP BY 1""",
    "agg5_unpivot": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS metric, round(sum({c}), 2) AS total, round(avg({c}), 6) AS average, max({c}) AS largest FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "agg7_histogram": """WITH b(bucket) AS (VALUES ('1-5'), ('6-10'), ('11-20'), ('21-50'), ('50+')),
c AS (SELECT CASE WHEN l_quantity <= 5 THEN '1-5' WHEN l_quantity <= 10 THEN '6-10' WHEN l_quantity <= 20 THEN '11-20' WHEN l_quantity <= 50 THEN '21-50' ELSE '50+' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)""",
    "pat13_readme_quality": "SELECT doc_id, least(100, "
    + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{rx}') THEN 10 ELSE 0 END" for rx in README_SECTIONS.values())
    + r" + CASE WHEN contains(text, '```') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '!\[.*\]\(.*\)') THEN 5 ELSE 0 END + CASE WHEN length(text) > 500 THEN 10 WHEN length(text) > 200 THEN 5 ELSE 0 END)::INTEGER AS quality, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT regexp_matches(lower(text), '{rx}') THEN '{k}' END" for k, rx in README_SECTIONS.items())
    + ") AS missing FROM documents WHERE source = 'readme' AND text IS NOT NULL",
}
