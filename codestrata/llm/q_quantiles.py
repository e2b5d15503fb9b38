"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.quantiles import SKETCH_ERROR, from_sketch, radix_levels, run_values, sketch
from codestrata.session import cut, table


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(run_values(table(spark, sf_dir, "benchmark_results")))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per repository and day and, with day null, per repository over all days."""
    both = radix_levels(_keys(spark, sf_dir), [["repo_name", "day"], ["repo_name"]])
    return both.withColumn("level", F.when(F.col("level") == 0, "day").otherwise("all")).withColumn("max_rel_error", F.lit(0.0))


def p5_daily_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinable daily result: counts per repository, day and leading digits."""
    return sketch(run_values(table(spark, sf_dir, "benchmark_results")), ["repo_name", "day"])


def p5_weekly_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly percentiles from the daily sketches alone, with bounds."""
    days = p5_daily_sketch(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return from_sketch(days.drop("day"), ["repo_name", "week"])


_VALUES = """
WITH runs AS (
  SELECT * FROM benchmark_results WHERE run_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC, coalesce(len(times_ms), -1) DESC) = 1
  UNION ALL SELECT * FROM benchmark_results WHERE run_id IS NULL
), vals AS (
  SELECT repo_name, started_at::DATE AS day, v FROM (SELECT repo_name, started_at, unnest(times_ms) AS v FROM runs)
  WHERE v IS NOT NULL AND isfinite(v) AND v >= 0
)
"""


def _level(groups: str, day: str, level: str) -> str:
    cols = ", ".join(
        f"min(v) FILTER (WHERE r >= ceil({p} * n)) AS {q}" for q, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""SELECT repo_name, {day} AS day, '{level}' AS level, max(n) AS n, {cols}, 0.0::DOUBLE AS max_rel_error FROM (
      SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY v) AS r, count(*) OVER (PARTITION BY {groups}) AS n FROM vals
    ) GROUP BY {groups}"""


# A value's leading bits without looking at them: its binary exponent, and 10 bits of what is left. The logarithm may
# be off by one at powers of two, which the comparison with 1 and 2 puts right.
_SKETCH = _VALUES.rstrip() + """, e0 AS (SELECT *, CASE WHEN v > 0 THEN floor(log2(v)) ELSE 0 END AS e FROM vals),
e1 AS (SELECT repo_name, day, v, e + CASE WHEN v / pow(2.0, e) >= 2 THEN 1 WHEN v / pow(2.0, e) < 1 THEN -1 ELSE 0 END AS e FROM e0),
sk AS (SELECT repo_name, day, CASE WHEN v > 0 THEN ((e + 1023) * 1024 + floor((v / pow(2.0, e) - 1) * 1024))::BIGINT ELSE 0 END AS bucket, count(*) AS n FROM e1 GROUP BY 1, 2, 3)
"""
_RANKS = {q: f"max(bucket) FILTER (ceil({p} * a) > upto - n AND ceil({p} * a) <= upto)" for q, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))}


def _ends(q: str) -> str:
    e, m = f"({q} // 1024 - 1023)", f"({q} % 1024)"
    low, high = f"pow(2.0, {e}) * (1 + {m} / 1024.0::DOUBLE)", f"(pow(2.0, {e}) * (1 + ({m} + 1) / 1024.0::DOUBLE) - pow(2.0, {e} - 52))"
    return f"{low} AS {q}_low, {high} AS {q}_high, ({low} + {high}) / 2 AS {q}"


QUERIES = {"p5_percentiles": p5_percentiles, "p5_daily_sketch": p5_daily_sketch, "p5_weekly_from_days": p5_weekly_from_days}
ORACLES = {
    "p5_percentiles": _VALUES + _level("repo_name, day", "day", "day") + " UNION ALL " + _level("repo_name", "NULL::DATE", "all"),
    "p5_daily_sketch": _SKETCH + "SELECT repo_name, day, bucket, n FROM sk",
    "p5_weekly_from_days": _SKETCH
    + f""", w AS (SELECT repo_name, date_trunc('week', day)::DATE AS week, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY 1, 2, 3),
x AS (SELECT *, sum(n) OVER (PARTITION BY repo_name, week ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY repo_name, week) AS a FROM w),
y AS (SELECT repo_name, week, max(a)::BIGINT AS n, {", ".join(f"{x} AS {q}" for q, x in _RANKS.items())} FROM x GROUP BY 1, 2)
SELECT repo_name, week, n, {", ".join(_ends(q) for q in _RANKS)}, {SKETCH_ERROR}::DOUBLE AS max_rel_error FROM y""",
}
