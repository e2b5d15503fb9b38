"""User rules as data: regular expressions, conditions on syntax nodes, metric limits, and combinations.

A rule is a row (dict) with id, type (regex_pattern, ast_pattern, metric_threshold, composite), severity,
enabled, tags and the fields of its type. Rules become Column expressions; nothing a rule says is executed as
code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.patterns import Pattern
from codestrata.operators.scan import scan
from codestrata.operators.syntax_tree import nodes

COMPARISONS = {
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
}
IGNORE_CASE = 2
_CONDITION = re.compile(r"^\s*(?P<field>name|attr\.\w+|line|depth)\s*(?P<op>==|!=|~|is null|is not null)\s*(?P<value>'[^']*')?\s*$")
MATCHES = "file_id, rule_id, severity, line"


def enabled(rules: Sequence[dict], tags: Sequence[str] | None = None) -> list[dict]:
    """FLT9: enabled rules, with any of the tags if given."""
    return [r for r in rules if r.get("enabled", True) and (not tags or set(tags) & set(r.get("tags") or []))]


def condition(text: str | None) -> Column:
    """A condition on a syntax node: ``field op 'value'`` parts joined by ``and``; ~ is a regular expression."""
    out = F.lit(True)
    for part in (text or "").split(" and "):
        if not part.strip():
            continue
        m = _CONDITION.match(part)
        if not m:
            raise ValueError(f"not a condition: {part!r}")
        field = F.element_at("attrs", m["field"][5:]) if m["field"].startswith("attr.") else F.col(m["field"])
        value = F.lit(m["value"][1:-1]) if m["value"] else None
        op = m["op"]
        out = out & (field.isNull() if op == "is null" else field.isNotNull() if op == "is not null" else field == value if op == "==" else field != value if op == "!=" else field.rlike(m["value"][1:-1]))
    return out


def node_kinds(rules: Sequence[dict]) -> set[str]:
    """Kinds of syntax nodes that the rules look at."""
    return {r["ast_pattern"] for r in rules if r["type"] == "ast_pattern"}


def apply(files: DataFrame, rules: Sequence[dict], metrics: DataFrame | None = None, tags: Sequence[str] | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """``file_id, rule_id, severity, line`` of every match.

    ``metrics`` is ``file_id, name, value``; ``parsed`` are the nodes of the files, if they are known. Composite rules combine the others by file: all, any or none of
    their sub-rules; an unknown or disabled sub-rule never matches, so that ``all`` with one never holds.
    """
    active = enabled(rules, tags)
    parts: list[DataFrame] = []
    regex = [Pattern(r["id"], r["regex_pattern"], r["severity"], bool((r.get("regex_flags") or 0) & IGNORE_CASE)) for r in active if r["type"] == "regex_pattern"]
    if regex:
        parts.append(scan(files.select("file_id", "content"), regex).select("file_id", "rule_id", "severity", "line"))
    trees = [r for r in active if r["type"] == "ast_pattern"]
    if trees:
        hits = F.array(*[F.when((F.col("kind") == r["ast_pattern"]) & F.coalesce(condition(r.get("ast_condition")), F.lit(False)), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))) for r in trees])
        parts.append((parsed if parsed is not None else nodes(files, kinds=node_kinds(active))).select("file_id", "line", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("file_id", "h.rule_id", "h.severity", "line"))
    limits = [r for r in active if r["type"] == "metric_threshold"]
    if limits and metrics is not None:
        hits = F.array(
            *[
                F.when((F.col("name") == r["metric_name"]) & COMPARISONS[r.get("comparison") or "gt"](F.col("value"), F.lit(float(r["threshold"]))), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity")))
                for r in limits
            ]
        )
        parts.append(metrics.select("file_id", F.lit(1).alias("line"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("file_id", "h.rule_id", "h.severity", "line"))
    if not parts:
        return files.sparkSession.createDataFrame([], "file_id bigint, rule_id string, severity string, line int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    composite = [r for r in active if r["type"] == "composite"]
    if not composite:
        return out
    have = files.select("file_id").join(out.groupBy("file_id").agg(F.collect_set("rule_id").alias("have")), "file_id", "left")
    have = have.withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    tests = []
    for r in composite:
        subs = [F.array_contains("have", s) for s in r.get("sub_rules") or []]
        logic = r.get("composite_logic") or "all"
        both = F.lit(bool(subs))
        some = F.lit(False)
        for s in subs:
            both, some = both & s, some | s
        test = both if logic == "all" else some if logic == "any" else ~some
        tests.append(F.when(test, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))))
    found = have.select("file_id", F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())).alias("h")).select("file_id", "h.rule_id", "h.severity", F.lit(1).alias("line"))
    return out.unionByName(found)
