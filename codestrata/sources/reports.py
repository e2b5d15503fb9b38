"""Sinks: JSON, SARIF, Markdown and benchmark files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.severity import lookup, sarif_level, status


#: Findings in one document; a repository with more gets several, so that no document grows with the data.
DOCUMENT_FINDINGS = 10_000


def _parts(findings: DataFrame, size: int) -> DataFrame:
    """Adds ``part``: findings of a repository spread over as many documents as it needs, by hash."""
    counts = findings.groupBy("repo").agg(F.count("*").alias("_n"))
    parts = F.floor((F.col("_n") - 1) / size) + 1
    keyed = F.xxhash64("category", "rule_id", "file_path", "line_start", "message")
    return findings.join(counts, "repo").withColumn("part", F.pmod(keyed, parts)).drop("_n")


def json_reports(scores: DataFrame, findings: DataFrame, size: int = DOCUMENT_FINDINGS) -> DataFrame:
    """SNK1, D10: nested JSON documents per repository, with about ``size`` findings each.

    Categories and findings are sorted, so equal inputs give equal text; every part has all categories, those of
    the scores and those of the findings. A category without a score, or a repository without any, has findings only.
    """
    f = _parts(findings, size).groupBy("repo", "part", "category").agg(F.array_sort(F.collect_list(F.struct("file_path", "line_start", "rule_id", "severity", "message"))).alias("findings"))
    some = f.select("repo", "part").distinct()
    delivered = scores.select("repo", "category", "score", "weight")
    unscored = f.select("repo", "category").distinct().join(delivered, ["repo", "category"], "left_anti")
    every = delivered.unionByName(unscored, allowMissingColumns=True).join(some, "repo", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    c = every.join(f, ["repo", "part", "category"], "left")
    cats = c.groupBy("repo", "part").agg(F.array_sort(F.collect_list(F.struct("category", "score", "weight", "findings"))).alias("categories"))
    return cats.select("repo", "part", F.to_json(F.struct(F.col("repo").alias("repository"), "part", "categories")).alias("document"))


def sarif(findings: DataFrame, size: int = DOCUMENT_FINDINGS) -> DataFrame:
    """SNK2: SARIF 2.1.0 documents per repository; rules are numbered by first appearance (``ord``), lines clamped to 1.

    A repository with more than ``size`` findings has several documents, which share the numbers of its rules.
    """
    first = findings.groupBy("repo", "rule_id").agg(F.min("ord").alias("first"))
    number = F.concat(F.lit("CA"), F.lpad(F.row_number().over(Window.partitionBy("repo").orderBy("first", "rule_id")).cast("string"), 4, "0"))
    rules = first.withColumn("number", number)
    region = F.struct(F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("line_end", "line_start", F.lit(1)), F.lit(1)).alias("endLine"))
    place = F.struct(F.struct(F.struct(F.coalesce("file_path", F.lit("")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct("ord", F.struct(F.col("number").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.coalesce("message", "rule_id").alias("text")).alias("message"), F.array(place).alias("locations")).alias("r"))
    results = _parts(findings, size).join(rules.select("repo", "rule_id", "number"), ["repo", "rule_id"]).groupBy("repo", "part").agg(F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    listed = rules.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("id"), F.col("rule_id").alias("name")))).alias("rules"))
    tool = F.struct(F.struct(F.lit("codestrata").alias("name"), "rules").alias("driver"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(tool.alias("tool"), "results")).alias("runs"))
    return results.join(listed, "repo").select("repo", "part", F.to_json(doc).alias("document"))


def markdown(scores: DataFrame) -> DataFrame:
    """SNK3: a score table per repository, worst category first."""
    row = F.format_string("| %s | %.1f | %s |", "category", "score", status(F.col("score")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("score", "category", row.alias("row")))), lambda x: x["row"])
    head = F.concat(F.lit("# "), F.col("repo"), F.lit("\n\n| Category | Score | Status |\n|---|---|---|\n"))
    return scores.filter("score IS NOT NULL").groupBy("repo").agg(lines.alias("l")).select("repo", F.concat(head, F.array_join("l", "\n"), F.lit("\n")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One row per document, partition files under ``path``."""
    documents.write.mode("overwrite").json(path)


def write_benchmark(rows: DataFrame, path: str) -> None:
    """SNK13."""
    rows.write.mode("overwrite").json(path)


def _text(column: str) -> Column:
    """A column with the five characters replaced that mean something in HTML."""
    out = F.coalesce(column, F.lit(""))
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        out = F.replace(out, F.lit(mark), F.lit(f"&{name};"))
    return out


def html(scores: DataFrame, findings: DataFrame, most: int = 20) -> DataFrame:
    """SNK4, TOP4: ``repo, document``: a page per repository with its categories, worst first, and its first ``most`` critical and high findings in order (``ord``)."""
    row = F.concat(F.lit("<tr><td>"), _text("category"), F.lit("</td><td>"), F.format_string("%.1f", "score"), F.lit("</td><td>"), status(F.col("score")), F.lit("</td></tr>"))
    cats = scores.filter("score IS NOT NULL").groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score", "category", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    item = F.concat(F.lit("<li>"), _text("severity"), F.lit(": "), _text("rule_id"), F.lit(" "), _text("file_path"), F.lit("</li>"))
    listed = first_findings(findings, most).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    head = F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>"), _text("repo"), F.lit("</title></head><body>\n<h1>"), _text("repo"), F.lit("</h1>\n<table>\n"))
    body = F.concat(head, "rows", F.lit("\n</table>\n<ul>\n"), F.coalesce("items", F.lit("")), F.lit("\n</ul>\n</body></html>\n"))
    return cats.join(listed, "repo", "left").select("repo", body.alias("document"))


def first_findings(findings: DataFrame, most: int) -> DataFrame:
    """TOP4: the first ``most`` critical and high findings of every repository in order (``ord``), numbered."""
    n = F.row_number().over(Window.partitionBy("repo").orderBy("ord"))
    return findings.filter(F.col("severity").isin("critical", "high")).withColumn("n", n).filter(F.col("n") <= most)


def console(overall: DataFrame, scores: DataFrame) -> DataFrame:
    """SNK5: ``repo, text``: the summary that is printed: score and risk, then the categories from best to worst."""
    line = F.format_string("  %-20s %5.1f", "category", "score")
    lines = scores.filter("score IS NOT NULL").groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "category", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return overall.join(lines, "repo").select("repo", F.concat(F.format_string("%s: %.1f (%s)\n", "repo", "overall_score", "risk_level"), "lines").alias("text"))


# ---- Fixed values: marks of changes ----
MARKS = {"improved": "[+]", "regressed": "[-]", "new": "[+]", "removed": "[-]", "unchanged": "[=]"}
# ----------------------------------------


def _changes(diff: DataFrame) -> DataFrame:
    """TOP6: what a comparison shows, worst change first within a repository and snapshot; unchanged categories under 0.1 are hidden."""
    before, after = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    rows = diff.withColumn("before", before).withColumn("after", after)
    return rows.filter((F.col("change") != "unchanged") | (F.abs("delta") >= 0.1))


def comparison(diff: DataFrame, form: str = "console") -> DataFrame:
    """SNK9, TOP6: ``repo, snapshot_no, document`` of rows ``repo, snapshot_no, category, before, after, delta, change`` as console text, markdown or json."""
    mark = lookup(F.col("change"), MARKS, "[?]")
    if form == "json":
        item = F.struct("delta", "category", F.struct("category", F.col("before").alias("score_before"), F.col("after").alias("score_after"), "delta", F.col("change").alias("change_type")).alias("c"))
        per = _changes(diff).groupBy("repo", "snapshot_no").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("categories"))
        return per.select("repo", "snapshot_no", F.to_json(F.struct("repo", "snapshot_no", "categories")).alias("document"))
    if form == "markdown":
        line = F.format_string("### %s %s\n- **Score:** %.1f -> %.1f (%+.1f)\n- **Change:** %s", mark, "category", "before", "after", "delta", "change")
        head = F.format_string("# Comparison of %s, snapshot %d\n\n", "repo", "snapshot_no")
    else:
        line = F.format_string("  %s %-20s %5.1f -> %5.1f (%+.1f)", mark, "category", "before", "after", "delta")
        head = F.format_string("%s, snapshot %d\n", "repo", "snapshot_no")
    per = _changes(diff).groupBy("repo", "snapshot_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("delta", "category", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return per.select("repo", "snapshot_no", F.concat(head, "lines").alias("document"))
