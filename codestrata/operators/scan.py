"""Scans of whole texts for patterns, with exact places, in the JVM.

Matches and the gaps between them come from two built-in functions over one regular expression; a match
begins after all earlier gaps and matches. No text is cut into lines first, as matches may span lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import extension
from codestrata.operators.patterns import SETS, SUFFIXES, Pattern


def java_regex(p: Pattern) -> str:
    """The pattern in the JVM's dialect: only a line feed ends a line."""
    return ("(?id)" if p.ignore_case else "(?d)") + p.regex


def match_starts(text: Column, regex: str) -> Column:
    """0-based starts of all matches, as an array (the pattern must not match the empty text)."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    pairs = F.arrays_zip(steps.alias("s"), found.alias("m"))
    walked = F.aggregate(
        F.filter(pairs, lambda p: p["m"].isNotNull()),
        first,
        lambda acc, p: F.struct(
            (acc["at"] + p["s"]["gap"] + p["s"]["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["s"]["gap"]).alias("start"), p["m"].alias("text")))).alias("out"),
        ),
    )
    return walked["out"]


def scan(texts: DataFrame, patterns: Sequence[Pattern], text: str = "content") -> DataFrame:
    """One row per match, with all columns of ``texts`` but the text.

    Adds rule_id, severity, cwe, start (0-based), line, column_start (1-based), column_end (behind the match,
    counted from the match's first line) and snippet (that line, trimmed). Null and empty texts give no rows.
    """
    keep = [c for c in texts.columns if c != text]
    some = texts.filter(F.col(text).isNotNull() & F.col(text).rlike("|".join(f"(?:{java_regex(p)})" for p in patterns)))
    rules = F.array(
        *[
            F.struct(
                F.lit(p.id).alias("rule_id"),
                F.lit(p.severity).alias("severity"),
                F.lit(p.cwe).cast("string").alias("cwe"),
                match_starts(F.col(text), java_regex(p)).alias("found"),
            )
            for p in patterns
        ]
    )
    rows = some.withColumn("_r", F.explode(F.filter(rules, lambda r: F.size(r["found"]) > 0))).withColumn("_m", F.explode("_r.found"))
    head = F.substring(F.col(text), F.lit(1), F.col("_m.start"))
    line_begin = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    rest = F.expr(f"substring(`{text}`, _begin + 1)")
    return (
        rows.withColumn("_begin", line_begin)
        .withColumn("line", F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)
        .withColumn("snippet", F.trim(F.regexp_replace(F.substring_index(rest, "\n", 1), r"^\s+|\s+$", "")))
        .select(
            *keep,
            F.col("_r.rule_id").alias("rule_id"),
            F.col("_r.severity").alias("severity"),
            F.col("_r.cwe").alias("cwe"),
            F.col("_m.start").alias("start"),
            "line",
            (F.col("_m.start") - F.col("_begin") + 1).alias("column_start"),
            (F.col("_m.start") + F.length("_m.text") - F.col("_begin") + 1).alias("column_end"),
            "snippet",
        )
    )


def of_language(files: DataFrame, language: str, path: str = "path") -> DataFrame:
    """The files whose ending belongs to a language of the scans."""
    return files.filter(extension(path).isin(SUFFIXES[language]))


def scan_all(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Every file scanned with the pattern set of its language; adds ``language``."""
    out = None
    for language, patterns in SETS.items():
        part = scan(of_language(files, language, path).withColumn("language", F.lit(language)), patterns, text)
        out = part if out is None else out.unionByName(part)
    return out


def pattern_counts(files: DataFrame, key: Sequence[str], path: str = "path", text: str = "content") -> DataFrame:
    """Matches per file and rule without their places: what a score needs, for one pass and no array."""
    out = None
    for language, patterns in SETS.items():
        counts = F.array(
            *[F.struct(F.lit(p.id).alias("rule_id"), F.lit(p.severity).alias("severity"), F.regexp_count(F.col(text), F.lit(java_regex(p))).alias("n")) for p in patterns]
        )
        part = (
            of_language(files, language, path)
            .filter(F.col(text).isNotNull())
            .select(*key, F.lit(language).alias("language"), F.explode(counts).alias("c"))
            .select(*key, "language", "c.*")
            .filter("n > 0")
        )
        out = part if out is None else out.unionByName(part)
    return out
