"""Problem 6 over a corpus: files that are not valid text of their language, and the rates.

A file's language follows from its name, then its extension, by the rows of the ``languages`` table. Each file
is parsed on its own, where it is read; nothing is shuffled but the counts of the rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.syntax_check import LANGUAGES, fault

#: The registry is a property of the tool; more rows than this are a mistake.
MAX_LANGUAGES = 10_000


def language_of(languages: DataFrame, path: Column) -> Column:
    """Language of a path: by file name, else by extension (both in lower case); null if neither is listed.

    Of several rows for one name or extension the first by lang_name counts.
    """
    rows = languages.select("lang_name", "extensions", "filename_patterns").filter(F.col("lang_name").isNotNull()).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError("the table of languages is not a registry")
    names: dict[str, str] = {}
    endings: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r[0]):
        for e in r[1] or []:
            if e:
                endings.setdefault(e.lower(), r[0])
        for n in r[2] or []:
            if n:
                names.setdefault(n.lower(), r[0])
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    # the longest listed ending of the name
    by_ending = F.coalesce(*[F.when(F.endswith(name, F.lit(e)), F.lit(endings[e])) for e in sorted(endings, key=lambda e: (-len(e), e))], F.lit(None).cast("string"))
    by_name = F.coalesce(*[F.when(name == n, F.lit(names[n])) for n in sorted(names)], F.lit(None).cast("string"))
    return F.coalesce(by_name, by_ending)


def checked(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``file_id, repo, lang_name, fault, line, column, token`` of every file with content and a known language.

    ``fault`` is null for valid files, ``token`` where a token cannot stand, ``end`` where the text stops too
    early; then ``line`` and ``column`` (from 1) are those of the failing token or of the end. Null contents
    are not checked, empty ones are (an empty JSON text is not valid, an empty program is); texts are read
    whole; files delivered twice are checked each. A language without a grammar here gives no rows.
    """
    known = F.col("lang_name").isin(*LANGUAGES)
    some = files.select("file_id", "repo", language_of(languages, F.col("path")).alias("lang_name"), "content").filter(known & F.col("content").isNotNull())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for lang, text in zip(pdf["lang_name"], pdf["content"], strict=True):
                f = fault(lang, text)
                found.append((f.kind, f.line, f.column, f.token) if f else (None, None, None, None))
            out = pd.DataFrame(found, columns=["fault", "line", "column", "token"]).astype({"line": "Int64", "column": "Int64"})
            yield pd.concat([pdf[["file_id", "repo", "lang_name"]].reset_index(drop=True), out], axis=1)

    return some.mapInPandas(walk, "file_id bigint, repo string, lang_name string, fault string, line bigint, column bigint, token string")


def rates(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Per repository and language the files with content, the invalid ones, and their share."""
    return (
        checked(files, languages)
        .groupBy("repo", "lang_name")
        .agg(F.count("*").alias("files"), F.count("fault").alias("invalid"), F.count_if(F.col("fault") == "end").alias("truncated"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
