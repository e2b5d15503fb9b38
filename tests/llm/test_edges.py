"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

from __future__ import annotations

import datetime as dt

import pytest

from codestrata.llm import encodings, handwritten, leakage, mixing, mojibake, quantiles, secrets, syntax

T = dt.datetime(2025, 1, 1)
FILES = "file_id bigint, repo string, path string, ord bigint, content string, loaded_at timestamp_ntz, body string, lines string, reason string, text string, value string"
FINDINGS = "row_id bigint, repo string, code_snippet string, tbl string, row_key string, spans string"
DOCS = "doc_id bigint, text string, source string, repo string, gram string, n bigint, evidence string, shard string, repeats int, item_id string"
LONG = "word " * 60_000


def files(spark, *rows):
    return spark.createDataFrame([(i, r, p, i, c, T, "x", "x", "x", "x", "x") for i, (r, p, c) in enumerate(rows)], FILES)


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, None, "g", 1, "e", "s", 9, "i") for i, (t, s) in enumerate(rows)], DOCS)


EDGE = [(None, None, None), ("r", "a.py", None), ("r", "a.py", ""), (None, "a.js", "let x = 1"), ("r", None, "let y"), ("r", "long.py", "x = 1\n" * 60_000), ("r", "one.js", "var a = '" + "z" * 300_000 + "';"), ("r", "tie.py", "y = 2"), ("r", "tie.py", "y = 2")]


def test_handwritten(spark):
    assert handwritten.not_handwritten(files(spark)).collect() == []
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(files(spark, *EDGE)).collect()}
    assert not {0, 1, 2, 3, 4, 7, 8} & set(got)


def test_secrets(spark):
    empty = spark.createDataFrame([], FINDINGS)
    assert secrets.found_lines(files(spark), empty).collect() == [] and secrets.redacted(files(spark), empty).collect() == []
    finds = spark.createDataFrame([(1, None, None, "a", "b", "c"), (2, "r", "", "a", "b", "c"), (3, "q", 'password = "kettle48213"', "a", "b", "c"), (3, "q", 'password = "kettle48213"', "a", "b", "c")], FINDINGS)
    rows = [*EDGE, ("q", "c.env", LONG + "\nPASSWORD=kettle48213\n" + LONG)]
    got = sorted(tuple(r) for r in secrets.found_lines(files(spark, *rows), finds).collect())
    assert got == [("files", 9, 2), ("findings", 3, 1)]


def test_quantiles(spark):
    schema = "run_id bigint, repo_name string, started_at timestamp_ntz, times_ms array<double>, loaded_at timestamp_ntz, key string, digit string, prefix string"
    keys = quantiles.run_values(spark.createDataFrame([], schema))
    assert quantiles.radix_select(keys, ["repo_name"]).collect() == []
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", T, [1.0, None, nan, -1.0, inf, 3.0], T), (1, "a", T, [1.0, None, nan, -1.0, inf, 3.0], T + dt.timedelta(1)), (2, "a", T, None, T), (3, "a", T, [], None),
        (None, None, None, [5.0, 5.0, 5.0], T), (None, None, None, [7.0], T), (4, "b", T, [0.0, -0.0, 5e-324], T), (5, "only invalid", T, [nan, -1.0, None], T),
    ]
    keys = quantiles.run_values(spark.createDataFrame([(*r, "k", "d", "p") for r in rows], schema))
    got = {r.repo_name: (r.n, r.p50, r.p90, r.p99) for r in quantiles.radix_select(keys, ["repo_name"]).collect()}
    assert got == {"a": (2, 1.0, 3.0, 3.0), None: (4, 5.0, 7.0, 7.0), "b": (3, 0.0, 5e-324, 5e-324)}


LANGS = "lang_name string, extensions array<string>, filename_patterns array<string>, shebang_patterns array<string>, repo string, content string"


def test_syntax(spark):
    langs = spark.createDataFrame([("python", [".py"], [], [], "x", "y"), ("javascript", [".js"], None, None, "x", "y"), ("json", [".json", None], ["lock"], [], "x", "y"), ("klingon", [".kl"], [], [], "x", "y"), (None, [".zz"], [], [], "x", "y")], LANGS)
    assert syntax.checked(files(spark), langs).collect() == [] and syntax.rates(files(spark), langs).collect() == []
    rows = [*EDGE, ("r", "LOCK", "{}"), ("r", "e.json", ""), ("r", "a.kl", "qapla'"), ("r", "deep.json", "[" * 50_000), ("r", "deep.py", "(" * 5_000), ("r", "x.zz", "?")]
    got = {r.file_id: r.fault for r in syntax.checked(files(spark, *rows), langs).collect()}
    assert got == {2: None, 3: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: "end", 12: "end", 13: "end"}
    none = spark.createDataFrame([], LANGS)
    assert syntax.checked(files(spark, *EDGE), none).collect() == []


ITEMS = "item_id bigint, suite string, text string, doc_id string"
PASSAGE = "Line 3737 calls reconcile_report under willow catalog lock, line 234 calls throttle_cluster. Only canyon knows voucher 3378; project_batch guesses commit from 222 drift hints."


def test_leakage(spark):
    items = spark.createDataFrame([(1, "s", PASSAGE, "d"), (2, "s", PASSAGE, "d"), (3, "s", None, "d"), (4, "s", "", "d"), (None, "s", PASSAGE, "d"), (5, "s", "too short to count", "d")], ITEMS)
    assert leakage.leaks(docs(spark), items).collect() == []
    assert leakage.leaks(docs(spark, (PASSAGE, "a")), spark.createDataFrame([], ITEMS)).collect() == []
    rows = [(None, "a"), ("", "a"), (LONG + PASSAGE + LONG, "a"), (PASSAGE, None), (PASSAGE, None), ("too short to count", "a"), (LONG, "a")]
    got = sorted(tuple(r) for r in leakage.leaks(docs(spark, *rows), items).collect())
    assert got == [(d, i) for d in (2, 3, 4) for i in (1, 2)]


TARGETS = "source string, target_share double, max_repeats int, text string"


def test_mixing(spark):
    t = spark.createDataFrame([("a", 0.5, 2, "x"), ("b", 0.5, 3, "x"), (None, 0.1, 1, "x"), ("gone", 0.2, 2, "x"), ("zero", 0.0, 2, "x"), ("null", None, None, "x")], TARGETS)
    m, r = mixing.mix(docs(spark), t)
    assert m.collect() == [] and {x.source: x.reached_share for x in r.collect()} == dict.fromkeys(("a", "b", "gone", "zero", "null"), 0.0)
    m, r = mixing.mix(docs(spark, *[(LONG, "a"), (None, "a"), ("", "b"), ("x y z", None), ("x", "other")] + [("one two three four", "b")] * 400), t)
    shares = {x.source: x for x in r.collect()}
    # a document that is longer than its source's quota gives blocks
    assert abs(shares["a"].reached_share - 0.5) < 0.02 and shares["a"].most_repeats == 1 and 0 < shares["b"].most_repeats <= 3 and shares["gone"].mixed_tokens == 0
    m, r = mixing.mix(docs(spark, *[("word " * 40, "a")] * 100, *[("one two three four", "b")] * 400), t)
    assert all(abs(x.reached_share - 0.5) < 0.05 for x in r.collect() if x.source in "ab")
    assert mixing.mix(docs(spark, ("x", "a")), spark.createDataFrame([], TARGETS))[0].collect() == []


def test_encodings(spark):
    assert encodings.garbled(docs(spark)).collect() == []
    sound = [("Für die Prüfung müssen größere Zähler später überlaufen, schön wäre früher Abbruch.", "a")] * 40
    bad = "Für die Prüfung müssen größere Zähler später überlaufen".encode().decode("cp1252")
    rows = [*sound, (None, "a"), ("", "a"), ("ascii only", None), (LONG + bad, "a"), (bad, "a"), (bad, "a"), ("lost \ufffd\ufffd", "a"), ("ü" * 100_000, "a")]
    got = {r.doc_id: r.restored for r in encodings.garbled(docs(spark, *rows), restore=True).collect()}
    assert set(got) == {43, 44, 45, 46} and got[44] == "Für die Prüfung müssen größere Zähler später überlaufen" and got[46] is None


def test_encodings_with_rare_letters(spark, monkeypatch):
    # the letter of a rare word stands only in trigrams that the bound leaves out of the model
    monkeypatch.setattr(encodings, "MIN_SHARE", 5e-4)
    russian = "Привет мир, это проверка новой записи перед выпуском следующей версии"
    sound = [("Für die Prüfung müssen größere Zähler später überlaufen, schön wäre früher Abbruch.", "a")] * 40 + [(russian, "b")] * 40 + [(russian + " съёмка", "b")]
    bad = (russian + " съёмка").encode("cp1251").decode("latin-1")
    got = {r.doc_id: r.restored for r in encodings.garbled(docs(spark, *sound, (bad, "b")), restore=True).collect()}
    assert got == {81: russian + " съёмка"}


def test_encoding_model_of_all_marginals(spark, monkeypatch):
    monkeypatch.setattr(encodings, "MIN_SHARE", 0.0)
    trigrams, lower = encodings.train(docs(spark, ("ab", "a"), ("ac", "a")))
    whole, plain = mojibake.Model(trigrams, lower), mojibake.Model(trigrams)
    assert all(getattr(whole, x) == getattr(plain, x) for x in ("tri", "ctx2", "types2", "bi", "ctx1", "types1", "uni", "total", "types"))


@pytest.mark.parametrize("name", ["p1_reasons", "p3_redacted", "p5_weekly_from_days", "p6_rates", "p7_leaked_items", "p8_shares", "p9_restored"])
def test_queries_run(name, spark, sf_dir):
    from codestrata.llm import queries

    df = queries.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_oracles(same):
    from codestrata.llm import queries

    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name], sql)
