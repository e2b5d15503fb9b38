"""Leaks up to the edit budget against planted cases, and alignment against plain dynamic programming."""

from __future__ import annotations

import random

import pytest

from codestrata.llm import leakage

VOCAB = [a + b + c for a in ("ba", "kor", "min", "stel", "va", "dru") for b in ("lo", "ne", "tri", "pa") for c in ("m", "st", "ka", "ring", "d", "xel")]


def item(rng, n):
    return [rng.choice(VOCAB) + rng.choice(["", "", "s", "ed"]) for _ in range(n)]


def edit(words, rng, every):
    """Every n-th word replaced, left out or preceded by another."""
    out = []
    for k, w in enumerate(words, 1):
        kind = rng.choice(["replace", "drop", "insert"]) if every > 3 else "replace"
        if k % every:
            out.append(w)
        elif kind != "drop":
            out += [rng.choice(VOCAB) + "x"] + [w] * (kind == "insert")
    return out


@pytest.mark.parametrize("every", [3, 4, 6, 12])
@pytest.mark.parametrize("size", [60, 300, 900])
def test_planted_passages_up_to_the_budget(every, size):
    rng = random.Random(every * size)
    items = {i: item(rng, size) for i in range(12)}
    index = leakage.Index(items)
    docs, want = [], set()
    for d in range(36):
        noise = item(rng, 120)
        if d % 3:
            w = items[d % 12]
            n = int(len(w) * rng.choice([0.6, 0.8, 1.0]))
            start = rng.randrange(len(w) - n + 1)
            noise[60:60] = edit(w[start : start + n], rng, every)
            want.add((d, d % 12))
        docs.append(noise)
    got = {(d, i) for d, i, low, high in index.regions(docs) if leakage.carries(docs[d], items[i], int(index.need[i]), low, high)}
    print(f"every {every} of {size}: {len(got & want)} of {len(want)}")
    assert got == want


def test_third_words_replaced_and_texts_of_one_pattern(spark):
    rng = random.Random(4)
    words = item(rng, 60)
    pattern = "which of {} {} and {} may see {} stale {} expected output {} {} only {} knows {} line {} calls {} under {} lock".split()
    fill = [[rng.choice(VOCAB) + " " + rng.choice(VOCAB) if w == "{}" else w for w in pattern] for _ in range(8)]
    texts = [" ".join(edit(words, rng, 3)), *[" ".join(f) for f in fill[1:]]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(fill[0]))], "item_id bigint, text string")
    for chars in (leakage.BLOCK_CHARS, 100):
        assert [tuple(r) for r in leakage.leaks(docs, items, block_chars=chars).collect()] == [(0, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_plain_programming(seed):
    rng = random.Random(seed)
    a, b = [rng.choice("abcd") for _ in range(rng.randrange(1, 25))], [rng.choice("abcd") for _ in range(rng.randrange(1, 25))]
    best, rows = 0, {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            at = rows.get((i - 1, j - 1), (0, 0))
            up, left = rows.get((i - 1, j), (0, 0)), rows.get((i, j - 1), (0, 0))
            cell = (at[0] + 1, at[1] + 1) if x == y else max((at[0] - 1, at[1]), (up[0] - 1, up[1]))
            cell = max(cell if cell >= (0, 0) else (0, 0), (left[0] - 1, left[1]))
            rows[i, j] = cell if cell[0] > 0 else (0, 0)
            if rows[i, j][1] - rows[i, j][0] <= leakage.EDITS * rows[i, j][1] + 1:
                best = max(best, rows[i, j][1])
    assert leakage.aligned(a, b, -100, 100) == best


def test_openings_as_in_the_small_form(spark):
    rows = [(i, f"Read the text below and answer. Item{i} alpha{i} beta{i} gamma{i}") for i in range(10)]
    own = leakage.own_words([(k, leakage.words_of(t)) for k, t in rows])
    got = {r.key: r.own.split() for r in leakage.own_texts(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id").collect()}
    assert got == own and own[3][0] == "3"
