"""Quotas met to the token, and no token beyond its cap, against a plain count."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from codestrata.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("seed", range(3))
def test_blocks_meet_quotas_and_caps(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 600)
    rng = random.Random(seed)
    rows = [(i, "word " * rng.choice([0, 1, 3, 40, 90, 700]), rng.choice("aabc")) for i in range(80)] + [(999, "word " * 5_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goal = {"a": (0.4, 2), "b": (0.3, 5), "c": (0.2, 1), "d": (0.1, 3)}
    targets = spark.createDataFrame([(k, *v) for k, v in goal.items()], TARGETS)
    sizes = {r.doc_id: r.n_tokens for r in mixing.count_tokens(docs, "doc_id", "source").collect()}
    mix, report = mixing.mix(docs, targets, block=16)
    pieces, shares = mix.collect(), {r.source: r for r in report.collect()}
    for s, r in shares.items():
        assert r.mixed_tokens == r.blocks * 16 and abs(r.reached_share - goal[s][0]) < 0.01
    times: dict[int, Counter] = {}
    for p in pieces:
        assert 0 <= p.from_token and p.n_tokens > 0 and p.from_token + p.n_tokens <= sizes[p.doc_id]
        for t in range(p.from_token, p.from_token + p.n_tokens):
            times.setdefault(p.doc_id, Counter())[t] += p.repeats
    source = {i: s for i, _, s in rows}
    for s, (_, cap) in goal.items():
        mine = [n for d, c in times.items() if source[d] == s for n in c.values()]
        assert sum(mine) == shares[s].mixed_tokens and max(mine) <= cap
        assert max(n for n in mine) == shares[s].most_repeats
    again = mixing.mix(docs.repartition(7), targets, block=16)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))
