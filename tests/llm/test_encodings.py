"""The margin on words that the model has not seen, from a public vocabulary: sound text stays under it, garbled text goes beyond."""

from __future__ import annotations

import base64
import os
import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from codestrata.llm import mojibake
from codestrata.llm.encodings import MARGIN

VOCABULARY = os.environ.get("TEST_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
CHAINS = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1252", "mac_roman")]
SCRIPTS = ["LATIN", "CYRILLIC"]


def script(word):
    return unicodedata.name(next(c for c in word if c > "\x7f"), "?").split()[0]


@pytest.fixture(scope="module")
def split():
    """A detector trained on every second word, and by script the known words and the unseen ones."""
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    words = []
    with open(VOCABULARY, encoding="ascii") as f:
        for line in f:
            try:
                word = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            if word[0] == " " and len(word) >= 5 and word[1:].isalpha():
                words.append(word[1:])
    train: Counter = Counter()
    known, unseen = defaultdict(list), defaultdict(list)
    for i, word in enumerate(words):
        if not word.isascii():
            (unseen if i % 2 else known)[script(word)].append(word)
        if word.isascii() or i % 2 == 0:
            train.update(g for g in mojibake.ngrams(word) for _ in range(20))
    return mojibake.Detector(mojibake.Model(train.items()), MARGIN), known, unseen


def lines_of(split, name, strangers, n=300):
    """Lines of five words, ``strangers`` of which the model has not seen."""
    _, known, unseen = split
    rng = random.Random(name)
    return [" ".join(rng.sample(unseen[name], strangers) + rng.sample(known[name], 5 - strangers)) for _ in range(n)]


@pytest.mark.parametrize(("name", "strangers", "most"), [("LATIN", 1, 0.04), ("CYRILLIC", 1, 0.01), ("CYRILLIC", 5, 0.02), ("LATIN", 5, 0.15)])
def test_sound_lines_stay_under_the_margin(split, name, strangers, most):
    # five Latin words here are of five languages, none of them seen: the hardest text there is
    lines = lines_of(split, name, strangers)
    beyond = [line for line in lines if split[0].judge(line).evidence > MARGIN]
    print(f"{name}, {strangers} of 5 words unseen: {len(beyond)} of {len(lines)} sound lines beyond the margin")
    assert len(beyond) <= most * len(lines), beyond[:5]


@pytest.mark.parametrize("name", SCRIPTS)
def test_garbled_lines_go_beyond_the_margin(split, name):
    tried, hit, restored = Counter(), Counter(), Counter()
    for line in lines_of(split, name, 5):
        for right, wrong in CHAINS:
            try:
                bad = line.encode(right).decode(wrong)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if bad != line:
                verdict = split[0].judge(bad)
                tried[right, wrong] += 1
                hit[right, wrong] += verdict.evidence > MARGIN
                restored[right, wrong] += verdict.restored == line
    for chain, n in sorted(tried.items()):
        print(f"{name}, {chain[0]} read as {chain[1]}: {hit[chain]} of {n} found, {restored[chain]} restored")
    assert sum(tried.values()) > 500
    assert sum(hit.values()) >= 0.99 * sum(tried.values()) and sum(restored.values()) >= 0.9 * sum(tried.values())
