"""Problem 7: passages of evaluation items in training documents, by q-gram lemma filtering.

Texts are reduced to their words (lower case, names split at case and underscores, markup and punctuation
dropped) and joined without spaces, so that layout cannot hide a passage. A passage of m characters in words that
were copied with k words edited falls into at most ``k + 1`` intact pieces, each of which loses ``q - 1`` of its
q-grams, so it shares at least ``m - (q - 1) * (k + 1)`` of them with its item (the q-gram lemma), and all lie on
diagonals ``position in document - position in item`` that the edits move by no more than their length. Shared
q-grams are counted in bands of diagonals that overlap by half; regions that reach the bound for the edit budget are
verified by a banded alignment of their words.

Items are a stated query set. They are indexed in blocks of bounded size, all in one pass over the documents, and
every document is compared with every block; nothing is sampled and no list of partners is cut.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

Q = 9
#: Least width of a band of diagonals.
BAND = 64
#: Share of an item's own words that must stand in the document, in order; never fewer than MIN_WORDS.
SHARE = 1 / 3
MIN_WORDS = 10
#: Edit budget: words replaced, put in or left out within a passage for each of its words that stand in the document.
#: Two texts of one pattern, with other names and numbers, are further apart.
EDITS = 0.5
#: The bound of the lemma is for words of the item's mean length; regions of fewer shared q-grams are never looked at.
LEAST_GRAMS = 4
#: An opening that this many different items share (and this share of them) is an instruction, not a passage.
OPENING_ITEMS, OPENING_SHARE = 5, 0.01
OPENING_WORDS = (4, 80)
#: Characters of items in an index block (about 30 bytes of memory each), and blocks that a worker keeps.
BLOCK_CHARS, KEPT_BLOCKS = 2_000_000, 4
#: Shared q-grams that are counted at once (a document is never split).
MOST_HITS = 4_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->")
_WORD = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-ÖØ-Þ][a-zß-ÿ]+|\d+|[^\W\d_A-Za-zÀ-ÿ぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]")
_ENTITY = re.compile(r"&#?\w{1,10};")


def words_of(text: str) -> list[str]:
    """The words of a text without regard to layout, markup, case, punctuation and the spelling of names."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    return [w.lower() for w in _WORD.findall(text)]


def _openings(words: list[str]) -> Iterator[int]:
    """Hashes of the openings of a text, shortest first."""
    h = xxhash.xxh64()
    for n, w in enumerate(words[: OPENING_WORDS[1]], 1):
        h.update(w + " ")
        if n >= OPENING_WORDS[0]:
            yield h.intdigest() - (1 << 63)


def own_words(items: list[tuple[int, list[str]]]) -> dict[int, list[str]]:
    """Each item's words without the opening that many different items share, for a small set of items."""
    distinct = {tuple(w) for _, w in items}
    shared: dict[int, int] = defaultdict(int)
    for w in distinct:
        for h in _openings(list(w)):
            shared[h] += 1
    need = max(OPENING_ITEMS, int(np.ceil(OPENING_SHARE * len(distinct))))
    common = {h for h, n in shared.items() if n >= need}
    return {key: _own(words, common) for key, words in items}


def _own(words: list[str], common: set[int]) -> list[str]:
    longest = max((n for n, h in enumerate(_openings(words), OPENING_WORDS[0]) if h in common), default=0)
    return words[longest:]


def own_texts(items: DataFrame, item_key: str) -> DataFrame:
    """``key, own, chars``: the words of every item, without its instruction, joined by spaces.

    Items that are equal as a whole (re-issued ones) count once, so that they are no reason to take a passage
    for an instruction. At most ``1 / OPENING_SHARE`` openings of each length are common.
    """
    some = items.select(F.col(item_key).cast("bigint").alias("key"), "text").filter(F.col("text").isNotNull() & F.col(item_key).isNotNull()).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "words": [" ".join(words_of(t)) for t in pdf["text"]]})

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"opening": [h for t in pdf["words"] for h in _openings(t.split())]}, dtype="int64")

    words = cut(some.mapInPandas(split, "key bigint, words string"))
    distinct = words.select("words").distinct()
    need = max(OPENING_ITEMS, int(np.ceil(OPENING_SHARE * distinct.count())))
    common = distinct.mapInPandas(openings, "opening bigint").groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") >= need)
    known = {r[0] for r in common.select("opening").collect()}

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [" ".join(_own(t.split(), known)) for t in pdf["words"]]
            yield pd.DataFrame({"key": pdf["key"], "own": own, "chars": [len(o) for o in own]})

    return words.mapInPandas(strip, "key bigint, own string, chars bigint")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Rolling polynomial hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = h * base + codes[k : k + n]
        h ^= h >> np.uint64(29)
    return h


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: dict[int, list[str]] | list[tuple[int, list[str]]], q: int = Q):
        items = list(items.items()) if isinstance(items, dict) else items
        self.q = q
        self.keys = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.need = np.array([max(MIN_WORDS, int(np.ceil(SHARE * len(w)))) for w in self.words], dtype=np.int64)
        hashes, owner, pos, bound, band = [], [], [], [], []
        for i, w in enumerate(self.words):
            h = _hashes(_codes(w), q)
            hashes.append(h)
            owner.append(np.full(len(h), i, np.int64))
            pos.append(np.arange(len(h), dtype=np.int64))
            need = int(self.need[i])
            mean = sum(map(len, w)) / len(w) if w else 0.0
            chars, edits = int(need * mean), int(EDITS * need)
            bound.append(max(min(LEAST_GRAMS, chars - q + 1), chars - (q - 1) * (edits + 1), 1) if len(w) >= need else 1 << 40)
            band.append(max(BAND, int(edits * mean)))
        self.bound = np.array(bound, dtype=np.int64)
        self.band = np.array(band, dtype=np.int64)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash, self.owner, self.pos = flat[order], np.concatenate(owner)[order] if owner else order, np.concatenate(pos)[order] if pos else order
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def regions(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, lowest and highest diagonal) of the regions that reach the bound."""
        codes = [_codes(w) for w in docs]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        if not len(self.hash) or not sizes.sum():
            return
        flat = np.concatenate(codes)
        h = _hashes(flat, self.q)
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(self.hash, h[at], "left")
        high = np.searchsorted(self.hash, h[at], "right")
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at, "right")
        inside = (high > low) & (at + self.q <= ends[doc])
        at, low, high, doc = at[inside], low[inside], high[inside], doc[inside]
        total = np.cumsum(high - low)
        # Whole documents at a time, about MOST_HITS hits in one go.
        first = 0
        while first < len(at):
            last = int(np.searchsorted(total, (total[first - 1] if first else 0) + MOST_HITS, "right"))
            last = max(int(np.searchsorted(doc, doc[min(last, len(at) - 1)], "left")) if last < len(at) else last, int(np.searchsorted(doc, doc[first], "right")))
            some = slice(first, last)
            yield from self._counted(doc[some], (at - (ends - sizes)[doc])[some], low[some], high[some])
            first = last

    def _counted(self, doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        n = high - low
        idx = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diag = self.owner[idx], np.repeat(place, n) - self.pos[idx]
        doc = np.repeat(doc, n)
        width = self.band[item]
        for shift in (0, 1):
            band = (diag + shift * (width // 2)) // width
            key = (doc * len(self.keys) + item) * np.int64(1 << 24) + (band + (1 << 23))
            order = np.argsort(key, kind="stable")
            key, places = key[order], diag[order]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([begins, [len(key)]]))
            most, least = np.maximum.reduceat(places, begins), np.minimum.reduceat(places, begins)
            for f in np.flatnonzero(count >= self.bound[item[order[begins]]]):
                j = order[begins[f]]
                yield int(doc[j]), int(item[j]), int(least[f]), int(most[f])


def aligned(item: list[str], doc: list[str], low: int, high: int, enough: int | None = None) -> int:
    """Most words that agree in a local alignment within the edit budget whose cells keep to the character diagonals ``low`` to ``high``.

    An agreement counts one, a word replaced, put in or left out minus one; an alignment that is down to nothing
    begins anew, and every cell may be its end. With ``enough`` only that many words matter, and no more are looked for.
    """
    item_at = np.cumsum([0, *map(len, item)])
    doc_at = np.cumsum([0, *map(len, doc)])
    first = max(0, int(np.searchsorted(doc_at, low, "right")) - 1)
    last = int(np.searchsorted(doc_at, high + item_at[-1], "right"))
    part = doc[first:last]
    if not part:
        return 0
    if enough is not None and sum((Counter(item) & Counter(part)).values()) < enough:
        return 0
    ids: dict[str, int] = {}
    b = np.array([ids.setdefault(w, len(ids)) for w in part], dtype=np.int64)
    a = [ids.get(w, -1) for w in item]
    diag = doc_at[first : first + len(part)]
    one = np.int64(1) << 32  # the score, above the agreements
    n = len(part)
    row = np.zeros(n + 1, np.int64)
    # Row i only reaches the cells in its band.
    lows = np.searchsorted(diag, item_at[:-1] + low, "left")
    highs = np.searchsorted(diag, item_at[:-1] + high, "right")
    best, steps = 0, np.arange(n + 1, dtype=np.int64) * one
    for i, x in enumerate(a):
        l, r = int(lows[i]), int(highs[i])
        fresh = np.zeros(n + 1, np.int64)
        if r > l:
            before, above = row[l:r], row[l + 1 : r + 1]
            here = np.where(b[l:r] == x, before + one + 1, np.maximum(before, above) - one)
            here = np.maximum.accumulate(np.maximum(here, 0) + steps[: r - l]) - steps[: r - l]  # words put in
            here[here < one] = 0
            fresh[l + 1 : r + 1] = here
            agree = here & 0xFFFFFFFF
            best = max(best, int(agree[agree - (here >> 32) <= EDITS * agree + 1].max(initial=0)))
            if enough is not None and best >= enough:
                break
        row = fresh
    return best


def carries(doc: list[str], item: list[str], need: int, low: int, high: int) -> bool:
    """Whether ``need`` words of the item stand in the document in order, near the given character diagonals and within the edit budget."""
    mean = sum(map(len, item)) / max(len(item), 1)
    slack = max(BAND, int(EDITS * need * mean))
    return aligned(item, doc, low - slack, high + slack, need) >= need


_indexes: dict = {}


def _index(mark: tuple, block) -> Index:
    """The index of a block; a worker keeps the last few."""
    if mark not in _indexes:
        while len(_indexes) >= KEPT_BLOCKS:
            _indexes.pop(next(iter(_indexes)))
        _indexes[mark] = Index([(k, own.split()) for k, own in block.value])
    return _indexes[mark]


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_key, item_key``: the documents that carry at least a third of an item's own words, in order.

    Own words are an item's words without the instruction many items open with; fewer than ten matching
    words never count, nor does a passage with more than one edit for two of its words. Items with the same
    passage are all reported. Null and empty texts carry nothing; repeated documents are reported each; texts are
    read whole.
    """
    spark = docs.sparkSession
    own = cut(own_texts(items, item_key))
    total = own.agg(F.sum("chars")).first()[0] or 0
    count = int(total // block_chars) + 1
    place = F.pmod(F.xxhash64("key", "own"), F.lit(count))
    blocks = []
    for n in range(count if total else 0):
        rows = sorted((r[0], r[1]) for r in own.filter(place == n).select("key", "own").collect())
        blocks.append(spark.sparkContext.broadcast(rows))
    texts = docs.select(doc_key, "text").filter(F.col("text").isNotNull() & (F.length("text") >= MIN_WORDS))
    mark = uuid.uuid4().hex  # what a reused worker knows the indexes by

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            ids = pdf[doc_key].to_numpy()
            for n, block in enumerate(blocks):
                index, hits = _index((mark, n), block), []
                for at in range(0, len(pdf), 500):
                    part = words[at : at + 500]
                    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                    for d, i, low, high in index.regions(part):
                        spans[(d, i)].append((low, high))
                    for (d, i), diags in spans.items():
                        if any(carries(part[d], index.words[i], int(index.need[i]), low, high) for low, high in _merged(diags)):
                            hits.append((ids[at + d], index.keys[i]))
                if hits:
                    yield pd.DataFrame(hits, columns=[doc_key, item_key])

    schema = f"`{doc_key}` bigint, `{item_key}` bigint"
    return texts.mapInPandas(walk, schema) if blocks else spark.createDataFrame([], schema)


def _merged(diags: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Regions that overlap, as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(diags):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out
