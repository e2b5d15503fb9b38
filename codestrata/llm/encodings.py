"""Problem 9 over a corpus: train on clean records, find the garbled ones, restore them.

The trigram counts cover every record. As nothing says which records are clean, a first model is trained on
all of them (garbled ones are few, so that in every language the right sequences outweigh the garbled ones),
it judges all records, and the final model is trained on those it finds sound.

Only trigrams of at least ``MIN_SHARE`` of all are kept, and likewise pairs of letters, so a model has at most
``1 / MIN_SHARE`` of each however large the corpus is. All counts of pairs, contexts and letters are of all trigrams, and
every letter is kept: their number is bounded by Unicode. This is what is sent to the executors.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.mojibake import TOKEN, Detector, Lower, Model, ngrams
from codestrata.session import cut

#: Gain in log-likelihood that a chain needs. Validated on words that the model has not seen (tests/llm/test_encodings.py):
#: with one such word of five, 1.3 % of sound Latin and none of sound Cyrillic lines go beyond it (14 % and 1 % where no
#: word is known), and all garbled lines do.
MARGIN = 4.0
MIN_SHARE = 1e-6

_models: dict = {}


def trigram_counts(texts: DataFrame) -> DataFrame:
    """``gram, n`` over every token of every text; counted per batch first, so that little is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            tokens: Counter = Counter()
            for text in pdf["text"]:
                tokens.update(TOKEN.findall(text))
            for token, n in tokens.items():
                for gram in ngrams(token):
                    total[gram] += n
            if len(total) > 200_000:
                yield pd.DataFrame(total.items(), columns=["gram", "n"])
                total = Counter()
        if total:
            yield pd.DataFrame(total.items(), columns=["gram", "n"])

    return texts.select("text").mapInPandas(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> tuple[list[tuple[str, int]], Lower]:
    """The model of texts (``model_of`` their trigrams)."""
    return model_of(cut(trigram_counts(texts)))


def model_of(counts: DataFrame) -> tuple[list[tuple[str, int]], Lower]:
    """The model's trigrams, at most ``1 / MIN_SHARE`` of them, and the marginals of all."""
    least = (counts.agg(F.sum("n")).first()[0] or 0) * MIN_SHARE
    n, enough = F.sum("n").alias("n"), F.col("n") >= least

    def rows(df: DataFrame) -> list[tuple]:
        return [tuple(r) for r in df.collect()]

    pairs = counts.groupBy(F.substring("gram", 2, 2).alias("gram")).agg(n)
    contexts = counts.groupBy(F.substring("gram", 1, 2).alias("gram")).agg(n, F.count("*").alias("types"))
    firsts = pairs.groupBy(F.substring("gram", 1, 1).alias("gram")).agg(n, F.count("*").alias("types"))
    letters = counts.groupBy(F.substring("gram", 3, 1).alias("gram")).agg(n)
    return rows(counts.filter(enough)), Lower(rows(contexts.filter(enough)), rows(pairs.filter(enough)), rows(firsts), rows(letters))


def judge(texts: DataFrame, key: str, model: tuple[list[tuple[str, int]], Lower], margin: float = MARGIN, restore: bool = False) -> DataFrame:
    """``key, evidence, wrong, right, twice, lost, garbled[, restored]`` of every text with a non-ASCII character."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex  # what a reused worker knows the model by
    schema = f"`{key}` bigint, evidence double, wrong string, right string, twice boolean, lost boolean, garbled boolean"
    schema += ", restored string" if restore else ""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if mark not in _models:
            _models.clear()
            _models[mark] = Detector(Model(*shared.value), margin)
        detector = _models[mark]
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                v = detector.judge(text)
                garbled = v.evidence > margin or v.lost
                chain = v.chain if v.evidence > margin else None
                row = (k, v.evidence, chain and chain.wrong, chain and chain.right, chain and chain.twice, v.lost, garbled)
                out.append((*row, v.restored if garbled else None) if restore else row)
            columns = [key, "evidence", "wrong", "right", "twice", "lost", "garbled"] + ["restored"] * restore
            yield pd.DataFrame(out, columns=columns).astype({"twice": object})

    some = texts.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    return some.select(key, "text").mapInPandas(walk, schema)


def garbled(docs: DataFrame, key: str = "doc_id", margin: float = MARGIN, restore: bool = False) -> DataFrame:
    """The garbled records of ``docs`` (columns ``key`` and ``text``), with the likeliest chain.

    A record is garbled if some chain's evidence exceeds ``margin`` or if it holds replacement characters.
    Sequences cited alone in inline code or quotation marks do not count. ``restored`` is the text with the
    garbled parts put right, null where nothing could be recovered. Null and empty texts are sound; repeated
    records are judged each; texts are read whole.
    """
    texts = docs.select(key, "text").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    counts = cut(trigram_counts(texts))
    first = cut(judge(texts, key, model_of(counts), margin).filter("garbled").select(key).distinct())
    # The counts of the clean records are those of all without those of the garbled ones.
    wrong = trigram_counts(texts.join(first, key, "left_semi")).select("gram", (-F.col("n")).alias("n"))
    clean = cut(counts.unionByName(wrong).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 0"))
    return judge(texts, key, model_of(clean), margin, restore).filter("garbled").drop("garbled")
