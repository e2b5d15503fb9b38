"""Problem 8: a mix of sources to target shares by Sainte-Laguë apportionment of equal-token blocks.

The mix has as many blocks as fit while every source can deliver its share within its cap of repeats. Blocks
are apportioned to sources by highest quotients (Sainte-Laguë), then each source's blocks to its shards in the
same way, so that every shard has an integer quota and fills it on its own: it puts its documents one behind the
other in a seeded order, cuts them into blocks of equal size, takes all of them as often as the quota allows, and
for the rest the first blocks of another seeded order, the last one in part. A document of any length gives its
blocks like any other, so a quota is met to the token. Shards are hash parts of a source with a bounded number of
tokens, however large the source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import broadcast_if_small, cut

#: Place of the public tokenizer's rank file on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# ---- Fixed value: how that public byte-level BPE splits text before merging ----
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --------------------------------------------------------------------------------
BLOCK_TOKENS = 256
SHARD_TOKENS = 2_000_000
MAX_SHARDS = 200_000
#: Texts are tokenized in pieces of this many characters, cut at white space; merges never cross it by much.
PIECE = 200_000

_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        at = max(text.rfind(" ", PIECE // 2, PIECE), text.rfind("\n", PIECE // 2, PIECE))
        at = at if at > 0 else PIECE
        yield text[:at]
        text = text[at:]
    yield text


def count_tokens(docs: DataFrame, key: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, source, n_tokens`` of every document with a source and a text."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for pdf in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) for t in pdf["text"]]
            yield pd.DataFrame({key: pdf[key], source: pdf[source], "n_tokens": n})

    some = docs.select(key, source, "text").filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col(source).isNotNull())
    return some.mapInPandas(walk, f"`{key}` bigint, `{source}` string, n_tokens bigint")


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients ``w / (2k + 1)``; a party at its cap gets no more, the others go on.

    Ties go to the earlier party. The allocation starts from a divisor that gives at most ``seats`` seats, so
    that the number of steps depends on the number of parties and not on the seats.
    """
    n = len(weights)
    caps = caps or [seats] * n
    caps = [c if w > 0 else 0 for c, w in zip(caps, weights, strict=True)]
    seats = min(seats, sum(caps))
    if seats <= 0:
        return [0] * n

    def given(divisor: float) -> list[int]:
        return [min(c, int(w / divisor + 0.5)) for w, c in zip(weights, caps, strict=True)]

    low, high = 0.0, 2.0 * max(weights) + 1.0  # high gives none
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        if sum(given(mid)) > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    # Undo a seat each, so that ties at the divisor are settled by quotient and order below.
    out = [max(0, s - 1) for s in out]
    heap = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(weights, out, strict=True)) if s < caps[i]]
    heapq.heapify(heap)
    left = seats - sum(out)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        left -= 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


@dataclass
class Quotas:
    blocks: dict[str, int]
    """Blocks per source."""
    total: int
    """Blocks of the mix."""


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], block: int = BLOCK_TOKENS, total_tokens: int | None = None) -> Quotas:
    """Blocks per source for ``targets`` (source -> share, cap of repeats).

    The mix is as large as the scarcest source allows (or ``total_tokens``, if less). A source without any
    text cannot have a share: the others share the mix in proportion, and the report shows it with 0.
    """
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and available.get(s, 0) > 0}
    norm = sum(share for share, _ in live.values())
    if not live:
        return Quotas({}, 0)
    room = min(available[s] * cap * norm / share for s, (share, cap) in live.items())
    seats = int(min(room, total_tokens if total_tokens is not None else room) // block)
    names = sorted(live)
    caps = [available[s] * live[s][1] // block for s in names]
    got = sainte_lague([live[s][0] for s in names], seats, caps)
    return Quotas(dict(zip(names, got, strict=True)), sum(got))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    seed: int = 17,
    block: int = BLOCK_TOKENS,
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``key, source, from_token, n_tokens, repeats``: ``n_tokens`` tokens of a document from ``from_token`` on,
    ``repeats`` times. Whole documents have a row with the number of full passes, and each block of the rest that
    they are part of another; no token is taken more often than its source's cap. Report: one row per target with the
    shares reached.

    Documents without text, source or a target for their source are not part of any mix; copies under other
    keys count each; the same seed gives the same mix whatever the partitioning. A source of less than a block in
    all its repeats gives nothing.
    """
    spark = docs.sparkSession
    goal = {r[0]: (float(r[1] or 0.0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None}
    sized = cut(count_tokens(docs.filter(F.col(source).isin(list(goal))), key, source, tokenizer))
    order = F.xxhash64(F.lit(seed), F.col(key))
    totals = {r[0]: r[1] for r in sized.groupBy(source).agg(F.sum("n_tokens")).collect()}
    per_shard = max(SHARD_TOKENS, sum(totals.values()) // MAX_SHARDS + 1)
    shards = {s: int(t // per_shard) + 1 for s, t in totals.items()}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col(source)) if shards else F.lit(1)
    placed = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), count.cast("bigint")))
    sizes = placed.groupBy(source, "shard").agg(F.sum("n_tokens").alias("t")).collect()
    quotas = plan(totals, goal, block, total_tokens)
    rows = []
    for s, blocks in quotas.blocks.items():
        mine = sorted((r["shard"], r["t"]) for r in sizes if r[source] == s)
        cap = goal[s][1]
        got = sainte_lague([t for _, t in mine], blocks, [t * cap // block for _, t in mine])
        # What the shards' caps leave over by rounding goes to those that have room for a part of a block.
        left, wanted = blocks * block - sum(got) * block, []
        for (shard, t), q in zip(mine, got, strict=True):
            more = min(left, t * cap - q * block)
            left -= more
            wanted.append((s, shard, q * block + more, t, cap))
        rows += [r for r in wanted if r[2]]
    quota = spark.createDataFrame(rows, f"`{source}` string, shard bigint, wanted bigint, shard_tokens bigint, cap int")
    quota = quota.withColumn("passes", F.floor(F.col("wanted") / F.col("shard_tokens"))).withColumn("rest", F.col("wanted") - F.col("passes") * F.col("shard_tokens"))
    small = broadcast_if_small(quota, len(rows) * 96)
    w = Window.partitionBy(source, "shard").orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(small, [source, "shard"]).withColumn("upto", F.sum("n_tokens").over(w)).withColumn("at", F.col("upto") - F.col("n_tokens"))
    whole = run.filter("passes > 0").select(key, source, F.lit(0).cast("bigint").alias("from_token"), "n_tokens", F.col("passes").cast("int").alias("repeats"), F.lit(0).alias("part"))
    # The blocks of the rest, in seeded order up to it.
    grid = quota.filter("rest > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("shard_tokens") - 1) / block))))
    grid = grid.withColumn("size", F.least(F.lit(block), F.col("shard_tokens") - F.col("block") * block))
    seeded = Window.partitionBy(source, "shard").orderBy(F.xxhash64(F.lit(seed + 2), source, "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    chosen = grid.withColumn("take", F.least("size", F.col("rest") - F.sum("size").over(seeded) + F.col("size"))).filter("take > 0").select(source, "shard", "block", "take")
    pieces = run.filter("rest > 0 AND n_tokens > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("upto") - 1) / block))))
    low = F.greatest("at", F.col("block") * block)
    taken = F.least("upto", F.col("block") * block + F.col("take")) - low
    parts = pieces.join(chosen, [source, "shard", "block"]).select(key, source, (low - F.col("at")).alias("from_token"), taken.alias("n_tokens"), F.lit(1).alias("repeats"), F.lit(1).alias("part"))
    mixed = cut(whole.unionByName(parts.filter("n_tokens > 0")))
    each = mixed.groupBy(source, key).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), (F.sum(F.when(F.col("part") == 0, F.col("repeats")).otherwise(0)) + F.max("part")).alias("r"))
    got = {r[0]: (r[1], r[2], r[3]) for r in each.groupBy(source).agg(F.sum("t"), F.count("*"), F.max("r")).collect()}
    mixed = mixed.drop("part")
    size = sum(t for t, _, _ in got.values())
    report = [
        (s, share, cap, totals.get(s, 0), quotas.blocks.get(s, 0), got.get(s, (0, 0, 0))[0], got.get(s, (0, 0, 0))[1], got.get(s, (0, 0, 0))[2],
         got.get(s, (0, 0, 0))[0] / size if size else 0.0)
        for s, (share, cap) in sorted(goal.items())
    ]
    schema = (
        "source string, target_share double, max_repeats int, available_tokens bigint, blocks bigint, mixed_tokens bigint, "
        "documents bigint, most_repeats int, reached_share double"
    )
    return mixed, spark.createDataFrame(report, schema)
