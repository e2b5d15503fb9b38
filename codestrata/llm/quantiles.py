"""Problem 5: exact and bounded-error percentiles of very large numeric columns by radix selection.

A floating value is mapped to an integer of the same order: its bits, with all but the sign inverted for
negative numbers. Selection then works on digits. One pass counts, per group, the values of each leading
digit; the digit that contains a target rank is known from the running counts, and the next pass counts only
values that begin with it. Four digits of 16 bits give the exact value; a target whose digit holds one value only, or
that is the first or last of it, is known at once, and passes end when all are. Coarser groups need no pass of their own: their counts are sums of those
of the finest ones. Every pass aggregates on the map side, so what is shuffled per task is at most the number of
distinct (group, digit) pairs it saw.

The counts of leading digits alone are a sketch: of a value only the leading ``SKETCH_BITS`` are kept, counts
of partitions or days add up, and the percentile's error is bounded by half the width of a digit, relative
``2 ** -(mantissa bits + 1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import broadcast_if_small, cut

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
DIGIT_BITS = 16
#: 1 sign bit, 11 exponent bits and 10 bits of the mantissa.
SKETCH_BITS = 22
#: Largest relative distance of a sketch's percentile from the exact one.
SKETCH_ERROR = 2.0 ** -(SKETCH_BITS - 12 + 1)
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """float64 to int64 in the same order; -0.0 is 0.0."""
    bits = (np.ascontiguousarray(x, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def from_ordered(bits: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(bits, dtype=np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits).view(np.float64)


def _valid_keys(arrays: pd.Series) -> pd.Series:
    """Ordered integers of the valid entries: present, no NaN, finite, not negative."""
    given = [np.asarray([] if a is None else a, dtype=np.float64) for a in arrays]
    sizes = np.array([len(a) for a in given])
    flat = np.concatenate(given) if len(given) else np.empty(0)
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(flat) & (flat >= 0)
    keys = ordered_bits(flat)
    ends = np.cumsum(sizes)
    return pd.Series([keys[e - n : e][ok[e - n : e]] for e, n in zip(ends, sizes, strict=True)], dtype=object)


def _doubles(keys: pd.Series) -> pd.Series:
    return pd.Series(from_ordered(keys.fillna(0).to_numpy(np.int64))).where(keys.notna().to_numpy())


def _to_double(keys: Column | str) -> Column:
    return F.pandas_udf(_doubles, T.DoubleType())(keys)


def run_values(runs: DataFrame) -> DataFrame:
    """``repo_name, day, key`` of every valid entry of times_ms, each run counted once.

    Of several deliveries of a run_id the one of the latest loaded_at counts (then the longest times_ms);
    rows without run_id are runs of their own. Null and empty arrays give nothing.
    """
    base = runs.select("run_id", "repo_name", F.to_date("started_at").alias("day"), "times_ms", "loaded_at")
    # Only runs that came more than once are sorted out by their arrival; the others stay where they are.
    twice = cut(base.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n")).filter("n > 1").select("run_id"))
    twice = broadcast_if_small(twice)
    latest = F.struct(F.col("loaded_at"), F.coalesce(F.size("times_ms"), F.lit(-1)).alias("n"))
    again = base.join(twice, "run_id", "left_semi").groupBy("run_id").agg(F.max_by(F.struct("repo_name", "day", "times_ms"), latest).alias("r")).select("r.*")
    # Rows without run_id match no row of ``twice`` and are kept.
    rows = again.unionByName(base.join(twice, "run_id", "left_anti").select("repo_name", "day", "times_ms"))
    return rows.select("repo_name", "day", F.explode(F.pandas_udf(_valid_keys, T.ArrayType(T.LongType()))("times_ms")).alias("key"))


def _all(conds: list):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _same(columns: Sequence[str], mark: str) -> Column:
    """Null-safe equality of columns with their marked copies."""
    return _all([F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in columns])


def _marked(df: DataFrame, columns: Sequence[str], mark: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{mark}{c}" for c in columns})


def _ranks(hist: DataFrame, place: Sequence[str], wanted: Column | list[tuple[Column, Column]]) -> DataFrame:
    """For every target the digit that contains its rank: the rank within it, and the least and greatest key there.

    ``wanted`` is an array of targets (``q, rank, total``) or, where all groups have the same ones, pairs of name and rank.
    """
    w = Window.partitionBy(*place).orderBy("digit")
    upto, total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    h = hist.withColumn("upto", upto).withColumn("all", total)

    def inside(rank: Column) -> Column:
        return (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))

    if isinstance(wanted, list):
        h = h.filter(_any([inside(rank) for _, rank in wanted]))
        hit = F.array_compact(F.array(*[F.when(inside(rank), F.struct(q.alias("q"), rank.alias("rank"), F.col("all").alias("total"))) for q, rank in wanted]))
    else:
        hit = F.filter(wanted, lambda t: inside(t["rank"]))
    h = h.withColumn("t", F.explode(hit))
    prefix = F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit"))
    rank = F.col("t.rank") - F.col("upto") + F.col("n")
    # The first rank of a digit is its least key, the last one its greatest.
    first, last = rank == 1, rank == F.col("n")
    low, high = F.when(~first & last, F.col("hi")).otherwise(F.col("lo")), F.when(first, F.col("lo")).otherwise(F.col("hi"))
    return h.select(*place[:-1], prefix.alias("prefix"), F.col("t.q").alias("q"), F.col("t.total").alias("total"), rank.alias("rank"), low.alias("lo"), high.alias("hi"))


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def radix_select(keys: DataFrame, groups: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles per group: the value at rank ``ceil(q * n)`` (nearest rank), one column per quantile.

    ``keys`` has the group columns and the integer ``key``. Null group values form a group; groups without
    values have no row; ties are counted, repeated rows count each.
    """
    return radix_levels(keys, [groups], quantiles).drop("level")


def radix_levels(keys: DataFrame, levels: Sequence[Sequence[str]], quantiles: dict[str, float] | None = None) -> DataFrame:
    """``radix_select`` for several groupings in the same passes; ``level`` is the place in ``levels``.

    The first level is the finest; the others are parts of it, and columns they leave out are null.
    """
    quantiles = quantiles or QUANTILES
    finest = list(levels[0])
    shared = [g for g in finest if all(g in level for level in levels)]
    place = ["level", *finest, "prefix"]

    def histogram(rows: DataFrame, prefix: Column, digit: Column) -> DataFrame:
        h = rows.groupBy(*finest, prefix.alias("prefix"), digit.alias("digit")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        h = cut(h) if len(levels) > 1 else h
        out = None
        for n, level in enumerate(levels):
            part = h if n == 0 else h.groupBy(*level, "prefix", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            given = [F.col(g) if g in level else F.lit(None).cast(keys.schema[g].dataType).alias(g) for g in finest]
            part = part.select(F.lit(n).alias("level"), *given, "prefix", "digit", "n", "lo", "hi")
            out = part if out is None else out.unionByName(part)
        return out

    first = histogram(keys, F.lit(0).cast("bigint"), F.shiftright("key", 64 - DIGIT_BITS))
    wanted = [(F.lit(q), F.greatest(F.ceil(F.col("all") * F.lit(p)), F.lit(1))) for q, p in quantiles.items()]
    targets = known = cut(_ranks(first, place, wanted))
    for done in (DIGIT_BITS, 2 * DIGIT_BITS, 3 * DIGIT_BITS):
        left = targets.filter("lo < hi")
        count = left.count()
        if not count:
            break
        size = count * (96 + 32 * len(finest))
        p = broadcast_if_small(_marked(left.select(*shared, "prefix").distinct(), [*shared, "prefix"], "_p_"), size)
        prefix = F.shiftright("key", 64 - done)
        cond = F.col("_p_prefix") == prefix
        some = keys.join(p, cond & _same(shared, "_p_") if shared else cond, "left_semi")
        hist = histogram(some, prefix, F.shiftright("key", 64 - done - DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)))
        t = left.groupBy(*place).agg(F.collect_list(F.struct("q", "rank", "total")).alias("wanted"))  # one for each quantile
        hist = hist.join(broadcast_if_small(_marked(t, place, "_t_"), size), _same(place, "_t_"))
        targets = cut(_ranks(hist, place, F.col("wanted")))
        known = known.filter("lo = hi").unionByName(targets)
    named = known.withColumn("value", _to_double("lo"))
    return named.groupBy("level", *finest).agg(
        F.max("total").alias("n"), *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(q) for q in quantiles]
    )


def sketch(keys: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``groups, bucket, n``: counts of the leading SKETCH_BITS, to be added up over any groups."""
    return keys.groupBy(*groups, F.shiftright("key", 64 - SKETCH_BITS).alias("bucket")).agg(F.count("*").alias("n"))


def from_sketch(sketches: DataFrame, groups: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Percentiles of the combined sketches, each with its bounds.

    ``<q>`` is the middle of the digit that holds the rank, ``<q>_low`` and ``<q>_high`` its ends; the exact
    value lies between them, so the relative error is at most SKETCH_ERROR for normal numbers.
    """
    quantiles = quantiles or QUANTILES
    total = sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*groups).orderBy("bucket")
    h = total.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*groups)))
    aggs = [F.max("all").alias("n")]
    for q, p in quantiles.items():
        rank = F.greatest(F.ceil(F.col("all") * F.lit(p)), F.lit(1))
        aggs.append(F.max(F.when((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto")), F.col("bucket"))).alias(q))
    out = h.groupBy(*groups).agg(*aggs)
    shift = 64 - SKETCH_BITS
    for q in quantiles:
        low, high = _to_double(F.shiftleft(q, shift)), _to_double(F.shiftleft(q, shift).bitwiseOR(F.lit((1 << shift) - 1)))
        out = out.withColumn(f"{q}_low", low).withColumn(f"{q}_high", high).withColumn(q, (F.col(f"{q}_low") + F.col(f"{q}_high")) / 2)
    return out.withColumn("max_rel_error", F.lit(SKETCH_ERROR))
