"""A result cache as a table: entries are valid by age and by the hashes of the files they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds after which an entry is too old.
TTL_SECONDS = 24 * 3600


def state_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, state``: one hash of all files of a key, whatever their order.

    The hashes of the files are summed as numbers instead of being listed, so that no task holds a whole key.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "path", F.sha2(F.coalesce("content", F.lit("")), 256)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return files.groupBy(*keys).agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(one).cast("string")).alias("state"))


def cache_key(*parts: Column) -> Column:
    """32 hexadecimal digits of what an entry is for."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def lookup(wanted: DataFrame, entries: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """``wanted`` (``key, state``) with the value of the newest entry of its key that is valid: of the same state and not older than ``ttl``.

    ``outcome`` is hit, expired (the newest entry of that state is too old), changed (entries of other states only) or miss.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    per = entries.groupBy("key", "state").agg(F.max_by("value", "created_at").alias("value"), F.min(age).alias("age"))
    any_ = per.select("key").distinct().withColumn("known", F.lit(True))
    j = wanted.join(per, ["key", "state"], "left").join(any_, "key", "left")
    outcome = F.when(F.col("age") <= ttl, "hit").when(F.col("age").isNotNull(), "expired").when(F.col("known"), "changed").otherwise("miss")
    return j.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "hit", F.col("value"))).drop("age", "known")


def invalidate(entries: DataFrame, stale: DataFrame) -> DataFrame:
    """The entries without those of the ``key`` rows in ``stale``."""
    return entries.join(stale.select("key").distinct(), "key", "left_anti")


def stats(entries: DataFrame) -> DataFrame:
    """One row: entries, keys, characters of values, and the first and last time of creation."""
    return entries.agg(
        F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")
    )
