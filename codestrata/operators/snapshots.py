"""What changed between consecutive full snapshots.

Every row takes part in up to two comparisons: as the *after* side of its own snapshot and as the *before*
side of the next one. Both sides are unioned, tagged and grouped by key once; a side is represented by the
hash of its compared values, so that one aggregation with map-side combining is the only shuffle of the
data, whatever the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import broadcast_if_small, cut

#: Arrival time in microseconds and the tie-break in one number: unlike a struct it lets Spark aggregate by hash.
_ORDER = "decimal(38,0)"


def norm_text(c: Column | str) -> Column:
    """Text without regard to case and outer white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def norm_path(c: Column | str) -> Column:
    """Paths with ``/``, without leading ``./``; null is ''."""
    p = F.regexp_replace(F.translate(c, "\\", "/"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.regexp_replace(p, r"^(?:\./+)+", ""), F.lit(""))


def norm_number(c: Column | str) -> Column:
    """Numbers to one decimal; NaN counts as missing, -0.0 as 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, 1) + F.lit(0.0))


def state_hash(*cols: Column) -> Column:
    """One 64-bit hash of the compared values; null differs from every value and from ''."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def calendars(presence: Sequence[DataFrame], owner: str, snapshot: str) -> DataFrame:
    """``owner -> sorted array of its snapshots`` over all given tables, cut from their lineage."""
    seen = None
    for df in presence:
        d = df.select(owner, snapshot).filter(F.col(owner).isNotNull() & F.col(snapshot).isNotNull())
        seen = d if seen is None else seen.unionByName(d)
    return cut(seen.groupBy(owner).agg(F.sort_array(F.collect_set(snapshot)).alias("calendar")))


def snapshot_diff(
    tables: Sequence[DataFrame],
    keys: Sequence[str],
    *,
    owner: str,
    snapshot: str,
    state: str,
    arrived: str,
    tiebreak: str,
    presence: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """Keys added, removed or changed between each owner's consecutive snapshots.

    ``tables`` are frames of one shape with the ``keys`` (``owner`` among them), ``snapshot``, the
    ``state`` hash, the arrival time ``arrived`` and a unique number ``tiebreak``. Of several rows of one
    key in one snapshot the latest ``arrived`` counts; among equal times the largest ``tiebreak``; a null
    time is the earliest. ``presence`` are the tables that say which snapshots an owner has (default: the
    tables themselves). Rows without owner or snapshot belong to no snapshot and give nothing; an owner's
    first snapshot gives nothing; repeated rows count once; null keys are equal to each other.

    Result: the keys, ``snapshot`` (the later one) and ``change_type``.

    The owner calendars are broadcast only if their measured size is small; else they are joined by a
    shuffle in which AQE splits a hot owner.
    """
    cal = calendars(presence or tables, owner, snapshot)
    size = cal.agg(F.sum(F.length(owner) + 24 + 8 * F.size("calendar"))).first()[0] or 0
    rows = None
    for t in tables:
        t = t.select(*keys, snapshot, state, arrived, tiebreak)
        rows = t if rows is None else rows.unionByName(t)
    at = F.array_position("calendar", F.col(snapshot))
    order = F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit(-(2**60))).cast("decimal(19,0)") * F.expr(
        "10000000000000000000BD"
    ) + F.coalesce(F.col(tiebreak), F.lit(-(2**62))).cast("decimal(19,0)")
    sides = F.array(
        F.when(at > 1, F.struct(F.col(snapshot).alias("s"), F.lit(True).alias("after"))),
        F.when(at < F.size("calendar"), F.struct(F.get("calendar", at.cast("int")).alias("s"), F.lit(False).alias("after"))),
    )
    tagged = (
        rows.join(broadcast_if_small(cal, int(size)), owner)
        .withColumn("_order", order.cast(_ORDER))
        .withColumn("_side", F.explode(F.filter(sides, lambda x: x.isNotNull())))
        .select(*keys, F.col("_side.s").alias(snapshot), F.col("_side.after").alias("_after"), state, "_order")
    )
    sided = tagged.groupBy(*keys, snapshot).agg(
        F.max_by(F.when(F.col("_after"), F.col(state)), F.when(F.col("_after"), F.col("_order"))).alias("_new"),
        F.max_by(F.when(~F.col("_after"), F.col(state)), F.when(~F.col("_after"), F.col("_order"))).alias("_old"),
    )
    return (
        sided.filter(~F.col("_new").eqNullSafe(F.col("_old")))
        .withColumn(
            "change_type",
            F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("removed")).otherwise(F.lit("changed")),
        )
        .drop("_new", "_old")
    )
