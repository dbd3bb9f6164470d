"""Covered periods of intervals and the gaps between them, by a sweep line.

Every interval becomes a plus event at its begin and a minus event at its end.
Events of one position are added up before the shuffle; the running sum of
the rest is the number of open intervals.  The events are cut by rank into
buckets of about equally many, whatever their positions; the totals of an
entity's buckets give each the number of intervals open at its left border, so
no entity has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise

EVENTS_PER_BUCKET = 50_000


def cover_and_gaps(intervals: DataFrame, keys: list[str], lo: str, hi: str, per_bucket: int = EVENTS_PER_BUCKET) -> DataFrame:
    """Maximal covered periods of each entity, and the gaps between consecutive ones.

    ``intervals`` has the entity's ``keys`` and the half-open interval
    [``lo``, ``hi``) of whole numbers.  Intervals with a null end, or with
    hi <= lo, are ignored; touching intervals join; repeated rows change
    nothing.  Null keys form an entity of their own.  Result: the keys, kind
    (``period`` or ``gap``), lo, hi.  Before the first and after the last
    period there is no gap; an empty table gives an empty result.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    valid = intervals.where(F.col(hi) > F.col(lo)).select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(lo).cast("long").alias("__lo"), F.col(hi).cast("long").alias("__hi"))
    events = (
        valid.select(*k, F.explode(F.array(F.struct(F.col("__lo").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("__hi").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*k, "e.pos")
        .agg(F.sum("e.d").alias("d"))
        .where("d <> 0")
    )
    events = materialise(events)
    # a bucket is a range of (entity, position), its borders quantiles of a sample
    placed = materialise(events.repartitionByRange(max(1, -(-events.count() // per_bucket)), *k, "pos").select(*k, "pos", "d", F.spark_partition_id().alias("b")))

    totals = placed.groupBy(*k, "b").agg(F.sum("d").alias("t"))
    left_of = W.partitionBy(*k).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*k, "b", F.coalesce(F.sum("t").over(left_of), F.lit(0)).alias("open"))
    within = W.partitionBy(*k, "b").orderBy("pos")
    counted = _join(placed, carry, [*k, "b"]).select(*k, "b", "pos", "d", (F.col("open") + F.sum("d").over(within)).alias("after"))
    borders = materialise(counted.where("after = 0 OR after = d").select(*k, "b", "pos", (F.col("after") > 0).alias("opens")))

    heads = borders.groupBy(*k, "b").agg(F.min("pos").alias("head"))
    following = heads.select(*k, "b", F.lead("head").over(W.partitionBy(*k).orderBy("b")).alias("beyond"))
    paired = _join(borders, following, [*k, "b"]).select(
        *[F.col(a).alias(c) for a, c in zip(k, keys)], F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("pos").alias("lo"),
        F.coalesce(F.lead("pos").over(within), F.col("beyond")).alias("hi"),
    )
    return paired.where("hi IS NOT NULL")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join that also matches null keys."""
    a, b = left.alias("a"), right.alias("b")
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond).select("a.*", *[F.col(f"b.{c}") for c in right.columns if c not in on])
