"""Records of two tables paired by nearest time within a tolerance.

Times are put into buckets as wide as the tolerance; a record on the right
goes to its own and both adjacent buckets, so that the rows of one entity and
bucket hold all that can match.  The two sides of a bucket are not joined pair
by pair, as a bucket may hold a third of all rows: they are merged in order of
time, and each left time meets only its two neighbours, the nearest on either
side, of which the nearer within the tolerance stays.  (That is the join on
entity and bucket, filtered by difference and cut to its minimum, without its
pairs.)  Records of one entity and time are one before that: a group of copies
is a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _bucket(time, tolerance: float):
    """Whole number of tolerances, as a double: beyond 2^52 every double is whole, and no long would hold it."""
    x = time / tolerance
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(left_id, right_id, distance): for each record on the left the nearest on the right, or nulls.

    Both tables have id, entity and time (seconds, double).  Records of a null
    entity, or of a time that is null, NaN or infinite, are left out; so are
    null ids.  A repeated id counts once on either side, with its smallest
    entity and the earliest time there.  The limit belongs to the tolerance.
    Of two equally near records the earlier wins, of two at one time the one
    with the smaller id.  One record may serve several on the left.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance must be positive")

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("id").alias("id"), F.col("entity").alias("entity"), F.col("time").cast("double").alias("time"))
        rows = rows.where(F.col("id").isNotNull() & F.col("entity").isNotNull() & _finite(F.col("time")))
        return rows.groupBy("id").agg(F.min(F.struct("entity", "time")).alias("r")).select("id", "r.entity", "r.time")

    marks = clean(left)
    bucket = _bucket(F.col("time"), tolerance)
    asked = marks.groupBy("entity", "time").agg(F.lit(None).cast(dict(right.dtypes)["id"]).alias("hit")).select("entity", "time", "hit", bucket.alias("bucket"))
    times = clean(right).groupBy("entity", "time").agg(F.min("id").alias("hit"))
    near = times.select("entity", "time", "hit", F.explode(F.array_distinct(F.array(bucket - 1, bucket, bucket + 1))).alias("bucket"))

    at = F.when(F.col("hit").isNotNull(), F.struct("time", "hit"))
    upto = W.partitionBy("entity", "bucket").rangeBetween(W.unboundedPreceding, W.currentRow)
    before = F.last(at, ignorenulls=True).over(upto.orderBy("time"))
    after = F.last(at, ignorenulls=True).over(upto.orderBy(F.desc("time")))
    both = asked.unionByName(near).select("entity", "time", "hit", before.alias("b"), after.alias("a")).where("hit IS NULL")
    db, da = F.col("time") - F.col("b.time"), F.col("a.time") - F.col("time")
    back = F.col("b").isNotNull() & (F.col("a").isNull() | (db <= da))
    best = both.select("entity", "time", F.when(back, F.col("b.hit")).otherwise(F.col("a.hit")).alias("right_id"), F.when(back, db).otherwise(da).alias("distance"))
    best = best.where(F.col("distance") <= tolerance)
    m, n = marks.alias("m"), best.alias("n")
    return m.join(n, (F.col("m.entity") == F.col("n.entity")) & (F.col("m.time") == F.col("n.time")), "left").select(F.col("m.id").alias("left_id"), F.col("n.right_id"), F.col("n.distance"))
