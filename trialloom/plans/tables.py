"""Named parquet tables of a data folder, and small helpers shared by plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WRITTEN: list[tuple[SparkSession, str]] = []  # tables of this process, removed when it ends
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of its own only in local sessions that name none.

    The fallback is for tests and bench, where driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and spark.sparkContext.master.startswith("local"):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="trialloom-", dir=os.environ.get("TMPDIR")))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        named = _LOCAL[0]
    if named is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    if not _WRITTEN:
        atexit.register(_remove_written)
    path = f"{shared_folder(spark).rstrip('/')}/trialloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there, which cuts its lineage.

    Unlike a checkpoint, which computes the last stage twice, this runs the
    plan once; the table outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt_of(key: Column | str, salts: int) -> Column:
    """A stable salt in [0, salts) from the hash of ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def salted_rank(df: DataFrame, group: list[str], order: list[str], rank: str, salts: int = 64, weight: str | None = None) -> DataFrame:
    """Add a gap-free 0-based ``rank`` within ``group`` without one task per group.

    The order of ranks is (salt of ``order``, ``order``): a fixed shuffle of the
    group.  Rows are numbered inside (group, salt), and the counts of the salts
    give each its start, so a group that holds a third of all rows is spread
    over ``salts`` tasks.  ``order`` must identify a row within its group; rows
    alike in it get ranks in an unspecified order.  With ``weight``, the rank is
    the sum of that column over the rows before.
    """
    from pyspark.sql import Window as W

    s, n, at, local = f"__{rank}_salt", f"__{rank}_n", f"__{rank}_at", f"__{rank}_local"
    salted = df.withColumn(s, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    one = F.lit(1) if weight is None else F.col(weight)
    sizes = salted.groupBy(*group, s).agg(F.sum(one).alias(n))
    before = W.partitionBy(*group).orderBy(s).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, s, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(at))
    inner = W.partitionBy(*group, s).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    numbered = salted.withColumn(local, F.coalesce(F.sum(one).over(inner), F.lit(0)))
    # null-safe: a null group key is a group like any other
    a, b = numbered.alias("a"), starts.alias("b")
    on = F.lit(True)
    for c in (*group, s):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"b.{at}") + F.col(f"a.{local}")).cast("long").alias(rank))


CHUNK = 65_536


def running_total(df: DataFrame, order: str, value: Column | str, name: str, width: int = CHUNK, keys: list[str] | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, by the whole number ``order`` (null first), within ``keys`` if given.

    Rows are cut into chunks of ``width`` orders; only the chunks' totals meet
    in one place.  Rows of equal order follow one another in an unspecified way.
    """
    from pyspark.sql import Window as W

    keys = keys or []
    value = F.col(value) if isinstance(value, str) else value
    cut = df.withColumn("__chunk", F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62)))).withColumn("__value", value)
    totals = cut.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__chunk").alias("__c")).agg(F.sum("__value").alias("__t"))
    names = [f"__k{i}" for i in range(len(keys))]
    earlier = W.partitionBy(*names).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*names, "__c", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__from"))
    inner = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    on = F.col("__chunk") == F.col("__c")
    for c, k in zip(keys, names):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return local.join(before, on).select(*df.columns, (F.col("__from") + F.col("__local")).cast("long").alias(name))
