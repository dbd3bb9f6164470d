"""Queries p1, p3 and p5 over the driver's tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.operators.drift import canonical_fields, field_changes, file_statistics, one_field, path_types, typed_table
from trialloom.operators.intervals import cover_and_gaps
from trialloom.operators.spikes import suspect_readings
from trialloom.plans.tables import materialise, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = suspect_readings(table(spark, sf, "analog_long"), table(spark, sf, "recording"), table(spark, sf, "label"))
    return found.select("recording_id", "channel_id", F.col("sample").cast("int"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    trials = table(spark, sf, "trial").select(F.lit("trial").alias("origin"), "recording_id", F.lit("").alias("store"), F.col("start").alias("lo"), F.col("stop").alias("hi"))
    length = table(spark, sf, "recording").select(F.col("recording_id").alias("rid"), "duration")
    ranges = table(spark, sf, "time_range").select("recording_id", "store", "t1", "t2")
    ranges = ranges.join(length, ranges.recording_id == length.rid, "left")
    until = F.when(F.col("t2") == float("inf"), F.col("duration")).otherwise(F.col("t2"))

    def ms(c):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(finite, F.round(c * 1000)).cast("long")  # what no long can hold is an error, not a missing end

    ranges = ranges.select(F.lit("time_range").alias("origin"), "recording_id", "store", ms(F.col("t1")).alias("lo"), ms(until).alias("hi"))
    return cover_and_gaps(trials.unionByName(ranges), ["origin", "recording_id", "store"], "lo", "hi")


def _extension():
    return F.regexp_extract("filename", r"\.([^.]*)$", 1)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = field_changes(table(spark, sf, "raw_info"), "file_id", [F.col("rig"), _extension()], "written_at", "payload")
    return changes.withColumnRenamed("key", "file_id")


def _p5_typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    info, series = table(spark, sf, "raw_info"), [F.col("rig"), _extension()]
    files = materialise(file_statistics(info, "file_id", series, "written_at", "payload"))
    links = one_field(field_changes(info, "file_id", series, "written_at", "payload"), files)
    return typed_table(files, canonical_fields(links, path_types(files)))


def p5_table(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf)[0].withColumnRenamed("key", "file_id")


def p5_failed_casts(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf)[1].withColumnRenamed("key", "file_id")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p5_table": p5_table, "p5_failed_casts": p5_failed_casts}

P3_SQL = """
WITH iv AS (
  SELECT 'trial' AS origin, recording_id, '' AS store, CAST(start AS BIGINT) AS lo, CAST(stop AS BIGINT) AS hi FROM trial
  UNION ALL
  SELECT 'time_range', t.recording_id, t.store, CAST(round(t.t1 * 1000) AS BIGINT),
         CAST(round(CASE WHEN isinf(t.t2) THEN r.duration ELSE t.t2 END * 1000) AS BIGINT)
  FROM time_range t LEFT JOIN recording r ON r.recording_id = t.recording_id
), ok AS (SELECT * FROM iv WHERE hi > lo),
marked AS (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY origin, recording_id, store ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ok
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY origin, recording_id, store ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked
), period AS (
  SELECT origin, recording_id, store, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY origin, recording_id, store, island
)
SELECT origin, recording_id, store, 'period' AS kind, lo, hi FROM period
UNION ALL
SELECT origin, recording_id, store, 'gap', lo, hi FROM (
  SELECT origin, recording_id, store, hi AS lo, lead(lo) OVER (PARTITION BY origin, recording_id, store ORDER BY lo) AS hi FROM period
) WHERE hi IS NOT NULL
"""

SQL = {"p3_found": P3_SQL}
