"""Queries of the problems tagged llm over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.language import label_documents, mislabelled
from trialloom.llm.mixing import mix, shares
from trialloom.llm.nearest import nearest_in_time
from trialloom.llm.packing import fill, pack
from trialloom.llm.percentiles import combine, counted_ranks, merged, multi_select_scopes, summaries, value_blocks
from trialloom.llm.tokens import with_tokens
from trialloom.plans.tables import materialise, table


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mislabelled(label_documents(table(spark, sf, "documents")))


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    return label_documents(table(spark, sf, "documents"))


TOLERANCE_S = 0.040


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "trigger_mark").select(F.col("trig_id").alias("id"), F.col("recording_id").alias("entity"), F.col("trigger_timestamp").alias("time"))
    onsets = table(spark, sf, "pdio").select(F.col("pdio_id").alias("id"), F.col("recording_id").alias("entity"), F.col("pdio_onset").alias("time"))
    return nearest_in_time(marks, onsets, TOLERANCE_S).where("right_id IS NOT NULL").select(F.col("left_id").alias("trig_id"), F.col("right_id").alias("pdio_id"))


P2_SQL = """
WITH m AS (SELECT DISTINCT trig_id, recording_id, trigger_timestamp AS t FROM trigger_mark WHERE trigger_timestamp IS NOT NULL AND NOT isnan(trigger_timestamp) AND NOT isinf(trigger_timestamp)),
o AS (SELECT DISTINCT pdio_id, recording_id, pdio_onset AS t FROM pdio WHERE pdio_onset IS NOT NULL AND NOT isnan(pdio_onset) AND NOT isinf(pdio_onset)),
pair AS (
  SELECT m.trig_id, o.pdio_id, row_number() OVER (PARTITION BY m.trig_id ORDER BY abs(m.t - o.t), o.t, o.pdio_id) AS place
  FROM m JOIN o ON m.recording_id = o.recording_id AND abs(m.t - o.t) <= 0.040
)
SELECT trig_id, pdio_id FROM pair WHERE place = 1
"""



SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return value_blocks(table(spark, sf, "analog_long"), table(spark, sf, "recording"))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of each channel, over everything and per day; the rank error is 0."""
    blocks = _blocks(spark, sf).persist()
    out = multi_select_scopes(blocks, [["channel_id"], ["day", "channel_id"]], SHARES)
    blocks.unpersist()
    day = F.coalesce(F.date_from_unix_date("day").cast("string"), F.lit("unknown"))
    whole = F.col("scope") == 0
    return out.select(F.when(whole, "all").otherwise("day").alias("scope"), F.when(whole, "").otherwise(day).alias("day"), "channel_id", "q", "n", "value")


def p4_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each channel from the summaries of its days, with the bound of the rank error."""
    days = merged(summaries(_blocks(spark, sf)), ["day", "channel_id"])
    return combine(days, ["channel_id"], SHARES)


def p4_combined_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the combined percentiles keep their bound, by counting, and whether the bound is at most 1/64."""
    blocks = _blocks(spark, sf).persist()
    found = materialise(counted_ranks(blocks, ["channel_id"], combine(merged(summaries(blocks), ["day", "channel_id"]), ["channel_id"], SHARES)))
    blocks.unpersist()
    target, slack = F.floor(F.col("q") * (F.col("n") - 1)), F.col("rank_error") * F.col("n")
    kept = (F.col("below") - slack <= target) & (target <= F.col("upto") - 1 + slack)
    return found.select("channel_id", "q", "n", kept.alias("kept"), (F.col("rank_error") <= 1 / 64).alias("small"))


P4_RANKS_SQL = """
WITH d AS (SELECT recording_id, channel_id, sample, max(value) AS value FROM analog_long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
n AS (SELECT channel_id, count(*) AS n FROM d GROUP BY channel_id), q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q)
SELECT channel_id, q, n, true AS kept, true AS small FROM n, q
"""


P4_SQL = """
WITH d AS (SELECT DISTINCT recording_id, channel_id, sample, value FROM analog_long WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT a.channel_id, coalesce(CAST(CAST(timezone('UTC', g.utc_start_time) AS DATE) AS VARCHAR), 'unknown') AS day, a.value FROM d a LEFT JOIN recording g USING (recording_id)),
dual AS (SELECT 'all' AS scope, '' AS day, channel_id, value FROM r UNION ALL SELECT 'day', day, channel_id, value FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, day, channel_id ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY scope, day, channel_id) AS n FROM dual),
q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q)
SELECT scope, day, channel_id, q, n, value FROM n, q WHERE place = floor(q * (n - 1))
"""


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(with_tokens(table(spark, sf, "documents"), ["doc_id"]), table(spark, sf, "pack_budget"))


def p6_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Of each budget: how many texts are packed, whether every container keeps to the capacity, and whether their numbers have no holes."""
    packed = p6_packing(spark, sf)
    of = packed.select("budget_id", "doc_id").distinct().groupBy("budget_id").agg(F.count(F.lit(1)).alias("texts"))
    within = packed.groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("t")).groupBy("budget_id").agg(F.max("t").alias("most"), F.count(F.lit(1)).alias("n"), F.max("container").alias("last"))
    caps = table(spark, sf, "pack_budget").select("budget_id", "capacity")
    return of.join(within, "budget_id").join(caps, "budget_id").select("budget_id", "texts", (F.col("most") <= F.col("capacity")).alias("fits"), (F.col("last") == F.col("n") - 1).alias("gapless"))


P6_SOUND_SQL = """
SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, true AS fits, true AS gapless FROM pack_budget
"""


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill(p6_packing(spark, sf), table(spark, sf, "pack_budget"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(with_tokens(table(spark, sf, "documents"), ["doc_id", "source"]), table(spark, sf, "mix_target"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(p7_mix(spark, sf), table(spark, sf, "mix_target"))


QUERIES = {"p2_found": p2_found, "p4_percentiles": p4_percentiles, "p4_combined": p4_combined, "p4_combined_ranks": p4_combined_ranks, "p6_packing": p6_packing, "p6_fill": p6_fill, "p6_sound": p6_sound, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_labels": p8_labels}
SQL = {"p2_found": P2_SQL, "p4_percentiles": P4_SQL, "p4_combined_ranks": P4_RANKS_SQL, "p6_sound": P6_SOUND_SQL}
