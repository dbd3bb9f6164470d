"""Queries of the toolkit's own operators over the driver's tables, with their SQL.

Readings are those of ``analog_long`` that are numbers (neither null, NaN nor
infinite), each key once.  Trials are the distinct, non-empty rows of ``trial``.
Embeddings serve as equally long trials: 64 samples of one channel, or 8
samples of 8 channels.  Results are rounded, as sums depend on their order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.kernels import filters
from trialloom.kernels import windows as win
from trialloom.model import Trials, concat_trials, default_labels, restack
from trialloom.operators import arithmetic as ar
from trialloom.operators import connectivity as co
from trialloom.operators import plots
from trialloom.operators import preprocess as pp
from trialloom.operators import selection as se
from trialloom.operators import spectral as sp
from trialloom.operators import statistics as st
from trialloom.operators import trials as tr
from trialloom.plans.tables import scratch_path, table
from trialloom.sources import container, raw, synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = 4


def query(sql: str | None = None):
    """Register a query as ref_<its function's name>, with its SQL."""

    def add(f):
        QUERIES[f"ref_{f.__name__}"] = f
        if sql is not None:
            SQL[f"ref_{f.__name__}"] = sql
        return f

    return add


def r(c, digits: int = DIGITS):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def big(c, digits: int = DIGITS):
    """Rounded to ``digits`` below a million, to nine figures beyond: the order of a sum shows in the last figures."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 1e6, F.round(c, digits)).otherwise(F.format_string("%.8e", c.cast("double")).cast("double"))


def big_sql(expr: str, digits: int = DIGITS) -> str:
    return f"(CASE WHEN abs({expr}) < 1e6 THEN round({expr}, {digits}) ELSE CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE) END)"


# --- the tables as objects ---------------------------------------------------------------------------------------

READINGS = """readings AS (
  SELECT recording_id, channel_id, sample, max(value) AS value FROM analog_long
  WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY recording_id, channel_id, sample)"""
TRIALS = "trials AS (SELECT DISTINCT trial_id, recording_id, start, stop, t0 FROM trial WHERE start < stop)"
CUT = f"""{READINGS}, {TRIALS}, cut AS (
  SELECT t.trial_id, t.recording_id, a.sample - t.start AS sample, a.channel_id, a.value
  FROM trials t JOIN readings a ON a.recording_id = t.recording_id AND a.sample >= t.start AND a.sample < t.stop)"""
EMB64 = "e AS (SELECT vec_id AS trial_id, i - 1 AS sample, CAST(embedding[i] AS DOUBLE) AS value, label FROM embeddings, unnest(range(1, 65)) AS u(i))"
EMB8 = "e AS (SELECT vec_id AS trial_id, (i - 1) % 8 AS sample, (i - 1) // 8 AS channel_id, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, 65)) AS u(i))"


def readings(spark: SparkSession, sf: str, series: bool = False) -> DataFrame:
    """Readings, each key once; with ``series`` those of one series in one place, for kernels that take it whole."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    rows = table(spark, sf, "analog_long").where(ok)
    if series:  # one shuffle for the keys and for the series
        rows = rows.select("recording_id", "channel_id", "sample", "value").repartition("recording_id", "channel_id")
    return rows.groupBy("recording_id", "channel_id", "sample").agg(F.max("value").alias("value"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "trial").where("start < stop").select("trial_id", "recording_id", "start", "stop", "t0").distinct()


def cut(spark: SparkSession, sf: str) -> DataFrame:
    met = tr.cut_recording(readings(spark, sf), spans(spark, sf), ["recording_id"])
    return met.select("trial_id", "recording_id", "sample", "channel_id", "value")


def _trials_of(df: DataFrame, n: int, t0: float) -> DataFrame:
    return df.select(F.col("vec_id").cast("int").alias("trial_id"), (F.col("vec_id") * n).alias("start"), ((F.col("vec_id") + 1) * n).alias("stop"), F.lit(t0).alias("t0"), F.array(F.col("label").cast("double")).alias("info"))


def emb64(spark: SparkSession, sf: str) -> Trials:
    e = table(spark, sf, "embeddings")
    facts = e.select(F.col("vec_id").cast("int").alias("trial_id"), F.lit(0).alias("channel_id"), F.posexplode("embedding").alias("sample", "value"))
    facts = facts.select("trial_id", "sample", "channel_id", F.col("value").cast("double"))
    return Trials("analog", facts, _trials_of(e, 64, -16.0), 64.0, {"channel": ["channel1"]})


def emb8(spark: SparkSession, sf: str) -> Trials:
    x = emb64(spark, sf)
    e = table(spark, sf, "embeddings")
    facts = x.facts.select("trial_id", (F.col("sample") % 8).cast("int").alias("sample"), F.expr("sample div 8").cast("int").alias("channel_id"), "value")
    return Trials("analog", facts, _trials_of(e, 8, -2.0), 8.0, {"channel": default_labels("channel", 8)})


def _at(spark: SparkSession, sf: str, df: DataFrame, rate: float | None) -> DataFrame:
    """Rows of the recordings at a sampling rate; of all without one."""
    if rate is None:
        return df
    return df.join(table(spark, sf, "recording").where(F.col("samplerate") == rate).select("recording_id").distinct(), "recording_id", "left_semi")


def by_rate(spark: SparkSession, sf: str, of) -> DataFrame:
    """The tables ``of`` each sampling rate of the recordings one after another, with ``samplerate``; a recording without a rate has no seconds and is left out."""
    rates = table(spark, sf, "recording").where("samplerate > 0 AND NOT isnan(samplerate)").select(F.col("samplerate").cast("double")).distinct().collect()
    return reduce(DataFrame.unionByName, [of(x).withColumn("samplerate", F.lit(x)) for x in sorted(r[0] for r in rates)])


def recordings(spark: SparkSession, sf: str, rate: float | None = None, series: bool = False) -> Trials:
    """Each recording at ``rate`` as one trial; without it all, for what does not depend on the rate."""
    rec = _at(spark, sf, table(spark, sf, "recording"), rate).select(F.col("recording_id").cast("int").alias("trial_id"), F.lit(0).cast("long").alias("start"), F.col("n_samples").alias("stop"), F.lit(0.0).alias("t0"), F.array().cast("array<double>").alias("info"))
    facts = _at(spark, sf, readings(spark, sf, series), rate).select(F.col("recording_id").alias("trial_id"), "sample", "channel_id", "value")
    return Trials("analog", facts, rec, rate or 40.0, {"channel": default_labels("channel", 32)})


def spikes(spark: SparkSession, sf: str, rate: float | None = None) -> Trials:
    """Spikes of all recordings on one axis: each recording starts at a multiple of 10000 samples."""
    at = (F.col("recording_id").cast("long") * 10000 + F.col("sample")).alias("sample")
    facts = _at(spark, sf, table(spark, sf, "spike").where("unit IS NOT NULL"), rate).select(at, "channel", "unit").distinct()
    t = _at(spark, sf, spans(spark, sf), rate).select("trial_id", (F.col("recording_id").cast("long") * 10000 + F.col("start")).alias("start"), (F.col("recording_id").cast("long") * 10000 + F.col("stop")).alias("stop"), "t0", F.array().cast("array<double>").alias("info"))
    return Trials("spike", facts, t, rate or 40.0, {})


def events(spark: SparkSession, sf: str) -> Trials:
    at = (F.col("recording_id").cast("long") * 10000 + F.col("trigger_sample")).alias("sample")
    facts = table(spark, sf, "trigger_mark").where("trigger_code IS NOT NULL AND trigger_sample IS NOT NULL").select(at, F.col("trigger_code").alias("eventid"), "trig_id").dropDuplicates(["trig_id"])
    return Trials("event", facts, spikes(spark, sf).trials, 40.0, {})


SPIKES = "spk AS (SELECT DISTINCT CAST(recording_id AS BIGINT) * 10000 + sample AS sample, channel, unit FROM spike WHERE unit IS NOT NULL)"
SPANS = "sp AS (SELECT DISTINCT trial_id, CAST(recording_id AS BIGINT) * 10000 + start AS start, CAST(recording_id AS BIGINT) * 10000 + stop AS stop, t0 FROM trial WHERE start < stop)"
RATED = "sp AS (SELECT DISTINCT trial_id, CAST(t.recording_id AS BIGINT) * 10000 + start AS start, CAST(t.recording_id AS BIGINT) * 10000 + stop AS stop, t0, samplerate FROM trial t JOIN recording r ON r.recording_id = t.recording_id WHERE start < stop AND samplerate > 0)"
EVENTS = "ev AS (SELECT trig_id, min(CAST(recording_id AS BIGINT) * 10000 + trigger_sample) AS sample, min(trigger_code) AS eventid FROM trigger_mark WHERE trigger_code IS NOT NULL AND trigger_sample IS NOT NULL GROUP BY trig_id)"


# --- flagship: trial mean and variance -----------------------------------------------------------------------------


@query(f"WITH {EMB64} SELECT label, sample, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, count(*) AS n FROM e GROUP BY label, sample")
def trial_mean_var(spark, sf):
    x = emb64(spark, sf)
    cond = x.trials.select("trial_id", F.col("info")[0].cast("int").alias("label"))
    return x.facts.join(cond, "trial_id").groupBy("label", "sample").agg(r(F.avg("value"), 6).alias("mean"), r(F.var_pop("value"), 6).alias("var"), F.count(F.lit(1)).alias("n"))


# --- sources (S) ---------------------------------------------------------------------------------------------------


@query(f"WITH {EMB8} SELECT trial_id, sample, channel_id, round(value, 6) AS value FROM e")
def s1_s2_save_load(spark, sf):
    x = container.load(spark, container.save(emb8(spark, sf), scratch_path(spark, "container"), "s1_s2", overwrite=True), checksum=True)
    return x.facts.select("trial_id", "sample", "channel_id", r("value", 6).alias("value"))


@query()
def s13_synthetic(spark, sf):
    parts = [synthetic.white_noise(spark, 4, 200, seed=1), synthetic.harmonic(spark, 20, 4, 200), synthetic.linear_trend(spark, 4, 200), synthetic.phase_diffusion(spark, 20, 0.1, 4, 200, seed=1), synthetic.red_noise(spark, 0.9, 4, 200, seed=1), synthetic.ar2_network(spark, None, 4, 200, seed=1)]
    return concat_trials(parts).facts


@query("""WITH g AS (SELECT t AS trial_id, c AS channel_id, i AS sample FROM unnest(range(0, 8)) u(t), unnest(range(0, 2)) v(c), unnest(range(0, 200)) w(i))
SELECT trial_id, sample, channel_id, round(CASE WHEN trial_id < 4 THEN cos(2 * pi() * 20 * sample / 1000) ELSE sample / 199 END, 6) + 0.0 AS value FROM g""")
def s13_synthetic_without_noise(spark, sf):
    x = concat_trials([synthetic.harmonic(spark, 20, 4, 200), synthetic.linear_trend(spark, 4, 200)])
    return x.facts.select("trial_id", "sample", "channel_id", (r("value", 6) + 0.0).alias("value"))


@query()
def s13_poisson(spark, sf):
    return synthetic.poisson_noise(spark, seed=42).facts


@query("""
WITH m AS (SELECT recording_id, trigger_timestamp AS time, trigger_code AS code, row_number() OVER (PARTITION BY recording_id, trigger_code ORDER BY trigger_timestamp, trig_id) AS i
  FROM (SELECT DISTINCT trig_id, recording_id, trigger_timestamp, trigger_code FROM trigger_mark WHERE trigger_timestamp IS NOT NULL AND trigger_code IN (12, 90)))
SELECT a.recording_id, CAST(a.i AS INT) AS i, CAST(round(a.time * 1000) AS BIGINT) AS start, CAST(round(b.time * 1000) AS BIGINT) AS stop FROM m a JOIN m b ON a.recording_id = b.recording_id AND a.i = b.i AND a.code = 12 AND b.code = 90
""")
def s7_paired_marks(spark, sf):
    m = table(spark, sf, "trigger_mark").select("trig_id", "recording_id", F.col("trigger_timestamp").alias("time"), F.col("trigger_code").alias("code")).distinct()
    both = raw.paired_trials(m, 12, 90, 1000.0, ["recording_id"])
    return both.select("recording_id", (F.col("trial_id") + 1).alias("i"), "start", "stop")


# --- selection (P) -------------------------------------------------------------------------------------------------

_PICK = [7, 3, 7, 11]


@query(f"WITH {EMB64}, pick AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 11)) p(place, old)) SELECT place AS trial_id, sample, round(value, 6) AS value FROM pick JOIN e ON e.trial_id = pick.old")
def p4_sel_trials_repeated(spark, sf):
    x = se.selectdata.plain(emb64(spark, sf), trials=_PICK)
    return x.facts.select("trial_id", "sample", r("value", 6).alias("value"))


@query(f"WITH {EMB8}, pick AS (SELECT * FROM (VALUES (0, 5), (1, 2), (2, 5)) p(place, old)) SELECT e.trial_id, e.sample, place AS channel_id, round(value, 6) AS value FROM pick JOIN e ON e.channel_id = pick.old")
def p5_sel_channels_ordered(spark, sf):
    x = se.selectdata.plain(emb8(spark, sf), channel=["channel6", 2, 5])
    return x.facts.select("trial_id", "sample", "channel_id", r("value", 6).alias("value"))


@query(f"WITH {EMB64} SELECT trial_id, sample - 8 AS sample, round(value, 6) AS value FROM e WHERE sample BETWEEN 8 AND 40")
def p8_sel_latency(spark, sf):
    x = se.selectdata.plain(emb64(spark, sf), latency=[-0.125, 0.375])
    return x.facts.select("trial_id", "sample", r("value", 6).alias("value"))


@query(f"WITH {EMB64} SELECT trial_id, sample - 16 AS sample, round(value, 6) AS value FROM e WHERE sample >= 16")
def p9_sel_poststim(spark, sf):
    x = se.selectdata.plain(emb64(spark, sf), latency="poststim")
    return x.facts.select("trial_id", "sample", r("value", 6).alias("value"))


@query(f"WITH {SPIKES} SELECT sample, channel, unit FROM spk WHERE unit IN (0, 2) AND channel IN (1, 3, 5)")
def p10_p11_sel_spikes(spark, sf):
    s = spikes(spark, sf)
    s = s.having(labels={"unit": [f"unit{i}" for i in range(99)]}, info={"unit_codes": list(range(99)), "channel_codes": list(range(99))})
    return se.selectdata.plain(s, unit=["unit0", 2], channel=[1, 3, 5]).facts


@query(f"WITH {SPANS} SELECT trial_id, round(t0 / 40, 6) AS first, round((stop - start - 1 + t0) / 40, 6) AS last FROM sp")
def p9_trial_intervals(spark, sf):
    return spikes(spark, sf).intervals().select("trial_id", r("first", 6).alias("first"), r("last", 6).alias("last"))


@query(f"WITH {RATED} SELECT trial_id, samplerate, round(t0 / samplerate, 6) AS first, round((stop - start - 1 + t0) / samplerate, 6) AS last FROM sp")
def p9_trial_intervals_rates(spark, sf):
    return by_rate(spark, sf, lambda rate: spikes(spark, sf, rate).intervals().select("trial_id", r("first", 6).alias("first"), r("last", 6).alias("last")))


@query(f"WITH {SPANS} SELECT trial_id, start, stop FROM sp WHERE t0 / 40 <= -0.125 AND (stop - start - 1 + t0) / 40 >= 0.5")
def p8_covering_trials(spark, sf):
    return se.covering(spikes(spark, sf), (-0.125, 0.5)).select("trial_id", "start", "stop")


@query(f"WITH {TRIALS} SELECT trial_id, CAST(coalesce(sum(stop - start) OVER (ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(stop - start) OVER (ORDER BY trial_id) AS BIGINT) AS stop FROM trials")
def p16_restacked(spark, sf):
    return restack(spans(spark, sf).withColumn("n", F.col("stop") - F.col("start"))).select("trial_id", "start", "stop")


@query("""WITH f AS (SELECT idx, num FROM label WHERE axis = 'freq'), w AS (SELECT unnest([3.3, 10.0, 41.7]::DOUBLE[]) AS wanted)
SELECT wanted, idx, num FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY abs(num - wanted), num DESC) AS place FROM w, f) WHERE place = 1""")
def p6_p15_nearest_bin(spark, sf):
    f = table(spark, sf, "label").where("axis = 'freq'").select("idx", "num").orderBy("num").collect()
    wanted = [3.3, 10.0, 41.7]
    values, at = se.best_match([x["num"] for x in f], wanted)
    return spark.createDataFrame([(w, int(f[i]["idx"]), float(v)) for w, v, i in zip(wanted, values, at)], "wanted double, idx int, num double")


@query("SELECT idx, num FROM label WHERE axis = 'freq' AND num BETWEEN 8 AND 30")
def p7_frequency_range(spark, sf):
    f = table(spark, sf, "label").where("axis = 'freq'").select("idx", "num").orderBy("num").collect()
    at = se.frequencies([x["num"] for x in f], [8, 30])
    return spark.createDataFrame([(int(f[i]["idx"]), float(f[i]["num"])) for i in at], "idx int, num double")


# --- trials (T) and joins (J) --------------------------------------------------------------------------------------


@query(f"WITH {CUT} SELECT trial_id, channel_id, count(*) AS n, min(sample) AS lo, max(sample) AS hi, {big_sql('sum(value)', 3)} AS total FROM cut GROUP BY trial_id, channel_id")
def j1_trials_of_recordings(spark, sf):
    return cut(spark, sf).groupBy("trial_id", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("lo"), F.max("sample").alias("hi"), big(F.sum("value"), 3).alias("total"))


@query(f"WITH {SPIKES} SELECT 0 AS trial_id, min(sample) AS start, max(sample) AS stop FROM spk")
def t2_whole_recording(spark, sf):
    return tr.definetrial.plain(spikes(spark, sf)).trials.select("trial_id", "start", "stop")


@query(f"WITH {SPANS} SELECT trial_id, CAST(round(start * 2.5) AS BIGINT) AS start, CAST(round(stop * 2.5) AS BIGINT) AS stop, round(t0 * 2.5) AS t0 FROM sp")
def t3_trials_at_other_rate(spark, sf):
    x = emb64(spark, sf).having(samplerate=100.0)
    ev = events(spark, sf)
    return tr.definetrial.plain(x, ev).trials.select("trial_id", "start", "stop", "t0")


@query("""WITH ev AS (SELECT trig_id, min(recording_id) AS recording_id, min(trigger_sample) AS sample, min(trigger_code) AS code FROM trigger_mark WHERE trigger_code IS NOT NULL AND trigger_sample IS NOT NULL GROUP BY trig_id)
SELECT recording_id, sample - 20 AS start, sample + 40 AS stop, CAST(-20 AS DOUBLE) AS t0, trig_id FROM ev WHERE code = 90""")
def t4_trials_around_triggers(spark, sf):
    ev = table(spark, sf, "trigger_mark").dropDuplicates(["trig_id"]).select("recording_id", F.col("trigger_sample").alias("sample"), F.col("trigger_code").alias("eventid"), "trig_id")
    return tr.trials_around(ev, 90, 0.5, 1.0, 40.0, ("recording_id", "trig_id")).select("recording_id", "start", "stop", "t0", "trig_id")


@query("""WITH RECURSIVE ev AS (SELECT trig_id, min(recording_id) AS rec, min(trigger_sample) AS s, min(trigger_code) AS c FROM trigger_mark WHERE trigger_code IS NOT NULL AND trigger_sample IS NOT NULL GROUP BY trig_id),
o AS (SELECT rec, s, c, row_number() OVER (PARTITION BY rec ORDER BY s, c, trig_id) AS p FROM ev WHERE c IN (12, 90, 230)),
l AS (SELECT rec, list(p ORDER BY p) FILTER (c = 12) AS a, list(p ORDER BY p) FILTER (c = 90) AS b, list(p ORDER BY p) FILTER (c = 230) AS e FROM o GROUP BY rec),
m AS (
  SELECT rec, a, b, e, 0 AS k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS h FROM l
  UNION ALL
  SELECT rec, a, b, e, k + 1, i2, j2, list_min(list_filter(e, lambda x: x > i2 AND x > h)) FROM (
    SELECT rec, a, b, e, k, h, i2, list_min(list_filter(b, lambda x: x > i2 AND x > j)) AS j2 FROM (
      SELECT rec, a, b, e, k, j, h, a[k + 1] AS i2 FROM m WHERE k < len(a) AND j IS NOT NULL AND h IS NOT NULL))),
f AS (SELECT m.rec, x.s - 20 AS start, z.s AS stop, CAST(x.s - 20 - y.s AS DOUBLE) AS t0 FROM m JOIN o x ON x.rec = m.rec AND x.p = i JOIN o y ON y.rec = m.rec AND y.p = j JOIN o z ON z.rec = m.rec AND z.p = h WHERE k > 0)
SELECT rec AS recording_id, CAST(row_number() OVER (PARTITION BY rec ORDER BY start, stop) - 1 AS INT) AS trial_id, start, stop, t0, CAST(90 AS DOUBLE) AS code FROM f""")
def t4_matched_events(spark, sf):
    ev = table(spark, sf, "trigger_mark").where("trigger_code IS NOT NULL AND trigger_sample IS NOT NULL").dropDuplicates(["trig_id"])
    slim = ev.select("recording_id", F.col("trigger_sample").alias("sample"), F.col("trigger_code").alias("eventid"))
    found = tr.match_events(slim, 40.0, 40.0, pre=0.5, start=12, trigger=90, stop=230, recording="recording_id")
    return found.select("recording_id", "trial_id", "start", "stop", "t0", F.col("info")[0].alias("code"))


@query(f"""WITH {TRIALS}, len AS (SELECT recording_id, max(n_samples) AS n FROM recording GROUP BY recording_id)
SELECT trial_id, t.recording_id, greatest(start, 0) AS start, least(stop, n) AS stop, t0 + greatest(start, 0) - start AS t0 FROM trials t LEFT JOIN len l ON l.recording_id = t.recording_id""")
def t5_clipped_recordings(spark, sf):
    """Every trial cut to its own recording."""
    lengths = table(spark, sf, "recording").groupBy("recording_id").agg(F.max("n_samples").alias("n"))
    t = spans(spark, sf).join(lengths, "recording_id", "left").withColumn("info", F.array(F.col("recording_id").cast("double")))
    return tr.clip(t, "n").select("trial_id", F.col("info")[0].cast("int").alias("recording_id"), "start", "stop", "t0")


@query(f"""WITH {SPIKES}, {SPANS} SELECT k.sample, k.channel, k.unit, coalesce(max(t.trial_id), -1) AS trial_id
FROM spk k LEFT JOIN sp t ON k.sample >= t.start AND k.sample < t.stop GROUP BY k.sample, k.channel, k.unit""")
def t6_spikes_in_trials(spark, sf):
    return tr.assign(spikes(spark, sf)).select("sample", "channel", "unit", "trial_id")


@query(f"WITH {EMB64} SELECT trial_id, sample - 12 AS sample, round(value, 6) AS value FROM e WHERE sample BETWEEN 12 AND 47")
def t7_redefined(spark, sf):
    x = tr.redefinetrial.plain(emb64(spark, sf), begsample=12, endsample=48)
    return x.facts.select("trial_id", "sample", r("value", 6).alias("value"))


@query(f"WITH {SPANS} SELECT trial_id, start, stop, CAST(-4 AS DOUBLE) AS t0 FROM sp WHERE stop - start >= 50")
def t7_minlength_offset(spark, sf):
    return tr.redefinetrial.plain(spikes(spark, sf), minlength=1.25, offset=-4).trials.select("trial_id", "start", "stop", "t0")


# --- arithmetic (M) ------------------------------------------------------------------------------------------------


@query(f"WITH {READINGS} SELECT channel_id, {big_sql('sum(3 - 2 * value)', 2)} AS total, {big_sql('max(abs(3 - 2 * value))')} AS top, count(*) AS n FROM readings GROUP BY channel_id")
def m2_scalar(spark, sf):
    x = 3 - recordings(spark, sf) * 2
    return x.facts.groupBy("channel_id").agg(big(F.sum("value"), 2).alias("total"), big(F.max(F.abs("value"))).alias("top"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EMB8} SELECT trial_id, sample, channel_id, round(value * (channel_id + 1), 6) AS value FROM e")
def m3_array(spark, sf):
    return (emb8(spark, sf) * np.arange(1, 9)).facts.select("trial_id", "sample", "channel_id", r("value", 6).alias("value"))


@query(f"WITH {EMB8} SELECT trial_id, sample, channel_id, round(value * value - value / 2, 6) AS value FROM e")
def m4_j2_objects(spark, sf):
    x = emb8(spark, sf)
    return (x**2 - x / 2).facts.select("trial_id", "sample", "channel_id", r("value", 6).alias("value"))


@query(f"WITH {EMB8} SELECT trial_id, sample, channel_id, round(value, 6) AS value FROM e UNION ALL SELECT trial_id, sample, channel_id + 8, round(-value, 6) FROM e")
def m7_j3_concat_channels(spark, sf):
    x = emb8(spark, sf)
    return ar.concat(x, x * -1).facts.select("trial_id", "sample", "channel_id", (r("value", 6) + 0.0).alias("value"))


@query(f"WITH {EMB8}, n AS (SELECT max(trial_id) + 1 AS n FROM e) SELECT trial_id, sample, channel_id, round(value, 6) AS value FROM e UNION ALL SELECT trial_id + n, sample, channel_id, round(value, 6) FROM e, n")
def m8_concat_trials(spark, sf):
    x = emb8(spark, sf)
    return concat_trials([x, x]).facts.select("trial_id", "sample", "channel_id", r("value", 6).alias("value"))


@query("SELECT true AS same, false AS other")
def m6_equal(spark, sf):
    x = emb8(spark, sf)
    return spark.createDataFrame([(ar.equal(x, x * 1), ar.equal(x, x + 1))], "same boolean, other boolean")


# --- statistics (A) ------------------------------------------------------------------------------------------------


def _axis_sql(expr: str) -> str:
    return f"WITH {READINGS} SELECT recording_id AS trial_id, channel_id, {big_sql(expr)} AS value FROM readings GROUP BY recording_id, channel_id"


@query(_axis_sql("avg(value)"))
def a1_mean_time(spark, sf):
    return st.mean.plain(recordings(spark, sf), "time").facts.select("trial_id", "channel_id", big("value").alias("value"))


@query(_axis_sql("stddev_pop(value)"))
def a2_std_time(spark, sf):
    return st.std.plain(recordings(spark, sf), "time").facts.select("trial_id", "channel_id", big("value").alias("value"))


@query(_axis_sql("median(value)"))
def a4_median_time(spark, sf):
    return st.median.plain(recordings(spark, sf), "time").facts.select("trial_id", "channel_id", big("value").alias("value"))


@query(f"WITH {EMB8} SELECT sample, channel_id, round(var_pop(value), 6) AS value FROM e GROUP BY sample, channel_id")
def a3_a6_var_trials(spark, sf):
    return st.var.plain(emb8(spark, sf), "trials").facts.select("sample", "channel_id", r("value", 6).alias("value"))


@query(f"WITH {EMB8}, m AS (SELECT trial_id, sample, avg(value) AS v FROM e GROUP BY trial_id, sample) SELECT sample, round(avg(v), 6) AS value FROM m GROUP BY sample")
def a7_mean_channel_then_trials(spark, sf):
    return st.mean.plain(emb8(spark, sf), "channel", keeptrials=False).facts.select("sample", r("value", 6).alias("value"))


@query(f"WITH {EMB64} SELECT sample - 8 AS sample, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS spread FROM e WHERE sample BETWEEN 8 AND 40 GROUP BY sample")
def a9_timelock(spark, sf):
    x = st.timelockanalysis.plain(emb64(spark, sf), latency=[-0.125, 0.375])
    return x.extras["avg"].join(x.extras["var"], ["sample", "channel_id"]).select("sample", r("avg", 6).alias("mean"), r("var", 6).alias("spread"))


@query(f"WITH {EMB8} SELECT a.trial_id, a.channel_id AS channel_i, b.channel_id AS channel_j, round(covar_samp(a.value, b.value), 6) AS cov FROM e a JOIN e b ON a.trial_id = b.trial_id AND a.sample = b.sample GROUP BY ALL")
def a10_covariance(spark, sf):
    return st.covariance(emb8(spark, sf).facts, ["trial_id"]).select("trial_id", "channel_i", "channel_j", r("cov", 6).alias("cov"))


_BINS, _LO, _WIDTH = 8, -0.25, 0.25


@query(f"""WITH {SPIKES}, {SPANS},
c AS (SELECT DISTINCT channel, unit FROM spk), b AS (SELECT unnest(range(0, {_BINS})) AS bin),
h AS (SELECT t.trial_id, k.channel, k.unit, CAST(floor(((k.sample - t.start + t.t0) / 40.0 - ({_LO})) / {_WIDTH}) AS INT) AS raw, (k.sample - t.start + t.t0) / 40.0 AS time FROM spk k JOIN sp t ON k.sample >= t.start AND k.sample < t.stop),
n AS (SELECT trial_id, channel, unit, CASE WHEN time = {_LO + _BINS * _WIDTH} THEN {_BINS - 1} ELSE raw END AS bin, count(*) AS n FROM h GROUP BY ALL),
g AS (SELECT sp.trial_id, c.channel, c.unit, b.bin, n.n FROM sp CROSS JOIN c CROSS JOIN b LEFT JOIN n ON n.trial_id = sp.trial_id AND n.channel = c.channel AND n.unit = c.unit AND n.bin = b.bin
  WHERE {_LO} + b.bin * {_WIDTH} >= sp.t0 / 40 - 1e-9 AND {_LO} + (b.bin + 1) * {_WIDTH} <= (sp.stop - sp.start + sp.t0) / 40 + 1e-9)
SELECT channel, unit, bin, round(avg(coalesce(n, 0) / {_WIDTH}), 6) AS rate, round(var_pop(coalesce(n, 0) / {_WIDTH}), 6) AS var, count(*) AS trials FROM g GROUP BY channel, unit, bin""")
def a11_a12_psth(spark, sf):
    s = spikes(spark, sf)
    edges = [_LO + i * _WIDTH for i in range(_BINS + 1)]
    combos = s.facts.select("channel", "unit").distinct().withColumn("channel_id", F.lit(0))
    counts = st.histogram(tr.assign(s, every=True), ["trial_id", "channel", "unit"], "time", edges)
    grid = st.psth_grid(s, combos, edges).where("covered")
    full = grid.join(counts, ["trial_id", "channel", "unit", "bin"], "left").withColumn("rate", F.coalesce("n", F.lit(0)) / _WIDTH)
    return full.groupBy("channel", "unit", "bin").agg(r(F.avg("rate"), 6).alias("rate"), r(F.var_pop("rate"), 6).alias("var"), F.count(F.lit(1)).alias("trials"))


@query(f"""WITH {SPIKES}, {RATED},
c AS (SELECT DISTINCT channel, unit FROM spk), b AS (SELECT unnest(range(0, {_BINS})) AS bin),
h AS (SELECT t.trial_id, k.channel, k.unit, CAST(floor(((k.sample - t.start + t.t0) / t.samplerate - ({_LO})) / {_WIDTH}) AS INT) AS raw, (k.sample - t.start + t.t0) / t.samplerate AS time FROM spk k JOIN sp t ON k.sample >= t.start AND k.sample < t.stop),
n AS (SELECT trial_id, channel, unit, CASE WHEN time = {_LO + _BINS * _WIDTH} THEN {_BINS - 1} ELSE raw END AS bin, count(*) AS n FROM h GROUP BY ALL),
g AS (SELECT sp.trial_id, c.channel, c.unit, b.bin, n.n FROM sp CROSS JOIN c CROSS JOIN b LEFT JOIN n ON n.trial_id = sp.trial_id AND n.channel = c.channel AND n.unit = c.unit AND n.bin = b.bin
  WHERE {_LO} + b.bin * {_WIDTH} >= sp.t0 / sp.samplerate - 1e-9 AND {_LO} + (b.bin + 1) * {_WIDTH} <= (sp.stop - sp.start + sp.t0) / sp.samplerate + 1e-9)
SELECT channel, unit, bin, round(avg(coalesce(n, 0) / {_WIDTH}), 6) AS rate, round(var_pop(coalesce(n, 0) / {_WIDTH}), 6) AS var, count(*) AS trials FROM g GROUP BY channel, unit, bin""")
def a11_a12_psth_rates(spark, sf):
    edges = [_LO + i * _WIDTH for i in range(_BINS + 1)]
    combos = spikes(spark, sf).facts.select("channel", "unit").distinct().withColumn("channel_id", F.lit(0))

    def rates(rate):
        s = spikes(spark, sf, rate)
        counts = st.histogram(tr.assign(s, every=True), ["trial_id", "channel", "unit"], "time", edges)
        grid = st.psth_grid(s, combos, edges).where("covered")
        return grid.join(counts, ["trial_id", "channel", "unit", "bin"], "left").withColumn("rate", F.coalesce("n", F.lit(0)) / _WIDTH)

    full = by_rate(spark, sf, rates)
    return full.groupBy("channel", "unit", "bin").agg(r(F.avg("rate"), 6).alias("rate"), r(F.var_pop("rate"), 6).alias("var"), F.count(F.lit(1)).alias("trials"))


@query(f"""WITH {SPIKES}, {SPANS},
c AS (SELECT channel, unit, CAST(row_number() OVER (ORDER BY channel, unit) - 1 AS INT) AS channel_id FROM (SELECT DISTINCT channel, unit FROM spk WHERE channel IS NOT NULL)), b AS (SELECT unnest(range(0, {_BINS})) AS bin),
h AS (SELECT t.trial_id, k.channel, k.unit, CAST(floor(((k.sample - t.start + t.t0) / 40.0 - ({_LO})) / {_WIDTH}) AS INT) AS raw, (k.sample - t.start + t.t0) / 40.0 AS time FROM spk k JOIN sp t ON k.sample >= t.start AND k.sample < t.stop),
n AS (SELECT trial_id, channel, unit, CASE WHEN time = {_LO + _BINS * _WIDTH} THEN {_BINS - 1} ELSE raw END AS bin, count(*) AS n FROM h GROUP BY ALL),
g AS (SELECT b.bin, c.channel_id, CASE WHEN {_LO} + b.bin * {_WIDTH} >= sp.t0 / 40 - 1e-9 AND {_LO} + (b.bin + 1) * {_WIDTH} <= (sp.stop - sp.start + sp.t0) / 40 + 1e-9 THEN coalesce(n.n, 0) / {_WIDTH} END AS rate
  FROM sp CROSS JOIN c CROSS JOIN b LEFT JOIN n ON n.trial_id = sp.trial_id AND n.channel = c.channel AND n.unit = c.unit AND n.bin = b.bin)
SELECT bin AS sample, channel_id, round(avg(rate), 6) AS rate FROM g GROUP BY bin, channel_id""")
def a11_psth_frontend(spark, sf):
    found = st.spike_psth.plain(spikes(spark, sf), binsize=_WIDTH, latency=[_LO, _LO + _BINS * _WIDTH]).extras["avg"]
    return found.select("sample", "channel_id", r("avg", 6).alias("rate"))


@query(f"WITH {SPIKES} SELECT DISTINCT channel, unit FROM spk")
def a13_channel_units(spark, sf):
    return st.channel_units(spikes(spark, sf))


@query("SELECT 63 AS edges, 32 AS rice, 64 AS root")
def a14_bin_rules(spark, sf):
    return spark.createDataFrame([(len(st.bin_edges((0.0, 1.0), "rice", 31550.0)), st.rice_bins(4096.5), st.sqrt_bins(4096))], "edges int, rice int, root int")


@query(f"""WITH {EMB8}, s AS (SELECT sample, channel_id, count(*) AS n, sum(value) AS t FROM e GROUP BY sample, channel_id),
rep AS (SELECT e.sample, e.channel_id, (t - value) / (n - 1) AS v, n FROM e JOIN s ON e.sample = s.sample AND e.channel_id = s.channel_id),
j AS (SELECT sample, channel_id, max(n) AS n, avg(v) AS m, var_pop(v) AS p FROM rep GROUP BY sample, channel_id)
SELECT j.sample, j.channel_id, round((j.n - 1) * (m - t / s.n), 6) + 0.0 AS bias, round((j.n - 1) * j.n * p, 6) AS var FROM j JOIN s ON j.sample = s.sample AND j.channel_id = s.channel_id""")
def a15_a16_jackknife(spark, sf):
    facts, axes = emb8(spark, sf).facts, ["sample", "channel_id"]
    reps = st.leave_one_out(facts, "trial_id", axes, ["value"])
    jack = st.bias_variance(reps, facts.groupBy(*axes).agg(F.avg("value").alias("value")), axes, ["value"])
    return jack.select(*axes, (r("jack_bias", 6) + 0.0).alias("bias"), r("jack_var", 6).alias("var"))


@query(f"WITH {EVENTS} SELECT DISTINCT eventid FROM ev")
def a17_event_codes(spark, sf):
    return st.event_codes(events(spark, sf))


# --- preprocessing (F) ---------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY recording_id, channel_id)"


def _series_sql(expr: str, extra: str = "") -> str:
    return f"""WITH {READINGS}, d AS (SELECT recording_id, channel_id, sample, {expr} AS v FROM readings)
SELECT recording_id AS trial_id, channel_id, count(*) AS n, {big_sql('min(v)', 3)} AS lo, {big_sql('max(v)', 3)} AS hi, {big_sql('avg(v * v)', 2)} AS power FROM d {extra} GROUP BY recording_id, channel_id"""


def _series(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.groupBy("trial_id", "channel_id").agg(F.count(F.lit(1)).alias("n"), big(F.min(v), 3).alias("lo"), big(F.max(v), 3).alias("hi"), big(F.avg(v * v), 2).alias("power"))


@query(_series_sql(f"value - avg(value) {_W}"))
def f5_demeaned(spark, sf):
    return _series(pp.detrended(recordings(spark, sf).facts, pp.SERIES, 0))


@query(_series_sql(f"value - avg(value) {_W} - coalesce(covar_pop(value, CAST(sample AS DOUBLE)) {_W} / var_pop(CAST(sample AS DOUBLE)) {_W}, 0) * (sample - avg(sample) {_W})"))
def f5_detrended(spark, sf):
    return _series(pp.detrended(recordings(spark, sf).facts, pp.SERIES, 1))


@query(f"""WITH {READINGS}, d AS (SELECT *, avg(value) {_W} AS m, stddev_pop(value) {_W} AS s FROM readings)
SELECT recording_id AS trial_id, channel_id, count(*) AS n, round(min((value - m) / s), 3) AS lo, round(max((value - m) / s), 3) AS hi FROM d WHERE s > 1e-9 GROUP BY recording_id, channel_id""")
def f6_zscore(spark, sf):
    out = pp.standardised(recordings(spark, sf).facts, pp.SERIES)
    return _series(out.where(~F.isnan("value"))).select("trial_id", "channel_id", "n", "lo", "hi")


@query(_series_sql("abs(value)"))
def f7_rectified(spark, sf):
    return _series(pp.rectified(recordings(spark, sf).facts))


@query("SELECT recording_id AS trial_id FROM analog_long GROUP BY recording_id HAVING bool_or(isnan(value))")
def f9_nan_trials(spark, sf):
    x = recordings(spark, sf).having(facts=table(spark, sf, "analog_long").select(F.col("recording_id").alias("trial_id"), "sample", "channel_id", "value"))
    return pp.nan_trials(x)


@query(f"WITH {READINGS} SELECT recording_id AS trial_id, sample // 5 AS sample, channel_id, {big_sql('value')} AS value FROM readings WHERE sample % 5 = 0")
def f11_downsampled(spark, sf):
    x = pp.resampledata.plain(recordings(spark, sf), 8.0, method="downsample")
    return x.facts.select("trial_id", "sample", "channel_id", big("value").alias("value"))


@query("SELECT recording_id AS trial_id, CAST(0 AS BIGINT) AS start, CAST(ceil(n_samples * 0.625 - 1e-9) AS BIGINT) AS stop FROM recording")
def f13_resampled_trials(spark, sf):
    return pp.resampled_trials(recordings(spark, sf).trials, 0.625).select("trial_id", "start", "stop")


@query()
def f2_butterworth(spark, sf):
    def filtered(rate):
        # nothing lies above the Nyquist rate: a band that reaches it is a high-pass
        band = {"filter_type": "bp", "freq": [2, 10]} if rate > 20 else {"filter_type": "hp", "freq": 2}
        return _series(pp.preprocessing.plain(recordings(spark, sf, rate, series=True), filter_class="but", polyremoval=0, **band).facts)

    return by_rate(spark, sf, filtered)


_SERIES = f"""{READINGS}, s AS (SELECT recording_id, channel_id, CAST(row_number() OVER (PARTITION BY recording_id, channel_id ORDER BY sample) - 1 AS INT) AS i, value, samplerate AS fs
  FROM readings JOIN (SELECT recording_id, max(samplerate) AS samplerate FROM recording WHERE samplerate > 0 GROUP BY recording_id) USING (recording_id)),
len AS (SELECT recording_id, channel_id, max(fs) AS fs, CAST(count(*) AS INT) AS n FROM s GROUP BY recording_id, channel_id)"""


@query(f"""WITH {_SERIES},
k0 AS (SELECT fs, lag, CASE WHEN lag = 0 THEN 16 / fs ELSE sin(2 * pi() * 8 / fs * lag) / (pi() * lag) END * (0.54 + 0.46 * cos(2 * pi() * lag / 40)) AS w FROM (SELECT DISTINCT fs FROM s), (SELECT unnest(range(-20, 21)) AS lag)),
k AS (SELECT fs, lag, w / sum(w) OVER (PARTITION BY fs) AS w FROM k0),
once AS (SELECT s.recording_id, s.channel_id, s.fs, s.i + k.lag AS i, sum(s.value * k.w) AS v FROM s JOIN k ON k.fs = s.fs JOIN len l ON l.recording_id = s.recording_id AND l.channel_id = s.channel_id WHERE s.i + k.lag BETWEEN 0 AND l.n - 1 GROUP BY ALL),
d AS (SELECT o.recording_id, o.channel_id, o.fs, o.i + k.lag AS i, sum(o.v * k.w) AS v FROM once o JOIN k ON k.fs = o.fs JOIN len l ON l.recording_id = o.recording_id AND l.channel_id = o.channel_id WHERE o.i + k.lag BETWEEN 0 AND l.n - 1 GROUP BY ALL)
SELECT recording_id AS trial_id, channel_id, count(*) AS n, {big_sql('min(v)', 3)} AS lo, {big_sql('max(v)', 3)} AS hi, {big_sql('avg(v * v)', 2)} AS power, fs AS samplerate FROM d GROUP BY recording_id, channel_id, fs""")
def f3_f4_windowed_sinc(spark, sf):
    return by_rate(spark, sf, lambda rate: _series(pp.preprocessing.plain(recordings(spark, sf, rate, series=True), filter_class="firws", filter_type="lp", freq=8, order=40).facts))


@query(f"""WITH {EMB64}, k AS (SELECT * FROM (VALUES {', '.join(f'({i - 2}, {float(x)!r})' for i, x in enumerate(__import__('trialloom.kernels.filters', fromlist=['x']).sinc_kernel('hamming', 4, 0.2, 'lp')))}) k(lag, w))
SELECT a.trial_id, a.sample, round(sum(b.value * k.w), 6) AS value FROM e a JOIN k ON true JOIN e b ON b.trial_id = a.trial_id AND b.sample = a.sample - k.lag GROUP BY a.trial_id, a.sample""")
def f3_short_kernel(spark, sf):
    x = pp.preprocessing.plain(emb64(spark, sf), filter_class="firws", filter_type="lp", freq=12.8, order=4, direction="onepass")
    return x.facts.select("trial_id", "sample", r("value", 6).alias("value"))


@query(f"""WITH {READINGS}, s AS (SELECT recording_id, channel_id, CAST(row_number() OVER (PARTITION BY recording_id, channel_id ORDER BY sample) - 1 AS INT) AS i, value FROM readings),
len AS (SELECT recording_id, channel_id, CAST(count(*) AS INT) AS n FROM s GROUP BY recording_id, channel_id),
h AS (SELECT n, m, CASE WHEN n % 2 = 0 THEN (1 - cos(pi() * m)) / (n * tan(pi() * m / n)) ELSE (1 / tan(pi() * m / n) - cos(pi() * m) / sin(pi() * m / n)) / n END AS w FROM (SELECT DISTINCT n FROM len), LATERAL (SELECT unnest(range(1, n)) AS m)),
im AS (SELECT s.recording_id, s.channel_id, (s.i + h.m) % l.n AS i, sum(s.value * h.w) AS v FROM s JOIN len l USING (recording_id, channel_id) JOIN h ON h.n = l.n GROUP BY ALL),
d AS (SELECT s.recording_id, s.channel_id, sqrt(s.value * s.value + coalesce(im.v, 0) * coalesce(im.v, 0)) AS v FROM s LEFT JOIN im ON im.recording_id = s.recording_id AND im.channel_id = s.channel_id AND im.i = s.i)
SELECT recording_id AS trial_id, channel_id, count(*) AS n, {big_sql('max(v)', 3)} AS hi, {big_sql('avg(v * v)', 2)} AS power FROM d GROUP BY recording_id, channel_id""")
def f8_hilbert(spark, sf):
    """Largest value and power of the envelopes; beside a reading of 1e30 the least is below the transform's rounding."""
    return _series(pp.preprocessing.plain(recordings(spark, sf, series=True), filter_class=None, hilbert="abs").facts).drop("lo")


@query()
def f12_resampled(spark, sf):
    def resampled(rate):
        x = recordings(spark, sf, rate, series=True)
        # the operator lowers rates only; its kernel raises them, too
        return _series(pp.resampledata.plain(x, 25.0).facts if rate >= 25 else pp.map_series(x, lambda v: filters.resample(v, rate, 25.0)))

    return by_rate(spark, sf, resampled)


# --- spectra (Q) ---------------------------------------------------------------------------------------------------

_DFT = f"""{EMB8.replace('e AS', 'e0 AS')}, e AS (SELECT * FROM e0), fk AS (SELECT unnest(range(0, 5)) AS freq_id),
z AS (SELECT e.trial_id, e.channel_id, fk.freq_id, sum(value * cos(2 * pi() * ((fk.freq_id * e.sample) % 8) / 8)) * sqrt(2) / 8 AS re, -sum(value * sin(2 * pi() * ((fk.freq_id * e.sample) % 8) / 8)) * sqrt(2) / 8 AS im FROM e, fk GROUP BY ALL)"""


def _dft8(spark, sf) -> DataFrame:
    z = sp.dft(emb8(spark, sf).facts, ["trial_id", "channel_id"], 8, "sample", "value")
    return z.select("trial_id", F.lit(0).alias("time_idx"), F.lit(0).alias("taper_id"), "freq_id", "channel_id", "re", "im")


@query(f"WITH {_DFT} SELECT trial_id, channel_id, freq_id, round(re * re + im * im, 6) AS power FROM z")
def q1_q13_dft_power(spark, sf):
    z = _dft8(spark, sf)
    return z.select("trial_id", "channel_id", "freq_id", r(sp.converted(F.col("re"), F.col("im"), "pow"), 6).alias("power"))


@query(f"WITH {_DFT} SELECT trial_id, channel_id, freq_id, round(re * re + im * im, 6) AS power FROM z")
def q1_mtmfft_power(spark, sf):
    x = sp.freqanalysis.plain(emb8(spark, sf), taper=None, polyremoval=None)
    return x.facts.select("trial_id", "channel_id", "freq_id", r("re", 6).alias("power"))


_HANN = ", ".join(f"({i}, {float(w)!r})" for i, w in enumerate(win.tapers("hann", 64, 64)[0]))


@query(f"""WITH {EMB64}, h AS (SELECT * FROM (VALUES {_HANN}) h(sample, w)), fk AS (SELECT unnest(range(0, 33)) AS freq_id), m AS (SELECT trial_id, avg(value) AS m FROM e GROUP BY trial_id),
x AS (SELECT e.trial_id, e.sample, (value - m) * w AS v FROM e JOIN h ON e.sample = h.sample JOIN m ON m.trial_id = e.trial_id),
z AS (SELECT trial_id, freq_id, sum(v * cos(2 * pi() * ((freq_id * sample) % 64) / 64)) * sqrt(2) / 64 AS re, sum(v * sin(2 * pi() * ((freq_id * sample) % 64) / 64)) * sqrt(2) / 64 AS im FROM x, fk GROUP BY ALL)
SELECT freq_id, round(avg(re * re + im * im), 6) AS power FROM z GROUP BY freq_id""")
def q1_q2_hann_power(spark, sf):
    x = sp.freqanalysis.plain(emb64(spark, sf), taper="hann", polyremoval=0, keeptrials=False)
    return x.facts.select("freq_id", r("re", 6).alias("power"))


@query()
def q1_q3_multitaper(spark, sf):
    def powers(rate):
        x = sp.freqanalysis.plain(recordings(spark, sf, rate, series=True), tapsmofrq=0.5, pad="nextpow2", keeptrials=False)
        return x.facts.select("channel_id", "freq_id", F.col("re").alias("power")).withColumn("freq", F.col("freq_id") * float(x.labels["freq"][1]))

    return by_rate(spark, sf, powers)


_WINDOWS = f"""{_SERIES}, rate AS (SELECT DISTINCT fs, CAST(round(2 * fs) AS INT) AS w FROM s),
hann AS (SELECT fs, w, k, 0.5 - 0.5 * cos(2 * pi() * k / (w - 1)) AS h FROM rate, LATERAL (SELECT unnest(range(0, w)) AS k)),
taper AS (SELECT fs, w, k, h * sqrt(w / sum(h) OVER (PARTITION BY fs)) * sqrt(4 / 3.0) AS h FROM hann),
bin AS (SELECT fs, w, k, f, h * cos(2 * pi() * ((f * k) % w) / w) AS c, h * sin(2 * pi() * ((f * k) % w) / w) AS q FROM taper, LATERAL (SELECT unnest(range(0, w // 2 + 1)) AS f)),
flat AS (SELECT fs, f, sum(c) AS c, sum(q) AS q FROM bin GROUP BY fs, f),
centre AS (SELECT l.recording_id, l.channel_id, l.fs, r.w, t FROM len l JOIN rate r ON r.fs = l.fs, LATERAL (SELECT unnest(range(0, l.n, greatest(1, r.w - r.w // 2))) AS t)),
cell AS (SELECT c.recording_id, c.channel_id, c.fs, c.w, c.t, s.i - c.t + c.w // 2 AS k, s.value FROM centre c JOIN s ON s.recording_id = c.recording_id AND s.channel_id = c.channel_id AND s.i >= c.t - c.w // 2 AND s.i < c.t - c.w // 2 + c.w),
level AS (SELECT recording_id, channel_id, t, sum(value) / max(w) AS m FROM cell GROUP BY ALL),
z AS (SELECT x.recording_id, x.channel_id, x.fs, x.w, x.t, b.f, sum(x.value * b.c) AS c, sum(x.value * b.q) AS q FROM cell x JOIN bin b ON b.fs = x.fs AND b.k = x.k GROUP BY ALL),
p AS (SELECT z.recording_id, z.channel_id, z.fs, z.f, ((z.c - l.m * e.c) * (z.c - l.m * e.c) + (z.q - l.m * e.q) * (z.q - l.m * e.q)) * 2.0 / (z.w * z.w) AS power
  FROM z JOIN level l ON l.recording_id = z.recording_id AND l.channel_id = z.channel_id AND l.t = z.t JOIN flat e ON e.fs = z.fs AND e.f = z.f)
SELECT recording_id AS trial_id, channel_id, f AS freq_id, {big_sql('avg(power)')} AS power, fs AS samplerate FROM p GROUP BY recording_id, channel_id, f, fs"""


def _powers(df: DataFrame) -> DataFrame:
    return df.groupBy("trial_id", "channel_id", "freq_id").agg(big(F.avg("re")).alias("power"))


@query(f"WITH {_WINDOWS}")
def q5_mtmconvol(spark, sf):
    return by_rate(spark, sf, lambda rate: _powers(sp.freqanalysis.plain(recordings(spark, sf, rate, series=True), method="mtmconvol", t_ftimwin=2.0, toi=0.5, taper="hann").facts))


@query(f"WITH {_WINDOWS}".replace("AS freq_id,", "AS freq_id, 0 AS time_idx, 0 AS taper_id,").replace("AS power, fs", "AS re, fs"))
def q6_welch(spark, sf):
    def averaged(rate):
        x = sp.freqanalysis.plain(recordings(spark, sf, rate, series=True), method="welch", t_ftimwin=2.0, toi=0.5, taper="hann")
        return x.facts.select("trial_id", "time_idx", "taper_id", "freq_id", "channel_id", big("re").alias("re"))

    return by_rate(spark, sf, averaged)


def _transform_sql(scales: str, span: str, re: str, im: str, last: str) -> str:
    """Convolution of the 64 samples of each trial, less their mean, with one filter for each row of ``scales`` (freq_id, s); t is a tap's time."""
    return f"""WITH {EMB64}, x AS (SELECT trial_id, sample, value - avg(value) OVER (PARTITION BY trial_id) AS v FROM e), sc AS ({scales}),
tap AS (SELECT *, CAST(ceil({span} - 1e-9) AS INT) AS taps, {span} AS span FROM sc), tt AS (SELECT tap.*, j, (j - (span - 1) / 2) / 64 AS t, j - (taps - 1) // 2 AS lag FROM tap, LATERAL (SELECT unnest(range(0, taps)) AS j)),
k AS (SELECT * EXCLUDE (j, t, taps, span), {re} AS re, {im} AS im FROM tt WHERE abs(lag) < 64),
z AS (SELECT x.trial_id, x.sample + k.lag AS time_idx, k.* EXCLUDE (lag, re, im), sum(x.v * k.re) AS re, sum(x.v * k.im) AS im FROM x JOIN k ON x.sample + k.lag BETWEEN 0 AND 63 GROUP BY ALL)
{last}"""


_POWER = "SELECT trial_id, time_idx, freq_id, round(re * re + im * im, 6) AS power FROM z"


def _cells(x: Trials) -> DataFrame:
    return x.facts.select("trial_id", "time_idx", "freq_id", r("re", 6).alias("power"))


@query(_transform_sql("SELECT * FROM (SELECT unnest(range(0, 4)) AS freq_id, unnest([4, 8, 16, 24]) AS f), LATERAL (SELECT 1 / (f * 4 * pi() / (6 + sqrt(38))) AS s)", "10 * s * 64",
    "pow(pi(), -0.25) * (cos(6 * t / s) - exp(-18)) * exp(-0.5 * (t / s) * (t / s)) / (8 * pi() * s * 8)", "pow(pi(), -0.25) * sin(6 * t / s) * exp(-0.5 * (t / s) * (t / s)) / (8 * pi() * s * 8)", _POWER))
def q7_q8_wavelet(spark, sf):
    return _cells(sp.freqanalysis.plain(emb64(spark, sf), method="wavelet", foi=[4, 8, 16, 24]))


@query(_transform_sql("SELECT n - 1 - i AS freq_id, s0 * pow(2, i / 4.0) AS s FROM (SELECT s0, CAST(floor(4 * log2(1 / s0)) AS INT) + 1 AS n FROM (SELECT 2 / 64.0 * sqrt(2.5) / (2 * pi()) AS s0)), LATERAL (SELECT unnest(range(0, n)) AS i)", "10 * s * 64",
    "(1 - (t / s) * (t / s)) * exp(-0.5 * (t / s) * (t / s)) / sqrt(gamma(2.5)) / (8 * pi() * s * 8)", "0.0", _POWER))
def q9_wavelet_default_scales(spark, sf):
    return _cells(sp.freqanalysis.plain(emb64(spark, sf), method="wavelet", wavelet="Ricker"))


@query(_transform_sql("SELECT freq_id, f, o, 1.0 / (freq_id + 1) AS part, 3.0 * o / (5 * f) AS s FROM (SELECT unnest(range(0, 4)) AS freq_id, unnest([8, 12, 16, 20]) AS f), LATERAL (SELECT unnest(range(1, freq_id + 2)) AS o)", "10 * 3 * o * 64 / (2 * pi() * f)",
    "cos(2 * pi() * f * t) * exp(-0.5 * (t / s) * (t / s)) / (4 * pi() * sqrt(2 * pi() * 64) * s)", "sin(2 * pi() * f * t) * exp(-0.5 * (t / s) * (t / s)) / (4 * pi() * sqrt(2 * pi() * 64) * s)",
    "SELECT trial_id, time_idx, freq_id, round(exp(sum(part * ln(re * re + im * im))), 6) AS power FROM z GROUP BY trial_id, time_idx, freq_id"))
def q11_superlet(spark, sf):
    return _cells(sp.freqanalysis.plain(emb64(spark, sf), method="superlet", foi=[8, 12, 16, 20], order_max=4, adaptive=True))


@query()
def q12_fitted_spectra(spark, sf):
    return sp.freqanalysis.plain(emb64(spark, sf), output="fooof", foilim=[1, 32], keeptrials=False).facts


@query(f"WITH {_DFT}, u AS (SELECT *, re / sqrt(re * re + im * im) AS a, im / sqrt(re * re + im * im) AS b FROM z WHERE freq_id BETWEEN 1 AND 3) SELECT freq_id, channel_id, round(sqrt(avg(a) * avg(a) + avg(b) * avg(b)), 6) AS itc FROM u GROUP BY freq_id, channel_id")
def a8_itc(spark, sf):
    x = emb8(spark, sf)
    spec = Trials("spectral", _dft8(spark, sf).where("freq_id BETWEEN 1 AND 3"), x.trials, 8.0, {"channel": x.labels["channel"], "freq": [0.0, 1.0, 2.0, 3.0, 4.0], "taper": ["taper1"]})
    return st.itc.plain(spec).facts.select("freq_id", "channel_id", r("re", 6).alias("itc"))


# --- connectivity (C) ----------------------------------------------------------------------------------------------

_CSD = f"{_DFT}, s AS (SELECT a.trial_id, a.freq_id, a.channel_id AS channel_i, b.channel_id AS channel_j, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM z a JOIN z b ON a.trial_id = b.trial_id AND a.freq_id = b.freq_id), c AS (SELECT freq_id, channel_i, channel_j, avg(re) AS re, avg(im) AS im FROM s GROUP BY ALL)"


@query(f"WITH {_CSD} SELECT trial_id, freq_id, channel_i, channel_j, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM s")
def c1_c2_cross_spectra(spark, sf):
    s = co.cross_spectra(_dft8(spark, sf))
    return s.select("trial_id", "freq_id", "channel_i", "channel_j", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"))


def _spec8(spark, sf) -> Trials:
    x = emb8(spark, sf)
    return Trials("spectral", _dft8(spark, sf), x.trials, 8.0, {"channel": x.labels["channel"], "freq": [0.0, 1.0, 2.0, 3.0, 4.0], "taper": ["taper1"]})


@query(f"WITH {_CSD} SELECT freq_id, channel_i, channel_j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM c WHERE channel_i IN (0, 1) AND channel_j IN (2, 5)")
def c3_c8_csd_pairs(spark, sf):
    x = co.connectivityanalysis.plain(_spec8(spark, sf), method="csd", channelcmb=[[0, 1], ["channel3", "channel6"]])
    return x.facts.select("freq_id", "channel_i", "channel_j", (r("re", 6) + 0.0).alias("re"), (r("im", 6) + 0.0).alias("im"))


@query(f"WITH {_CSD} SELECT c.freq_id, c.channel_i, c.channel_j, round(sqrt(c.re * c.re + c.im * c.im) / sqrt(p.re * q.re), 6) AS coh FROM c JOIN c p ON p.freq_id = c.freq_id AND p.channel_i = c.channel_i AND p.channel_j = c.channel_i JOIN c q ON q.freq_id = c.freq_id AND q.channel_i = c.channel_j AND q.channel_j = c.channel_j")
def c4_coherence(spark, sf):
    x = co.connectivityanalysis.plain(_spec8(spark, sf), method="coh")
    return x.facts.select("freq_id", "channel_i", "channel_j", r("re", 6).alias("coh"))


@query(f"""WITH {_CSD}, u AS (SELECT *, sqrt(re * re + im * im) AS len FROM s WHERE freq_id BETWEEN 1 AND 3), v AS (SELECT freq_id, channel_i, channel_j, sum(re / len) AS a, sum(im / len) AS b, count(*) AS n FROM u GROUP BY ALL)
SELECT freq_id, channel_i, channel_j, round((a * a + b * b - n) / (n * (n - 1)), 6) + 0.0 AS ppc FROM v""")
def c5_ppc(spark, sf):
    x = co.connectivityanalysis.plain(_spec8(spark, sf), method="ppc")
    return x.facts.where("freq_id BETWEEN 1 AND 3").select("freq_id", "channel_i", "channel_j", (r("re", 6) + 0.0).alias("ppc"))


@query(f"""WITH {EMB8}, l AS (SELECT unnest(range(0, 4)) AS lag), d AS (SELECT trial_id, sample, channel_id, value - avg(value) OVER (PARTITION BY trial_id, channel_id) AS v FROM e),
s AS (SELECT trial_id, channel_id, stddev_pop(v) AS sd FROM d GROUP BY ALL),
k AS (SELECT a.trial_id, l.lag, a.channel_id AS channel_i, b.channel_id AS channel_j, sum(a.v * b.v) / (8 - l.lag) AS c FROM l JOIN d a ON true JOIN d b ON a.trial_id = b.trial_id AND a.sample = b.sample + l.lag GROUP BY a.trial_id, l.lag, a.channel_id, b.channel_id)
SELECT k.trial_id, lag, channel_i, channel_j, round(c / (p.sd * q.sd), 5) + 0.0 AS corr FROM k JOIN s p ON p.trial_id = k.trial_id AND p.channel_id = channel_i JOIN s q ON q.trial_id = k.trial_id AND q.channel_id = channel_j""")
def c7_correlation(spark, sf):
    x = co.connectivityanalysis.plain(emb8(spark, sf), method="corr", keeptrials=True, polyremoval=0)
    return x.facts.select("trial_id", F.col("time_idx").alias("lag"), "channel_i", "channel_j", (r("re", 5) + 0.0).alias("corr"))


@query(f"""WITH {EMB8}, l AS (SELECT unnest(range(0, 4)) AS lag), d AS (SELECT trial_id, sample, channel_id, value - avg(value) OVER (PARTITION BY trial_id, channel_id) AS v FROM e)
SELECT a.trial_id, l.lag, a.channel_id AS channel_i, b.channel_id AS channel_j, round(sum(a.v * b.v) / (8 - l.lag), 5) + 0.0 AS cov FROM l JOIN d a ON true JOIN d b ON a.trial_id = b.trial_id AND a.sample = b.sample + l.lag GROUP BY a.trial_id, l.lag, a.channel_id, b.channel_id""")
def c7_covariance_by_join(spark, sf):
    x = pp.detrended(emb8(spark, sf).facts, ["trial_id", "channel_id"], 0)
    return co.lag_correlation(x, ["trial_id"], 8, normed=False).select("trial_id", "lag", "channel_i", "channel_j", (r("value", 5) + 0.0).alias("cov"))


@query()
def c6_granger(spark, sf):
    return co.connectivityanalysis.plain(emb8(spark, sf), method="granger", tapsmofrq=1.0).facts


@query(f"""WITH {_CSD}, t AS (SELECT freq_id, channel_i, channel_j, sum(re) AS re, sum(im) AS im, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT s.trial_id, s.freq_id, s.channel_i, s.channel_j, (t.re - s.re) / (n - 1) AS re, (t.im - s.im) / (n - 1) AS im, n FROM s JOIN t ON s.freq_id = t.freq_id AND s.channel_i = t.channel_i AND s.channel_j = t.channel_j),
k AS (SELECT w.trial_id, w.freq_id, w.channel_i, w.channel_j, w.n, sqrt(w.re * w.re + w.im * w.im) / sqrt(p.re * q.re) AS v FROM w JOIN w p ON p.trial_id = w.trial_id AND p.freq_id = w.freq_id AND p.channel_i = w.channel_i AND p.channel_j = w.channel_i JOIN w q ON q.trial_id = w.trial_id AND q.freq_id = w.freq_id AND q.channel_i = w.channel_j AND q.channel_j = w.channel_j WHERE w.channel_i < w.channel_j)
SELECT freq_id, channel_i, channel_j, round((max(n) - 1) * max(n) * var_pop(v), 3) AS var FROM k GROUP BY ALL""")
def c9_jackknife_coherence(spark, sf):
    x = co.connectivityanalysis.plain(_spec8(spark, sf), method="coh", jackknife=True)
    return x.extras["jack_var"].where("channel_i < channel_j").select("freq_id", "channel_i", "channel_j", r("jack_var", 3).alias("var"))


# --- tables for plots (V) ------------------------------------------------------------------------------------------


@query(f"WITH {EMB8} SELECT channel_id AS panel, 'channel' || (channel_id + 1) AS series, (sample - 2) / 8.0 AS x, round(value, 6) AS y FROM e WHERE trial_id = 0")
def v1_v2_panels(spark, sf):
    return plots.panels(emb8(spark, sf)).select("panel", "series", "x", r("y", 6).alias("y"))


@query(f"WITH {SPIKES}, {SPANS} SELECT t.trial_id, round((k.sample - t.start + t.t0) / 40.0, 6) AS x, k.unit AS y FROM spk k JOIN sp t ON k.sample >= t.start AND k.sample < t.stop")
def v3_raster(spark, sf):
    return plots.raster(spikes(spark, sf)).select("trial_id", r("x", 6).alias("x"), "y")


@query(f"WITH {SPIKES}, {RATED} SELECT t.trial_id, t.samplerate, round((k.sample - t.start + t.t0) / t.samplerate, 6) AS x, k.unit AS y FROM spk k JOIN sp t ON k.sample >= t.start AND k.sample < t.stop")
def v3_raster_rates(spark, sf):
    return by_rate(spark, sf, lambda rate: plots.raster(spikes(spark, sf, rate)).select("trial_id", r("x", 6).alias("x"), "y"))
