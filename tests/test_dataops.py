"""The data-processing operators against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.operators.drift import _pair, canonical_fields, field_changes, file_statistics, one_field, path_types, typed_table
from trialloom.operators.intervals import cover_and_gaps
from trialloom.operators.spikes import pack_readings, suspect_readings, unpack_readings
from trialloom.plans.tables import salted_rank


def brute_cover(rows):
    out = set()
    for key in {r[0] for r in rows}:
        iv = sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and b > a)
        merged = []
        for a, b in iv:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(key, "period", a, b) for a, b in merged}
        out |= {(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def test_cover_and_gaps(spark):
    rng = random.Random(3)
    rows = []
    for k in ("x", "y", None):
        for _ in range(200):
            a = rng.randrange(0, 5000)
            rows.append((k, a, a + rng.randrange(-3, 25)))
    rows += [("x", None, 3), ("x", 3, None), ("z", 5, 5), ("w", 1, 2), ("w", 2, 3)] + rows[:20]
    df = spark.createDataFrame(rows, "k string, a long, b long").withColumn("kind", F.lit("extra")).withColumn("pos", F.lit(1))
    for size in (7, 10**6):  # many buckets, and one
        got = {tuple(r) for r in cover_and_gaps(df, ["k"], "a", "b", size).select("k", "kind", "lo", "hi").collect()}
        assert got == brute_cover(rows)
    assert cover_and_gaps(df.limit(0), ["k"], "a", "b").count() == 0


def test_far_interval_leaves_the_buckets_even(spark, monkeypatch):
    from trialloom.operators import intervals

    written = []
    monkeypatch.setattr(intervals, "materialise", lambda df: written.append(df.persist()) or df)
    near = spark.range(20_000).select(F.lit("x").alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 2).alias("b"))
    rows = near.unionByName(spark.createDataFrame([("x", 10**15, 10**15 + 1)], "k string, a long, b long"))
    assert cover_and_gaps(rows, ["k"], "a", "b", 1000).count() == 20_001 + 20_000
    sizes = [r["count"] for r in written[1].groupBy("b").count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_packing_round_trip():
    s = np.array([5, 6, 7, 100, 3], np.int64)
    v = np.array([1.5, np.nan, np.inf, -0.0, 1e300])
    a, b = unpack_readings(pack_readings(s, v))
    assert np.array_equal(a, s) and np.array_equal(b, v, equal_nan=True)


def planted(spark, n=3000, ch=0, seed=0):
    rng = np.random.default_rng(seed)
    v = np.round((np.cumsum(rng.normal(size=n)) * 0.05 + rng.normal(size=n)) / 0.125) * 0.125
    truth = set()
    for at in (50, 700, 701, 2000):
        v[at] += 40
        truth.add(at)
    v[1000:1040] = v[1000]
    truth |= set(range(1000, 1040))
    v[2500], v[2600] = 5000.0, -np.inf
    truth |= {2500, 2600}
    rows = [(1, i, ch, float(x)) for i, x in enumerate(v)]
    return rows, truth


def meta(spark):
    rec = spark.createDataFrame([(1, 5000.0, 50.0)], "recording_id int, adc_range double, samplerate double").withColumn("utc_start_time", F.lit("2024-01-01 00:59:40").cast("timestamp"))
    lab = spark.createDataFrame([("channel", 0, "lfp00"), ("channel", 30, "temp_c"), ("unit", 0, "u")], "axis string, idx int, label string")
    return rec, lab


def test_suspect_readings(spark):
    rows, truth = planted(spark)
    rows += rows[100:200]  # delivered twice
    rows += [(1, 5000, 0, None), (1, 5001, 0, float("nan")), (None, 1, 0, 3.0), (1, None, 0, 3.0)]
    df = spark.createDataFrame(rows, "recording_id int, sample int, channel_id int, value double").withColumn("hour", F.lit(1)).withColumn("kind", F.lit("x"))
    rec, lab = meta(spark)
    got = {r["sample"] for r in suspect_readings(df, rec, lab).collect()}
    edges = {999, 1040}  # a neighbour may happen to have the stuck value
    assert got - edges == truth - edges
    assert suspect_readings(df.limit(0), rec, lab).count() == 0
    no_meta = {r["sample"] for r in suspect_readings(df, rec.limit(0), lab.limit(0)).collect()}
    assert 2600 in no_meta and 50 in no_meta


def test_stretches_over_block_borders(spark, monkeypatch):
    from trialloom.operators import spikes

    rows, truth = planted(spark)
    df = spark.createDataFrame(rows, "recording_id int, sample int, channel_id int, value double").repartition(5)
    monkeypatch.setattr(spikes, "BLOCK", 1024)
    monkeypatch.setattr(spikes, "HALO", 256)
    rec, lab = meta(spark)
    # the workers import the module anew; the border itself is tested on the arrays
    g = np.zeros(len(rows), np.int64)
    smp, val = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    found = set()
    for block in range(3):
        w = (smp >= block * 1024 - 256) & (smp < (block + 1) * 1024 + 256)
        cols = spikes._measure_blocks(g[w], np.array([1]), np.array([0]), np.array([block]), np.array([-5000.0]), np.array([5000.0]), np.array([0.0]), np.array([50.0]), smp[w], val[w], spikes.SpikeRule())
        kind, at, cnt = (np.concatenate(cols[i]) for i in (2, 3, 4))
        found |= set(at[(kind == spikes.STUCK) & (cnt >= 40)].tolist())
    assert set(range(1000, 1040)) <= found and found <= set(range(999, 1041))


def test_block_of_two_readings_sets_no_floor(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=5000) / 0.125) * 0.125
    v[[700, 1500, 3000]] = 20.0
    rows = [(1, i, 0, float(x)) for i, x in enumerate(v)] + [(1, 9000, 0, 0.0), (1, 9001, 0, 4.0)]  # a gap, then two readings in the next block
    df = spark.createDataFrame(rows, "recording_id int, sample int, channel_id int, value double")
    got = {r["sample"] for r in suspect_readings(df, *meta(spark)).where("reason = 'spike'").collect()}
    assert got == {700, 1500, 3000}


def brute_stuck(sample, level, rule):
    """Stuck readings by whole stretches of one source."""
    out, usual = set(), []
    for keys in ([level], [level >> 1, (level - 1) >> 1]):
        runs = [np.split(sample, np.flatnonzero(np.diff(k)) + 1) for k in keys]
        n = np.sort([len(x) for r in runs for x in r])
        usual.append(n[int(np.ceil(rule.usual * len(n))) - 1])
        out |= {int(i) for r in runs for x in r if len(x) > max(rule.stuck, rule.longer * usual[-1]) for i in x}
    return out, usual


def test_stretches_longer_than_what_a_block_sees(spark):
    from trialloom.operators.spikes import SpikeRule

    rng = np.random.default_rng(11)
    rows, want = [], set()
    for ch, usual, gap in ((0, 200, (0, 0)), (1, 200, (16_500, 17_600)), (2, 900, (30_000, 42_000))):
        level, stuck_at = [], 16_284  # 100 readings of the stuck stretch lie left of a block's border
        while len(level) < 160_000:
            if stuck_at and len(level) >= stuck_at - 2 * usual:
                level += [5] * (stuck_at - len(level)) + [0] * (usual * 25) + [5] * usual
                stuck_at = None
            level += [int(rng.choice([x for x in range(10) if not level or x != level[-1]]))] * int(rng.integers(usual // 2, usual))
        level = np.array(level[:160_000])
        there = np.ones(len(level), bool)
        there[gap[0] : gap[1]] = False  # missing readings end no stretch
        sample, level = np.flatnonzero(there), level[there]
        stuck, _ = brute_stuck(sample, level, SpikeRule())
        assert {16_284, 16_383, 16_384} <= stuck
        want |= {(ch, x) for x in stuck}
        rows.append(pd.DataFrame({"recording_id": 1, "sample": sample, "channel_id": ch, "value": level * 0.5}))
    df = spark.createDataFrame(pd.concat(rows)).repartition(5)
    got = {(r["channel_id"], r["sample"]) for r in suspect_readings(df, *meta(spark)).where("reason = 'stuck'").collect()}
    assert got == want


def sidecar(**info):
    return json.dumps({"data_dtype": info.pop("dt", "float32"), "info": info})


def test_field_changes(spark):
    rows = [
        (1, "r", "a.x", 1, sidecar(rate=5, tag="k1", note=None)),
        (2, "r", "b.x", 2, sidecar(rate=5, tag="k1", note=[], dt="<f4")),
        (3, "r", "c.x", 3, sidecar(rate=5, label="k1", note="n", extra={"deep": True})),
        (4, "r", "d.x", 4, '{"cut": '),
        (5, "r", "e.x", 5, sidecar(rate=5.0, label="k1", note="n", extra={"deep": None}, dt="int16")),
        (5, "r", "e.x", 5, sidecar(rate=5.0, label="k1", note="n", extra={"deep": None}, dt="int16")),
        (6, "q", "e.x", 5, sidecar(rate="s")), (7, "r", "e.y", 5, "[1]"), (8, "r", "e.y", 6, None), (9, None, None, None, sidecar(a=1)),
    ]
    df = spark.createDataFrame(rows, "file_id long, rig string, filename string, t int, payload string").withColumn("written_at", F.timestamp_seconds("t")).withColumn("path", F.lit("clash"))
    series = [F.col("rig"), F.regexp_extract("filename", r"\.([^.]*)$", 1)]
    want = {(3, "renamed", "info.tag", "info.label"), (3, "added", "", "info.extra.deep"), (5, "retyped", "info.rate", "info.rate"), (5, "retyped", "data", "data")}
    for per_range in (1, 1000):
        got = field_changes(df, "file_id", series, "written_at", "payload", per_range)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert field_changes(df.limit(0), "file_id", series, "written_at", "payload").count() == 0
    files = file_statistics(df, "file_id", series, "written_at", "payload")
    links = one_field(field_changes(df, "file_id", series, "written_at", "payload"), files)
    wide, failed = typed_table(files, canonical_fields(links, path_types(files)))
    t = wide.toPandas().set_index("key")
    assert sorted(t.index) == [1, 2, 3, 5, 6, 9]
    assert t.loc[1, "info__label"] == t.loc[3, "info__label"] == "k1" and t.loc[5, "info__rate"] == 5.0
    assert {(r["key"], r["path"], r["reason"]) for r in failed.collect()} == {(6, "info.rate", "cast")}


def brute_changes(files):
    """(key, change, old, new) of (series, time, key, payload) rows in plain Python, one series after another."""
    from trialloom.operators.drift import Sweep, path_values

    out, sweeps = set(), {}
    for series, _, key, payload in sorted(files, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        now = path_values(payload)
        if now is not None:
            found, later = sweeps.setdefault(series, Sweep(complete=True)).changes(now)
            assert not later
            out |= {(key, *x) for x in found}
    return out


def test_changes_over_many_ranges(spark):
    rng = random.Random(8)
    files = []
    for i in range(600):
        info = {}
        for name in "abcdefgh":
            if rng.random() < 0.8:
                info[name if rng.random() < 0.9 else name.upper() + "_"] = rng.choice([None, [], 3, 4, 2.5, "x", True])
        payload = json.dumps({"data_dtype": rng.choice(["float32", "<f4", "int16", None]), "info": info}) if rng.random() > 0.05 else "{"
        files.append(("hot" if i % 3 else f"s{i % 5}", None if i % 50 == 7 else rng.randrange(1000), i, payload))
    clash = [(1000, "hot", 5, sidecar(a=1)), (1000, "hot", 1, sidecar(a="s"))]
    df = spark.createDataFrame([(k, s, t, p) for s, t, k, p in files + files[:60]] + clash, "k long, series string, t int, payload string").withColumn("at", F.timestamp_seconds("t"))
    want = brute_changes([*files, ("hot", 1, 1000, sidecar(a="s"))])
    for per_range in (4, 100, 10**6):
        got = field_changes(df.repartition(6), "k", [F.col("series")], "at", "payload", per_range)
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_null_times_leave_the_ranges_even(spark, monkeypatch):
    from trialloom.operators import drift

    seen = []
    plain = drift._sweep_ranges
    monkeypatch.setattr(drift, "_sweep_ranges", lambda schema: seen.append(schema) or plain(schema))
    rows = spark.range(60_000).select("id", F.lit("r").alias("rig"), F.when(F.col("id") != 5, F.timestamp_seconds(F.col("id") % 977 + 1_700_000_000)).alias("at"), F.lit(sidecar(a=1)).alias("payload"))
    once = drift.records_once(rows, "id", [F.col("rig")], "at", "payload")
    sizes = [r["count"] for r in once.repartitionByRange(60, "series", "us", "key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 50
    assert field_changes(rows, "id", [F.col("rig")], "at", "payload", 1000).count() == 0 and seen


def test_renamed_paths_that_one_file_holds_stay_apart(spark):
    rows = [(1, "r", 1, sidecar(a=7)), (2, "r", 2, sidecar(b=7)), (3, "q", 1, sidecar(a=1, b=2)), (4, "p", 1, sidecar(x=7)), (5, "p", 2, sidecar(y=7)), (6, "p", 3, sidecar(y=8))]
    df = spark.createDataFrame(rows, "k long, rig string, t int, payload string").withColumn("at", F.timestamp_seconds("t"))
    files = file_statistics(df, "k", [F.col("rig")], "at", "payload")
    changes = field_changes(df, "k", [F.col("rig")], "at", "payload")
    assert {(r[0], r[1]) for r in one_field(changes, files).collect()} == {("info.x", "info.y")}
    # a field shared on purpose: the value that loses it is reported
    _, lost = typed_table(files, {"info.a": ("info.a", "bigint"), "info.b": ("info.a", "bigint"), "info.x": ("info.x", "bigint"), "info.y": ("info.x", "bigint"), "data_dtype": ("data_dtype", "string")})
    assert {(r["key"], r["path"], r["reason"]) for r in lost.collect()} == {(3, "info.b", "shared")}


def test_pairs_of_renames():
    gone = [dict(path="info.Trigger_code", type="array<integer>", value="1"), dict(path="a", type="integer", value="7")]
    new = [dict(path="info.triggerCode", type="array<integer>", value="2"), dict(path="b", type="integer", value="8")]
    assert [(x["path"], y["path"]) for x, y in _pair(gone, new)] == [("info.Trigger_code", "info.triggerCode")]


def test_salted_rank(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 300 + ["b"] * 3 + [None] * 2, "i": range(305), "w": [2] * 305}))
    r = salted_rank(df, ["g"], ["i"], "rank", 4).toPandas()
    for _, x in r.groupby("g", dropna=False):
        assert sorted(x["rank"]) == list(range(len(x)))
    w = salted_rank(df, ["g"], ["i"], "rank", 4, weight="w").toPandas()
    assert sorted(w[w.g == "a"]["rank"]) == list(range(0, 600, 2))
