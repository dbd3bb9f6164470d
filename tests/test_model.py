import numpy as np
import pytest

from trialloom import model
from trialloom.errors import DataError, ParameterError, ParameterTypeError
from trialloom.frontend import defaults
from trialloom.operators import arithmetic, preprocess, selection, statistics
from trialloom.operators import connectivity as co
from trialloom.operators import spectral as sp
from trialloom.operators import trials as tr
from trialloom.sources import container, raw, synthetic


@pytest.fixture(scope="module")
def ramp(spark):
    """Three trials of 5 samples and 10 channels at 2 Hz from -0.5 s; value = sample + 1 + 15 channel + 100 trial."""
    return model.analog_from_arrays(spark, [np.add.outer(np.arange(1, 6), 15 * np.arange(10)) + 100.0 * k for k in range(3)], 2.0, t0=-1)


def test_selection_order_and_repetition(ramp):
    x = selection.selectdata(ramp, trials=[2, 0, 2], channel=["channel03", 0, 2])
    a = selection.show(x)
    assert len(a) == 3 and np.array_equal(a[0], a[2])
    assert np.array_equal(a[1], np.add.outer(np.arange(1, 6), [30, 0, 30]))
    assert x.labels["channel"] == ["channel03", "channel01", "channel03"]
    assert [tuple(r) for r in x.trials.select("start", "stop").orderBy("trial_id").collect()] == [(0, 5), (5, 10), (10, 15)]


def test_latency_is_closed_and_discards(ramp):
    x = selection.selectdata(ramp, latency=[0, 1], trials=[0])
    assert np.array_equal(selection.show(x)[:, 0], [2, 3, 4])
    assert x.trials.first()["t0"] == 0
    with pytest.raises(DataError):
        selection.selectdata(ramp, latency=[-5, 1])
    assert selection.analysis_window(ramp, "maxperiod") == (-0.5, 1.5)
    assert selection.analysis_window(ramp, "prestim") == (-0.5, 0.0)


@pytest.mark.parametrize("bad", [dict(trials=[9]), dict(trials=["a"]), dict(channel=["nobody"]), dict(channel=[11]), dict(channel=[]), dict(latency=[1, 0]), dict(latency="soon"), dict(unit=[0])])
def test_invalid_selections(ramp, bad):
    with pytest.raises((ParameterError, ParameterTypeError)):
        selection.selectdata(ramp, **bad)


def test_best_match():
    values, at = selection.best_match([3, 1, 2], [1.5, 9])
    assert values.tolist() == [2, 3] and at.tolist() == [2, 0]
    assert selection.best_match([1, 2, 3], [1, 1.1], squash_duplicates=True)[1].tolist() == [0]
    assert selection.best_match([1, 2, 3, 4], [2, 3], span=True)[1].tolist() == [1, 2]
    with pytest.raises(ParameterError):
        selection.best_match([1.0], [3.0], tol=1)


def test_frontend_convention(ramp):
    opts = defaults(selection.selectdata.plain)
    assert "trials" in opts and opts.trials is None
    a = selection.selectdata({"trials": [1]}, ramp)
    b = selection.selectdata(ramp, cfg={"trials": [1]}, parallel=True)
    assert a == b
    assert selection.selectdata(ramp, cfg=a.cfg) == a
    with pytest.raises(ParameterError):
        selection.selectdata(ramp, cfg={"trials": [1]}, trials=[2])
    m = statistics.mean(ramp, dim="time", select={"trials": [0, 1]})
    assert m.trials.count() == 2


def test_arithmetic(ramp):
    x = (3 - ramp) / 2
    assert np.allclose(selection.show(x, trials=[0])[0, 0], 1)
    assert np.allclose(selection.show(2 / ramp, trials=[0])[0, 0], 2)
    assert np.allclose(selection.show(ramp + np.arange(10), trials=[0])[0, 3], 1 + 45 + 3)
    assert (ramp + ramp) == ramp * 2 and (ramp != ramp * 2)
    for bad, kind in ((0, ParameterError), (float("inf"), ParameterError), ("x", ParameterTypeError), (np.ones(3), ParameterError)):
        with pytest.raises(kind):
            ramp / bad
    with pytest.raises(DataError):
        ramp + selection.selectdata(ramp, trials=[0])
    c = arithmetic.concat(ramp, ramp)
    assert len(c.labels["channel"]) == 20 and model.concat_trials([ramp, ramp]).trials.count() == 6


def test_statistics_skip_nan_on_axes_only(spark):
    a = np.random.default_rng(42).lognormal(2, 0.5, (4, 10, 3))
    a[0, 0, 0] = np.nan
    x = model.analog_from_arrays(spark, list(a), 1.0)
    for name, f in (("mean", np.nanmean), ("var", np.nanvar), ("std", np.nanstd), ("median", np.nanmedian)):
        got = selection.show(getattr(statistics, name)(x, dim="time"), trials=[0])
        assert np.allclose(got, f(a[0], axis=0)), name
    over = selection.show(statistics.mean(x, dim="trials"))
    assert np.isnan(over[0, 0]) and np.allclose(over[1:], a.mean(axis=0)[1:])
    with pytest.raises(NotImplementedError):
        statistics.median(x, dim="trials")
    with pytest.raises(DataError):
        statistics.mean(model.analog_from_arrays(spark, [np.ones((3, 1)), np.ones((4, 1))], 1.0), dim="trials")


def test_jackknife_identity(spark):
    a = np.random.default_rng(0).normal(size=(6, 4, 2))
    x = model.analog_from_arrays(spark, list(a), 1.0)
    reps = statistics.leave_one_out(x.facts, "trial_id", ["sample", "channel_id"], ["value"]).toPandas()
    assert np.isclose(reps.query("trial_id == 0 and sample == 1 and channel_id == 0").value.iloc[0], a[1:, 1, 0].mean())
    direct = statistics.mean(x, dim="trials").facts.select("sample", "channel_id", "value")
    j = statistics.bias_variance(spark.createDataFrame(reps), direct, ["sample", "channel_id"], ["value"]).toPandas()
    assert np.allclose(j.jack_bias, 0, atol=1e-12)
    assert np.allclose(np.sort(j.jack_var), np.sort(a.var(axis=0, ddof=1).ravel()))


def test_psth_rates_and_proportions(spark):
    s = synthetic.poisson_noise(spark, 4, 2000, 2, 3, 0.1, 1000.0, seed=42)
    rate = statistics.spike_psth(s, binsize=0.5, output="rate")
    count = statistics.spike_psth(s, binsize=0.5, output="spikecount")
    a, b = rate.facts.toPandas(), count.facts.toPandas()
    keys = ["trial_id", "channel_id", "sample"]
    assert np.allclose(a.sort_values(keys).value, b.sort_values(keys).value * rate.samplerate, equal_nan=True)
    p = statistics.spike_psth(s, binsize=0.5, output="proportion").facts.toPandas().groupby(["trial_id", "channel_id"]).value.sum()
    assert np.allclose(p[p > 0], 1)


def test_events_of_overlapping_trials(spark):
    facts = spark.createDataFrame([(1, 0), (5, 1), (12, 0), (99, 1)], "sample long, eventid int")
    x = model.Trials("event", facts, model.trial_table(spark, [(0, 6, 0), (4, 13, -2)]), 1.0)
    got = {(r["sample"], r["trial_id"]) for r in tr.assign(x).collect()}
    assert got == {(1, 0), (5, 1), (12, 1), (99, -1)}
    assert tr.assign(x, every=True).count() == 4
    empty = model.Trials("event", facts.limit(0), x.trials, 1.0)
    assert tr.assign(empty).count() == 0


def test_greedy_matcher(spark):
    ev = spark.createDataFrame([(5 * i, i % 2) for i in range(6)], "sample long, eventid int")
    got = tr.match_events(ev, 2.0, 1.0, pre=2, post=1, start=0, trigger=1).select("start", "stop").collect()
    assert got[0]["start"] == round(0 / 2) - 2 and len(got) == 3
    with pytest.raises(ParameterError):
        tr.match_events(ev, 1, 1, stop=1, pre=1, post=1)


def test_redefinition(ramp):
    x = tr.redefinetrial(ramp, toilim=[0, 1])
    assert np.array_equal(selection.show(x, trials=[0])[:, 0], [2, 3, 4])
    y = tr.redefinetrial(ramp, trl=[[2, 4, 0], [3, 7, 1]])
    assert np.array_equal(selection.show(y)[0][:, 0], [3, 4])
    with pytest.raises(ParameterError):
        tr.redefinetrial(ramp, trl=[[0, 1, 0]], minlength=1)
    with pytest.raises(ParameterError):
        tr.definetrial(ramp, [[3, 1, 0]])


def test_trials_cut_to_their_own_recordings(spark, tmp_path):
    from trialloom.plans import catalog

    rows = [(0, 1, -5, 20, -2.0), (1, 1, 90, 130, 0.0), (2, 2, 90, 130, 0.0), (3, 30, 10, 20, 1.0), (4, 30, 5, 5, 0.0)]
    spark.createDataFrame(rows + rows[:1], "trial_id int, recording_id int, start long, stop long, t0 double").write.parquet(f"{tmp_path}/trial.parquet")
    spark.createDataFrame([(1, 100), (2, 200), (30, 15)], "recording_id int, n_samples long").write.parquet(f"{tmp_path}/recording.parquet")
    got = {tuple(r) for r in catalog.queries()["ref_t5_clipped_recordings"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1, 0, 20, 3.0), (1, 1, 90, 100, 0.0), (2, 2, 90, 130, 0.0), (3, 30, 10, 15, 1.0)}


def test_spectra_and_filters_at_the_recordings_own_rates(spark, tmp_path):
    from trialloom.plans import catalog

    rates = {1: 20.0, 2: 40.0, 3: 50.0}
    spark.createDataFrame([(k, f, 400) for k, f in rates.items()], "recording_id int, samplerate double, n_samples long").write.parquet(f"{tmp_path}/recording.parquet")
    wave = [(k, 0, i, float(np.sin(2 * np.pi * 5 * i / f + 0.3))) for k, f in rates.items() for i in range(400)]
    spark.createDataFrame(wave, "recording_id int, channel_id int, sample int, value double").write.parquet(f"{tmp_path}/analog_long.parquet")
    q = catalog.queries()
    p = q["ref_q6_welch"](spark, str(tmp_path)).toPandas()
    assert p.loc[p.groupby("trial_id")["re"].idxmax(), "freq_id"].tolist() == [10, 10, 10]  # 5 Hz in bins of 0.5 Hz
    n = {x["trial_id"]: x["n"] for x in q["ref_f12_resampled"](spark, str(tmp_path)).collect()}
    assert n == {1: 500, 2: 250, 3: 200}
    kept = q["ref_f2_butterworth"](spark, str(tmp_path)).toPandas()["power"]
    assert len(kept) == 3 and (abs(kept - 0.5) < 0.06).all()


def test_save_and_load(ramp, tmp_path):
    x = ramp.register("note", ramp.trials)
    folder = container.save(x, str(tmp_path), "one")
    y = container.load(ramp.spark, folder, checksum=True)
    assert y == x and set(y.extras) == {"note"}
    with pytest.raises(DataError):
        container.save(x, str(tmp_path), "one")
    assert set(container.load(ramp.spark, str(tmp_path))) == {"one.analog"}


def test_raw_files(spark, tmp_path):
    for k in (2, 10):
        (tmp_path / f"ch{k}.sev").write_bytes(b"\0" * 40 + (np.arange(50, dtype="<f4") + k).tobytes())
    x = raw.load_raw(spark, str(tmp_path), 10.0)
    assert x.labels["channel"] == ["ch2", "ch10"] and selection.show(x)[3].tolist() == [5, 13]
    marks = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 1)], "time double, code int")
    y = raw.load_raw(spark, str(tmp_path), 10.0, marks, 1, 2)
    assert y.trials.count() == 1 and selection.show(y).shape == (10, 2)
    with pytest.raises(DataError):
        raw.load_foreign(spark, "unknown", "x")


def test_coherence_of_shifted_cosines(spark):
    rng = np.random.default_rng(0)
    t = np.arange(400) / 200
    a = [np.stack([np.cos(2 * np.pi * 40 * t + s) for s in (0, 1)], axis=1) + rng.normal(size=(400, 2)) for _ in range(30)]
    x = model.analog_from_arrays(spark, a, 200.0)
    c = co.connectivityanalysis(x, method="coh", tapsmofrq=2.0)
    p = c.facts.where("channel_i = 0 AND channel_j = 1").toPandas().set_index("freq_id").re
    f = np.array(c.labels["freq"])
    assert abs(f[p.idxmax()] - 40) < 5 and p.max() > 0.9 and p[f[p.index] > 80].max() < 0.4
    pair = co.phase_consistency_pairs
    single = co.cross_spectra(sp.freqanalysis.plain(x, output="fourier", taper=None, keeptapers=True, foilim=[38, 42]).facts)
    keys = ["time_idx", "freq_id", "channel_i", "channel_j"]
    one = co.phase_consistency(single, keys).toPandas().sort_values(keys).re.to_numpy()
    two = pair(single, keys).toPandas().sort_values(keys).re.to_numpy()
    assert np.allclose(one, two)


def test_preprocessing_and_resampling(spark):
    x = synthetic.white_noise(spark, 3, 500, 2, 200.0, seed=1)
    y = preprocess.preprocessing(x, filter_type="lp", freq=30)
    f = sp.freqanalysis(y, taper=None).facts.toPandas().groupby("freq_id").re.mean()
    assert f[f.index < 60].mean() > 20 * f[f.index > 125].mean()
    z = preprocess.preprocessing(x, filter_class=None, zscore=True)
    assert np.allclose(z.facts.toPandas().groupby(["trial_id", "channel_id"]).value.std(ddof=0), 1)
    assert preprocess.resampledata(x, 100.0).trials.first()["stop"] == 250
    with pytest.raises(ParameterError):
        preprocess.resampledata(x, 300.0)
    with pytest.raises(ParameterError):
        preprocess.preprocessing(x, freq=[1, 2], filter_type="lp")
    with pytest.raises(ParameterError):
        preprocess.preprocessing(x, freq=10, rectify=True, hilbert="abs")


def test_streaming(spark, tmp_path):
    from trialloom.streaming.windows import trials_from_stream, windowed_counts

    rows = [("a", 1, 0, "2024-01-01 00:00:01"), ("a", 9, 1, "2024-01-01 00:00:02"), ("b", 4, 0, "2024-01-01 00:00:03"), ("a", 12, 0, "2024-01-01 00:01:01"), ("a", 20, 1, "2024-01-01 00:01:05")]
    df = spark.createDataFrame(rows, "rec string, sample long, eventid int, t string").selectExpr("rec", "sample", "eventid", "cast(t as timestamp) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, s in (("trials", trials_from_stream(stream, "rec", 0, 1)), ("counts", windowed_counts(stream, "ts", ["rec"], "1 minute"))):
        q = s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {tuple(r) for r in spark.table("trials").collect()} == {("a", 1, 9), ("a", 12, 20)}


def test_user_kernels(ramp):
    from trialloom.functions import kernels

    half = kernels.register(kernels.TrialKernel("every_second", lambda x, step=2: x[::step], trials=lambda d: preprocess.resampled_trials(d.trials, 0.5)))
    assert np.array_equal(selection.show(half(ramp))[0][:, 0], [1, 3, 5])
    total = kernels.TrialKernel("total", lambda x: x.sum(axis=1, keepdims=True), channelwise=False, labels=lambda d: {"channel": ["sum"]})
    assert selection.show(total(ramp, keeptrials=False)).tolist() == [10 * (i + 1) + 15 * 45 + 1000 for i in range(5)]
    with pytest.raises(ParameterError):
        kernels.register(half)


def test_running_total(spark):
    from pyspark.sql import functions as F

    from trialloom.plans.tables import running_total

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v"))
    got = running_total(df, "k", "v", "upto", 64).toPandas().sort_values("k")
    assert got.upto.tolist() == list(range(0, 2000, 2))
