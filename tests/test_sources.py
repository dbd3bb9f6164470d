"""Importers, indexers, constructors, saving in place, validators."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom import errors
from trialloom.model import Trials, analog_from_arrays, make
from trialloom.operators.spectral import freqanalysis, mismatched_frequencies
from trialloom.operators.trials import definetrial, match_events, range_join
from trialloom.plans.tables import scratch_path
from trialloom.sources import container, foreign, raw


def arrays(n=3, samples=20, channels=2):
    rng = np.random.default_rng(0)
    return [rng.normal(size=(samples + k, channels)) for k in range(n)]


def test_indexers(spark):
    a = arrays()
    x = analog_from_arrays(spark, a, 10.0, t0=-5)
    assert len(x.array) == 3 and all(np.array_equal(p, q) for p, q in zip(x.array, a))
    assert np.allclose(x.time[1], (np.arange(21) - 5) / 10)
    with pytest.raises(IndexError):
        x.array[7]
    with pytest.raises(TypeError):
        x.array["0"]
    spec = freqanalysis.plain(x, output="fourier", pad="nextpow2")
    assert spec.array[2].shape == (1, 1, 17, 2) and np.iscomplexobj(spec.array[0])
    s = make(spark, spark.createDataFrame([(3, 0, 1), (12, 1, 1), (14, 0, 2)], "sample long, channel int, unit int"), 10.0, [(0, 10, 0), (10, 20, -2)], "spike")
    assert s.array[1].tolist() == [[12, 1, 1], [14, 0, 2]] and np.allclose(s.time[1], [0.0, 0.2])


def test_constructors(spark):
    a = arrays()
    x = make(spark, (v for v in a), 10.0)
    assert make(spark, [x, x]).trials.count() == 6 and make(spark, a[0], 10.0).trials.count() == 1
    y = make(spark, x.facts, 10.0)
    assert [r["stop"] - r["start"] for r in y.trials.orderBy("trial_id").collect()] == [20, 21, 22]
    cut = make(spark, [a[0]], 10.0, [(2, 6, 0), (10, 15, -1)])
    assert np.array_equal(cut.array[1], a[0][10:15])
    assert make(spark, None).trials.isEmpty() and make(spark, None, kind="spike").facts.isEmpty()
    for bad in ((a, None), (x.facts, None)):
        with pytest.raises(errors.DataError):
            make(spark, *bad)


def test_saved_in_place(spark):
    folder = scratch_path(spark, "test")
    x = analog_from_arrays(spark, arrays(), 10.0)
    with pytest.raises(errors.DataError):
        x.save()
    first = x.save(folder, "a")
    again = (first * 2).save()
    assert np.allclose(again.array[0], 2 * arrays()[0]) and np.allclose(make(spark, f"{folder}/a.analog").array[2], 2 * arrays()[2])
    assert container.load(spark, f"{folder}/a.analog", checksum=True).trials.count() == 3
    with pytest.raises(errors.DataError):
        x.save(folder, "a")
    container.clear(again)
    assert container.cleanup(spark, 1e6) == []


def index_record(kind, code, time, value=0.0, channel=0, rate=0.0):
    r = np.zeros(1, raw.INDEX)
    r["kind"], r["code"], r["time"], r["channel"], r["rate"] = kind, code if isinstance(code, int) else int.from_bytes(code.encode("cp437"), "little"), time, channel, rate
    r["value"] = value
    return r.tobytes()


def test_recording_block(spark, tmp_path):
    start = 1_700_000_000.0
    rows = [b"\0" * 40, index_record(raw.STROBE_ON, raw.START_BLOCK, start)]
    rows += [index_record(raw.STREAM, "LFPs", start + i / 10, channel=c, rate=100.0) for i in range(3) for c in (1, 2)]
    marks = [(0.1, 12), (0.5, 90), (1.0, 12), (1.4, 90), (1.8, 12)]
    rows += [index_record(raw.STROBE_ON, "Mark", start + t, c) for t, c in marks] + [index_record(raw.STROBE_OFF, "Mark", start + 0.2, 12)]
    rows += [index_record(raw.MARK, "PDio", start + 0.51, 1), index_record(0, raw.STOP_BLOCK, start + 2)]
    (tmp_path / "b.tsq").write_bytes(b"".join(rows))
    data = np.random.default_rng(0).normal(size=(2, 200)).astype("<f4")
    for c in range(2):
        (tmp_path / f"b_ch{c + 1}.sev").write_bytes(b"\0" * 40 + data[c].tobytes())
    info = raw.block_info(raw.block_index(spark, str(tmp_path)))
    assert info["duration"] == 2 and info["stores"]["LFPs"] == {"type": "streams", "rate": 100.0, "channels": 2, "records": 6} and info["stores"]["Mark"]["records"] == 5
    x = raw.load_block(spark, str(tmp_path), 12, 90)
    assert x.samplerate == 100 and len(x.array) == 2
    assert np.allclose(x.array[1], data[:, 100:140].T) and np.allclose(x.array[0], data[:, 10:50].T)
    assert [(round(r["time"], 2), r["sample"], r["code"]) for r in x.extras["onsets"].collect()] == [(0.51, 51, 1)]
    assert x.extras["triggers"].count() == 5
    (tmp_path / "c.tsq").write_bytes(b"\0" * 40)
    with pytest.raises(errors.DataError):
        raw.block_index(spark, str(tmp_path))


def test_mat_structures(spark):
    a = [x.T for x in arrays()]
    structure = {"trial": a, "time": [np.arange(x.shape[1]) / 50 - 0.1 for x in a], "label": ["u", "v"], "trialinfo": np.array([[7], [8], [9]]), "note": "n"}
    contents = {"first": structure, "second": structure | {"fsample": 50.0, "trial": a[:1], "time": structure["time"][:1], "trialinfo": np.array([[1]])}, "x": 3}
    read = lambda path: contents
    assert foreign.load_mat(spark, "p", list_only=True, contents=read) == ["first", "second"]
    found = foreign.load_mat(spark, "p", include_fields=["note"], contents=read)
    x = found["first"]
    assert round(x.samplerate, 6) == 50 and x.labels["channel"] == ["u", "v"] and x.info == {"note": "n"}
    assert np.array_equal(x.array[2], a[2].T) and [tuple(r)[3:] for r in x.trials.orderBy("trial_id").collect()] == [(-5.0, [7.0]), (-5.0, [8.0]), (-5.0, [9.0])]
    assert list(foreign.load_mat(spark, "p", select_structures=["second"], contents=read)) == ["second"]
    with pytest.raises(errors.DataError):
        foreign.load_mat(spark, "p", select_structures=["third"], contents=read)


class ElectricalSeries(SimpleNamespace):
    pass


class LFP(SimpleNamespace):
    pass


class TTLs(SimpleNamespace):
    pass


def opened(path):
    class Held:
        def __enter__(self):
            data = np.arange(2 * 300).reshape(300, 2)
            frame = pd.DataFrame({"start_time": [0.5, 1.5], "stop_time": [1.0, 2.0], "offset": [-0.1, 0.0]})
            units = pd.DataFrame({"spike_times": [[0.6, 1.7], [0.2]]}, index=[4, 6])
            series = ElectricalSeries(data=data, rate=100.0, starting_time=0.0, channel_conversion=None, conversion=2.0)
            pulses = {"TTL_PulseValues": TTLs(data=np.array([5, 6])), "TTL_Channels": TTLs(data=np.array([1, 2]), timestamps=np.array([0.6, 1.6]), resolution=0.01)}
            held = {"ElectricalSeries_a": series, "lfp": LFP(electrical_series={"b": series}), **pulses}
            return SimpleNamespace(acquisition=held, units=SimpleNamespace(to_dataframe=lambda: units), trials=SimpleNamespace(to_dataframe=lambda: frame), epochs=None)

        def __exit__(self, *_):
            pass

    return Held()


def test_nwb_objects(spark):
    found = foreign.load_nwb(spark, "f.nwb", open_file=opened)
    assert sorted(found) == ["ElectricalSeries_a", "b", "ttl", "units"]
    for name in ("ElectricalSeries_a", "b"):
        assert np.array_equal(found[name].array[1], 2.0 * np.arange(600).reshape(300, 2)[150:200])
        assert [r["t0"] for r in found[name].trials.orderBy("trial_id").collect()] == [-10.0, 0.0]
    assert sorted(map(tuple, found["units"].facts.collect())) == [(20, 0, 6), (60, 0, 4), (170, 0, 4)]
    assert sorted(map(tuple, found["ttl"].facts.collect())) == [(60, 5, 1), (160, 6, 2)] and found["ttl"].samplerate == 100
    for f in (foreign.to_mne_raw, foreign.to_mne_epochs, lambda x: foreign.save_nwb(x, "x")):
        with pytest.raises(errors.DataError):
            f(found["b"])


def test_mismatched_frequencies(spark, caplog):
    x = analog_from_arrays(spark, [np.ones((8, 1))] * 3, 8.0)
    spec = freqanalysis.plain(x)
    assert mismatched_frequencies(spec).info == spec.info
    cut = spec.having(facts=spec.facts.where("trial_id <> 1 OR freq_id < 3"))
    assert mismatched_frequencies(cut).info["mismatched freq. axis trial ids"] == [1]


def test_validators(spark):
    x = analog_from_arrays(spark, arrays(), 10.0)
    assert errors.data_object(x, kind=("analog", "spike"), empty=False) is x
    for bad in (dict(kind="spike"), dict(empty=True)):
        with pytest.raises(errors.DataError):
            errors.data_object(x, **bad)
    with pytest.raises(errors.ParameterTypeError):
        errors.data_object(3)
    assert errors.object_path("/a/b/c.analog") == {"folder": "/a", "container": "b", "basename": "c.analog", "tag": "c", "kind": "analog"}
    assert errors.object_path("/a/b")["container"] == "b"
    for bad in ("", "/"):
        with pytest.raises(errors.ParameterError):
            errors.object_path(bad)
    with pytest.raises(errors.ParameterTypeError):
        errors.object_path(3)


def test_range_join_of_unequal_spans(spark):
    rng = np.random.default_rng(4)
    spans = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 10**6, 300), np.r_[rng.integers(1, 50, 297), [10**6, 5000, 0]]))] + [(900, None, 5), (901, 5, None)]
    points = [(int(p),) for p in rng.integers(0, 10**6, 500)] + [(None,)]
    met = range_join(spark.createDataFrame(points, "at long"), "at", spark.createDataFrame(spans, "k int, start long, stop long"))
    want = sorted((p, k) for (p,) in points for k, a, b in spans if None not in (p, a, b) and a <= p < b)
    assert sorted((r["at"], r["k"]) for r in met.collect()) == want
    few = range_join(spark.createDataFrame(points, "at long"), "at", spark.createDataFrame(spans[:297], "k int, start long, stop long"))
    assert sorted((r["at"], r["k"]) for r in few.collect()) == sorted((p, k) for (p,) in points for k, a, b in spans[:297] if p is not None and a <= p < b)
    assert range_join(spark.createDataFrame(points, "at long"), "at", spark.createDataFrame([], "k int, start long, stop long")).count() == 0


def brute_match(events, start, trigger, stop):
    """(first, trigger, last) of events (sample, code) by looking through all of them each time."""
    events, free, out = sorted(events), [True] * len(events), []
    after = lambda c, i: next((k for k in range(i + 1, len(events)) if free[k] and events[k][1] == c), None)
    while True:
        i = after(start, -1)
        j = None if i is None else after(trigger, i)
        m = None if i is None else after(stop, i)
        if None in (i, j, m):
            return out
        out.append((events[i][0], events[j][0], events[m][0]))
        for k in (i, j, m):
            free[k] = False


def test_events_of_recordings_are_matched_by_themselves(spark):
    rng = np.random.default_rng(6)
    events = [(int(r), int(s), int(c)) for r, s, c in zip(rng.integers(0, 3, 600), rng.permutation(20_000)[:600], rng.choice([1, 2, 3, 9], 600))]
    df = spark.createDataFrame(events, "recording_id int, sample long, eventid int")
    got = match_events(df, 10.0, 10.0, start=1, trigger=2, stop=3, recording="recording_id").collect()
    for rec in range(3):
        want = brute_match([(s, c) for r, s, c in events if r == rec], 1, 2, 3)
        assert sorted((r["start"], r["stop"], r["t0"]) for r in got if r["recording_id"] == rec) == sorted((a, m, float(a - j)) for a, j, m in want)
    x = Trials("event", df, spark.createDataFrame([], "trial_id int, start long, stop long, t0 double, info array<double>"), 10.0)
    table = definetrial.plain(x, start=1, trigger=2, stop=3, recording="recording_id").trials
    ids = [r["trial_id"] for r in table.collect()]
    assert sorted(ids) == list(range(len(got))) and {r["r"] for r in table.select(F.col("info")[1].alias("r")).collect()} == {0.0, 1.0, 2.0}
