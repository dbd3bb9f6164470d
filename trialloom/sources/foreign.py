"""Importers of files of other programs: MAT structures and NWB files, where their libraries are installed.

Signals are read in pieces of ``PIECE`` samples that tasks fetch for
themselves, so no file has to fit on the driver; the files must lie where the
workers can open them.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, log
from trialloom.model import TRIAL_SCHEMA, Trials, analog_from_arrays, default_labels, trial_table

PIECE = 1 << 16


def signal(spark: SparkSession, n_samples: int, fetch: Callable[[int, int], np.ndarray], piece: int = PIECE) -> DataFrame:
    """(sample, channel_id, value) of a signal of which ``fetch(first, last)`` gives a (sample x channel) part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in pdf["id"]:
                part = np.asarray(fetch(int(a), min(n_samples, int(a) + piece)), float)
                part = part[:, None] if part.ndim == 1 else part
                n, c = part.shape
                yield pd.DataFrame({"sample": np.repeat(np.arange(a, a + n), c), "channel_id": np.tile(np.arange(c, dtype=np.int32), n), "value": part.ravel()})

    return spark.range(0, n_samples, piece).mapInPandas(run, "sample long, channel_id int, value double")


# --- MAT: raw-data structures ---------------------------------------------------------------------------------------


def _legacy(path: str) -> dict:
    from scipy.io import loadmat

    return loadmat(path, simplify_cells=True)


def _hdf(path: str) -> dict:
    """Version 7.3 files as nested dicts; texts and cells are resolved."""
    import h5py

    def value(x, of):
        if isinstance(x, h5py.Group):
            return {k: value(v, of) for k, v in x.items()}
        a = x[()]
        if x.dtype == h5py.ref_dtype:
            return [value(of[r], of) for r in np.ravel(a, order="F")]
        if x.attrs.get("MATLAB_class") == b"char":
            return "".join(map(chr, np.ravel(a, order="F")))
        return np.asarray(a).T

    with h5py.File(path, "r") as f:
        return {k: value(v, f) for k, v in f.items() if k != "#refs#"}


def mat_contents(path: str) -> dict:
    """Variables of a MAT file of either format, told apart by its first bytes."""
    with open(path, "rb") as f:
        head = f.read(128)
    return _hdf(path) if b"MATLAB 7.3" in head or head[:8] == b"\x89HDF\r\n\x1a\n" else _legacy(path)


def load_mat(spark: SparkSession, path: str, list_only: bool = False, select_structures: list[str] | None = None, include_fields: list[str] | None = None, contents: Callable[[str], dict] = mat_contents):
    """Objects of all structures of a file that hold trials, by name; with ``list_only`` their names.

    A structure has ``trial`` (channel x time, one for each trial), ``time``,
    ``label`` and perhaps ``fsample``, else the rate follows from the times.
    ``include_fields`` names further fields that are kept as info.
    """
    found = {k: v for k, v in contents(path).items() if isinstance(v, dict) and {"trial", "time", "label"} <= v.keys()}
    if list_only:
        return sorted(found)
    missing = set(select_structures or []) - found.keys()
    if missing or not found:
        raise DataError(f"{path} holds no structure {', '.join(sorted(missing)) or 'with trials'} (there are: {', '.join(sorted(found)) or 'none'})")
    return {name: _mat_object(spark, found[name], include_fields or []) for name in select_structures or sorted(found)}


def _many(x) -> list:
    if isinstance(x, np.ndarray) and x.dtype == object:
        return list(x.ravel())
    return list(x) if isinstance(x, (list, tuple)) else [x]


def _mat_object(spark: SparkSession, structure: dict, fields: list[str]) -> Trials:
    trials = [np.atleast_2d(np.asarray(t, float)) for t in _many(structure["trial"])]
    times = [np.ravel(np.asarray(t, float)) for t in _many(structure["time"])]
    labels = [str(x) for x in _many(structure["label"])]
    if len(times) != len(trials) or any(t.shape[1] != len(x) for t, x in zip(trials, times)):
        raise DataError("every trial needs its times, one for each sample")
    steps = np.concatenate([np.diff(t) for t in times]) if any(len(t) > 1 for t in times) else np.array([])
    rate = float(np.ravel(structure["fsample"])[0]) if "fsample" in structure else (1 / steps.mean() if len(steps) else None)
    if rate is None or (len(steps) and not np.allclose(steps, 1 / rate, rtol=1e-3)):
        raise DataError("the times of a structure are not evenly spaced")
    x = analog_from_arrays(spark, [t.T for t in trials], rate, labels)
    table, bounds = [], structure.get("sampleinfo")
    at = 0
    extra = np.atleast_2d(np.asarray(structure["trialinfo"], float)) if "trialinfo" in structure else np.zeros((len(trials), 0))
    extra = extra.T if extra.shape[0] != len(trials) else extra
    for k, (t, time) in enumerate(zip(trials, times)):
        first = int(np.atleast_2d(bounds)[k, 0]) - 1 if bounds is not None else at
        table.append((first, first + t.shape[1], round(float(time[0]) * rate) if len(time) else 0.0, *extra[k]))
        at += t.shape[1]
    info = {f: structure[f] if isinstance(structure[f], (str, int, float)) else str(structure[f]) for f in fields if f in structure}
    return x.having("read from a MAT file", trials=trial_table(spark, table), info=info)


# --- NWB ------------------------------------------------------------------------------------------------------------


def load_nwb(spark: SparkSession, path: str, default_spike_data_samplerate: float | None = None, open_file: Callable | None = None) -> dict[str, Trials]:
    """Every electrical series (also of LFP containers), the TTL pulses and the units of a file, by name.

    Trials or, without any, epochs become the trials of all objects; their
    ``offset`` column, if there is one, the trials' offsets.  Series of one
    file need one start and one rate, if there are trials.
    """
    opened = open_file or _open_nwb
    with opened(path) as nwb:
        series, ttl = {}, {}
        for name, x in nwb.acquisition.items():
            kind = type(x).__name__
            if kind == "LFP":
                series.update(x.electrical_series)
            elif kind == "ElectricalSeries":
                series[name] = x
            elif "TTL" in kind:
                ttl[name] = x
            else:
                log.warning("%s: acquisition %s of type %s is not read", path, name, kind)
        starts, rates = {float(x.starting_time or 0) for x in series.values()}, {float(x.rate) for x in series.values() if x.rate}
        units = None if nwb.units is None else nwb.units.to_dataframe()
        spans = nwb.trials if nwb.trials is not None else nwb.epochs
        spans = None if spans is None else spans.to_dataframe()
        if spans is not None and (len(starts) > 1 or len(rates) > 1):
            raise DataError("series of a file with trials need one start and one sampling rate")
        rate = next(iter(rates), default_spike_data_samplerate)
        if rate is None and units is not None and "samplerate" in units.columns:
            rate = float(units["samplerate"].iloc[0])
        if rate is None:
            raise ParameterError("the file gives no sampling rate; name default_spike_data_samplerate")
        start = next(iter(starts), 0.0)
        table = None
        if spans is not None:
            offset = spans["offset"] * rate if "offset" in spans.columns else np.zeros(len(spans))
            table = [(int(a), int(b), float(int(t))) for a, b, t in zip((spans["start_time"] - start) * rate, (spans["stop_time"] - start) * rate, offset)]
        out: dict[str, Trials] = {}
        for name, x in series.items():
            out[name] = _nwb_series(spark, path, name, x, opened, table)
        if {"TTL_PulseValues", "TTL_Channels"} <= ttl.keys():
            out["ttl"] = _nwb_pulses(spark, ttl["TTL_PulseValues"], ttl["TTL_Channels"], start, table)
        if units is not None:
            rows = [(int(round(t * rate)), 0, int(u)) for u, times in zip(units.index, units["spike_times"]) for t in times]
            facts = spark.createDataFrame(pd.DataFrame(rows, columns=["sample", "channel", "unit"]).astype({"sample": "int64", "channel": "int32", "unit": "int32"}), "sample long, channel int, unit int")
            whole = table or [(0, max((r[0] for r in rows), default=0) + 1, 0.0)]
            out["units"] = Trials("spike", facts, trial_table(spark, whole), rate, {"unit": [f"unit{u}" for u in units.index]}, {"unit_codes": [int(u) for u in units.index], "channel_codes": [0]})
    return out


def _find_series(nwb, name: str):
    if name in nwb.acquisition:
        return nwb.acquisition[name]
    return next(x.electrical_series[name] for x in nwb.acquisition.values() if type(x).__name__ == "LFP" and name in x.electrical_series)


def _nwb_series(spark: SparkSession, path: str, name: str, x, opened, table) -> Trials:
    from trialloom.operators.trials import cut_recording

    n = int(x.data.shape[0])
    gain = np.ravel(np.asarray(x.channel_conversion, float)) if getattr(x, "channel_conversion", None) is not None else 1.0
    gain = gain * float(getattr(x, "conversion", 1.0) or 1.0)

    def fetch(a: int, b: int) -> np.ndarray:
        with opened(path) as nwb:
            part = np.asarray(_find_series(nwb, name).data[a:b], float)
        return (part[:, None] if part.ndim == 1 else part) * gain

    long = signal(spark, n, fetch)
    channels = int(x.data.shape[1]) if len(x.data.shape) > 1 else 1
    trials = trial_table(spark, table or [(0, n, 0.0)])
    facts = cut_recording(long, trials.select("trial_id", "start", "stop"), []).select("trial_id", "sample", "channel_id", "value")
    return Trials("analog", facts, trials, float(x.rate), {"channel": default_labels("channel", channels)})


def _nwb_pulses(spark: SparkSession, values, channels, start: float, table) -> Trials:
    step = float(getattr(channels, "resolution", None) or channels.timestamps__resolution)
    sample = ((np.asarray(channels.timestamps) - start) / step).astype("int64")
    pdf = pd.DataFrame({"sample": sample, "eventid": np.asarray(values.data).astype("int32"), "chans": np.asarray(channels.data).astype("int32")})
    facts = spark.createDataFrame(pdf, "sample long, eventid int, chans int")
    whole = table or ([(int(sample.min()), int(sample.max()), 0.0)] if len(sample) else [])
    trials = trial_table(spark, whole) if whole else spark.createDataFrame([], TRIAL_SCHEMA)
    return Trials("event", facts, trials, 1 / step, {})


class _open_nwb:
    def __init__(self, path: str):
        import pynwb

        self.io = pynwb.NWBHDF5IO(path, "r", load_namespaces=True)

    def __enter__(self):
        return self.io.read()

    def __exit__(self, *_):
        self.io.close()


def save_nwb(data: Trials, path: str, with_trialdefinition: bool = True) -> str:
    """One analog object as an NWB file; its trials are written as the trials table with their offsets.

    The file is written by the driver, a trial at a time.
    """
    if importlib.util.find_spec("pynwb") is None:
        raise DataError("pynwb is not installed")
    if data.kind != "analog":
        raise DataError("only analog data can be written")
    import datetime

    import pynwb

    rows = data.trials.orderBy("start").collect()
    nwb = pynwb.NWBFile("trials", os.path.basename(path), datetime.datetime.now(datetime.timezone.utc))
    signal_ = np.concatenate([data.array[r["trial_id"]] for r in rows])
    device = nwb.create_device("device")
    group = nwb.create_electrode_group("group", "electrodes", "unknown", device)
    for _ in range(signal_.shape[1]):
        nwb.add_electrode(group=group, location="unknown")
    region = nwb.create_electrode_table_region(list(range(signal_.shape[1])), "all")
    nwb.add_acquisition(pynwb.ecephys.ElectricalSeries("ElectricalSeries", signal_, region, starting_time=0.0, rate=data.samplerate))
    if with_trialdefinition:
        nwb.add_trial_column("offset", "offset of the trial in seconds")
        at = 0
        for r in rows:
            n = r["stop"] - r["start"]
            nwb.add_trial(start_time=at / data.samplerate, stop_time=(at + n) / data.samplerate, offset=r["t0"] / data.samplerate)
            at += n
    with pynwb.NWBHDF5IO(path, "w") as io:
        io.write(nwb)
    return path


# --- MNE --------------------------------------------------------------------------------------------------------------


def to_mne_raw(data: Trials):
    """One continuous trial as a RawArray."""
    mne = _mne()
    if data.trials.count() != 1:
        raise DataError("a continuous object has one trial")
    return mne.io.RawArray(next(iter(data.array)).T, mne.create_info(list(data.labels["channel"]), data.samplerate))


def to_mne_epochs(data: Trials):
    """Time-locked trials as an EpochsArray."""
    mne = _mne()
    if not data.is_time_locked():
        raise DataError("epochs need trials of one length and start")
    t0 = data.trials.first()["t0"] / data.samplerate
    return mne.EpochsArray(np.stack([a.T for a in data.array]), mne.create_info(list(data.labels["channel"]), data.samplerate), tmin=t0)


def from_mne_raw(spark: SparkSession, raw) -> Trials:
    return analog_from_arrays(spark, [raw.get_data().T], float(raw.info["sfreq"]), list(raw.ch_names), t0=0.0)


def from_mne_epochs(spark: SparkSession, epochs) -> Trials:
    rate = float(epochs.info["sfreq"])
    return analog_from_arrays(spark, [x.T for x in epochs.get_data()], rate, list(epochs.ch_names), t0=round(float(epochs.tmin) * rate))


def _mne():
    if importlib.util.find_spec("mne") is None:
        raise DataError("mne is not installed")
    import mne

    return mne
