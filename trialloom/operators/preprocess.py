"""Filtering, detrending, standardising, rectifying and resampling of analog trials.

What built-in expressions can say runs in the JVM; filters run as vectorised
kernels on block rows, one per trial and channel, without a shuffle of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, choice, scalar
from trialloom.frontend import frontend
from trialloom.kernels import filters, spectra
from trialloom.model import Trials, to_blocks, to_long

SERIES = ["trial_id", "channel_id"]


def detrended(facts: DataFrame, keys: list[str], order: int, sample: str = "sample", value: str = "value") -> DataFrame:
    """Mean (0) or least-squares line (1) of each series taken away; a NaN makes its series NaN.

    The sums are combined before the shuffle and joined back, so a long series
    needs no task of its own.
    """
    choice(order, "polyremoval", (0, 1))
    v, t = F.col(value), F.col(sample).cast("double")
    sums = [F.avg(v).alias("mv_")]
    if order == 1:
        sums += [F.avg(t).alias("mt_"), F.coalesce(F.try_divide(F.covar_pop(t, v), F.var_pop(t)), F.lit(0.0)).alias("slope_")]
    line = F.col("mv_") + (F.col("slope_") * (t - F.col("mt_")) if order == 1 else 0.0)
    return _with_stats(facts, keys, sums).withColumn(value, v - line).select(*facts.columns)


def _with_stats(facts: DataFrame, keys: list[str], stats: list) -> DataFrame:
    """Facts with statistics of their series; a null key is a key like others."""
    table = facts.groupBy(*keys).agg(*stats)
    names = [c for c in table.columns if c not in keys]
    a, b = facts.alias("a"), table.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select("a.*", *[F.col(f"b.{c}") for c in names])


def standardised(facts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(v - mean) / population standard deviation of each series; a constant series gives NaN."""
    met = _with_stats(facts, keys, [F.avg(value).alias("mv_"), F.stddev_pop(value).alias("sd_")])
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("mv_"), F.col("sd_")), F.lit(float("nan")))
    return met.withColumn(value, scaled).select(*facts.columns)


def rectified(facts: DataFrame, value: str = "value") -> DataFrame:
    return facts.withColumn(value, F.abs(value))


def downsampled(facts: DataFrame, step: int, sample: str = "sample") -> DataFrame:
    """Every ``step``-th sample from the first."""
    return facts.where(F.col(sample) % step == 0).withColumn(sample, (F.col(sample) / step).cast("int"))


def nan_trials(data: Trials) -> DataFrame:
    """(trial_id) of trials that hold a NaN."""
    return data.facts.groupBy("trial_id").agg(F.max(F.isnan("value")).alias("n")).where("n").select("trial_id")


def map_series(data: Trials, kernel, values: tuple[str, ...] = ("value",), ragged: bool = False) -> DataFrame:
    """A NumPy function of (series x time) arrays applied to block rows; series of equal length go together.

    It returns an array, or a tuple of them for ``values``; a ``ragged`` kernel
    takes and returns a list of series of any lengths.
    """
    blocks = to_blocks(data.facts, SERIES, "sample", "value")
    fields = ", ".join(f"{v} array<double>" for v in values)

    def run(batches):
        for pdf in batches:
            if ragged:
                rows = kernel([np.asarray(x, float) for x in pdf["samples"]]) if len(pdf) else []
                yield pd.DataFrame({"trial_id": pdf["trial_id"], "channel_id": pdf["channel_id"], values[0]: rows})
                continue
            n = pdf["samples"].map(len)
            for _, g in pdf.groupby(n, sort=False):
                x = np.stack(g["samples"].to_numpy()).astype(float)
                out = kernel(x)
                out = out if isinstance(out, tuple) else (out,)
                yield pd.DataFrame({"trial_id": g["trial_id"], "channel_id": g["channel_id"], **{v: list(o) for v, o in zip(values, out)}})

    mapped = blocks.mapInPandas(run, f"trial_id int, channel_id int, {fields}")
    if len(values) == 1:
        return to_long(mapped, SERIES, value=values[0], samples=values[0])
    zipped = mapped.select(*SERIES, F.posexplode(F.arrays_zip(*values)).alias("sample", "z"))
    return zipped.select(*SERIES, "sample", *[F.col(f"z.{v}").alias(v) for v in values])


@frontend
def preprocessing(data: Trials, filter_class: str | None = "but", filter_type: str = "lp", freq=None, order: int | None = None, direction: str = "twopass", window: str = "hamming", polyremoval: int | None = None, zscore: bool = False, rectify: bool = False, hilbert: str | None = None) -> Trials:
    """Standardise, then detrend and filter, then rectify or take the analytic signal.

    ``filter_class`` 'but' (Butterworth, order 4) or 'firws' (windowed sinc), or
    None; ``freq`` is one edge, or two for 'bp' and 'bs'.  ``info`` of the
    result cannot name trials with NaN without computing them; ``nan_trials``
    does.
    """
    if data.kind != "analog":
        raise DataError("preprocessing needs analog data")
    if rectify and hilbert:
        raise ParameterError("rectify or hilbert, not both")
    if hilbert:
        choice(hilbert, "hilbert", filters.HILBERT)
    facts = data.facts
    if zscore:
        facts = standardised(detrended(facts, SERIES, polyremoval) if polyremoval is not None else facts, SERIES)
    elif polyremoval is not None:
        facts = detrended(facts, SERIES, polyremoval)
    out = data.having("preprocessed", facts=facts)
    if filter_class:
        choice(filter_class, "filter_class", ("but", "firws"))
        choice(filter_type, "filter_type", filters.TYPES)
        nyquist = data.samplerate / 2
        edges = np.atleast_1d(np.asarray(freq if freq is not None else [], float))
        if len(edges) != (2 if filter_type in ("bp", "bs") else 1) or (edges <= 0).any() or (edges >= nyquist).any() or (np.diff(edges) <= 0).any():
            raise ParameterError(f"freq must lie between 0 and {nyquist} Hz, two ordered edges for bands")
        cut = edges if len(edges) > 1 else float(edges[0])
        if filter_class == "but":
            choice(direction, "direction", ("twopass", "onepass"))
            sos = filters.butterworth(int(scalar(order or 4, "order", 1, 20, True)), cut, filter_type, data.samplerate)
            out = out.having(facts=map_series(out, lambda rows: filters.butter_series(rows, sos, direction), ragged=True))
        else:
            choice(direction, "direction", ("twopass", "onepass", "onepass-minphase"))
            if order is None:
                shortest = data.trials.agg(F.min(F.col("stop") - F.col("start"))).first()[0]
                order = min(1000, int(shortest or 1))
            kernel = filters.sinc_kernel(window, int(order), np.asarray(cut) / data.samplerate, filter_type)
            out = out.having(facts=map_series(out, lambda x: filters.apply_kernel(x, kernel, direction)))
    if rectify:
        out = out.having(facts=rectified(out.facts))
    if hilbert:
        f = filters.HILBERT[hilbert]
        if hilbert == "complex":
            long = map_series(out, lambda x: (filters.analytic(x).real, filters.analytic(x).imag), ("re", "im"))
            out = out.having(facts=long.withColumnRenamed("re", "value"))
        else:
            out = out.having(facts=map_series(out, lambda x: f(filters.analytic(x))))
    return out


def resampled_trials(trials: DataFrame, ratio: float) -> DataFrame:
    """Starts and lengths times the ratio of rates, rounded up."""
    a, n = F.ceil(F.col("start") * ratio - 1e-9), F.ceil((F.col("stop") - F.col("start")) * ratio - 1e-9)
    return trials.select("trial_id", a.cast("long").alias("start"), (a + n).cast("long").alias("stop"), (F.col("t0") * ratio).alias("t0"), "info")


@frontend
def resampledata(data: Trials, resamplefs: float = 1.0, method: str = "resample", lpfreq: float | None = None, order: int | None = None) -> Trials:
    """A lower sampling rate: every n-th sample, or rational resampling with its own low-pass."""
    if data.kind != "analog":
        raise DataError("resampling needs analog data")
    choice(method, "method", ("resample", "downsample"))
    fs, new = data.samplerate, float(scalar(resamplefs, "resamplefs", 1.0, data.samplerate))
    if lpfreq is not None:
        scalar(lpfreq, "lpfreq", 0, fs / 2)
    out = data
    if method == "downsample":
        step = round(fs / new)
        if not math.isclose(step * new, fs, rel_tol=1e-9):
            raise ParameterError("downsampling needs an integer ratio of rates")
        if lpfreq is not None:
            out = preprocessing.plain(out, filter_class="firws", filter_type="lp", freq=lpfreq, order=order)
        facts = downsampled(out.facts, step)
    else:
        facts = map_series(out, lambda x: filters.resample(x, fs, new, lpfreq, order))
    return out.having(f"resampled to {new} Hz", facts=facts, trials=resampled_trials(data.trials, new / fs), samplerate=new)
