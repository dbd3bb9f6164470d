"""Spectra of analog trials: tapered Fourier transforms, sliding windows, wavelets, superlets, parametrised spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, choice, ineffective, log
from trialloom.frontend import frontend
from trialloom.kernels import spectra, wavelets
from trialloom.kernels.windows import slepian_options
from trialloom.model import Trials, restack, to_blocks
from trialloom.operators.selection import best_match

METHODS = ("mtmfft", "mtmconvol", "welch", "wavelet", "superlet")
OUTPUTS = ("pow", "abs", "fourier", "complex", "real", "imag", "angle", "absreal", "absimag")
FITTED = ("fooof", "fooof_aperiodic", "fooof_peaks")
SPECTRAL = "trial_id int, time_idx int, taper_id int, freq_id int, channel_id int, re double, im double"


def converted(re: Column, im: Column, output: str) -> Column:
    """A real output of a complex value."""
    return {
        "pow": lambda: re * re + im * im, "abs": lambda: F.hypot(re, im), "real": lambda: re, "imag": lambda: im, "angle": lambda: F.atan2(im, re),
        "absreal": lambda: F.abs(re), "absimag": lambda: F.abs(im),
    }[output]()


def dft(facts: DataFrame, keys: list[str], n: int, sample: str, value: str, bins: list[int] | None = None) -> DataFrame:
    """Fourier sums as an aggregation: (keys, freq_id, re, im) of series of ``n`` samples, norm sqrt(2)/n.

    The phases are part of the plan, partial sums are combined before the
    shuffle; for short series.
    """
    k = F.explode(F.array(*[F.lit(b) for b in (bins if bins is not None else range(n // 2 + 1))]))
    phase = F.lit(2 * np.pi) * ((F.col("freq_id") * F.col(sample)) % n) / n
    scale = np.sqrt(2) / n
    each = facts.select(*keys, sample, value, k.alias("freq_id"))
    return each.groupBy(*keys, "freq_id").agg((F.sum(F.col(value) * F.cos(phase)) * scale).alias("re"), (-F.sum(F.col(value) * F.sin(phase)) * scale).alias("im"))


AS_REAL = {
    "pow": lambda z: z.real**2 + z.imag**2, "abs": np.abs, "real": np.real, "imag": np.imag, "angle": np.angle, "absreal": lambda z: np.abs(z.real), "absimag": lambda z: np.abs(z.imag),
}


def _map_blocks(data: Trials, kernel, output: str, average: bool, over_trials: bool = False) -> DataFrame:
    """``kernel`` takes (series x time) and each series' trial start, and gives complex (series, time, taper, frequency).

    The output is made and tapers are averaged in the worker, before values
    become rows.  ``over_trials`` adds the trials of a channel up there, too, so
    that only sums of batches become rows; the result is their mean, as trial 0.
    """
    t0 = data.trials.select("trial_id", F.col("t0").alias("t0_"))
    blocks = to_blocks(data.facts, ["trial_id", "channel_id"], "sample", "value").join(t0, "trial_id")
    parts = ("re",) if output in AS_REAL else ("re", "im")

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(n=pdf["samples"].map(len))
            for (_, start), g in pdf.groupby(["n", "t0_"], sort=False):
                z = kernel(np.stack(g["samples"].to_numpy()).astype(float), float(start))
                if output in AS_REAL:
                    z = AS_REAL[output](z)
                    z = z.mean(axis=2, keepdims=True) if average else z
                s, t, k, f = z.shape
                flat = z.reshape(s, -1)
                if over_trials:
                    ids, of = np.unique(g["channel_id"], return_inverse=True)
                    sums = np.zeros((len(ids), flat.shape[1]), flat.dtype)
                    np.add.at(sums, of, flat)
                    yield pd.DataFrame({"trial_id": np.bincount(of), "channel_id": ids, "nk": k, "nf": f, "re": list(sums.real), **({"im": list(sums.imag)} if len(parts) > 1 else {})})
                    continue
                yield pd.DataFrame({"trial_id": g["trial_id"], "channel_id": g["channel_id"], "nk": k, "nf": f, "re": list(flat.real), **({"im": list(flat.imag)} if len(parts) > 1 else {})})

    z = blocks.mapInPandas(run, "trial_id int, channel_id int, nk int, nf int, " + ", ".join(f"{c} array<double>" for c in parts))
    if len(parts) == 1:
        long = z.select("trial_id", "channel_id", "nk", "nf", F.posexplode("re").alias("p", "re"))
        values = ["re"]
    else:
        long = z.select("trial_id", "channel_id", "nk", "nf", F.posexplode(F.arrays_zip("re", "im")).alias("p", "z"))
        values = [F.col("z.re").alias("re"), F.col("z.im").alias("im")]
    out = long.select(
        "trial_id", F.expr("p div (nk * nf)").cast("int").alias("time_idx"), F.expr("(p div nf) % nk").cast("int").alias("taper_id"), (F.col("p") % F.col("nf")).cast("int").alias("freq_id"),
        "channel_id", *values,
    )
    if not over_trials:
        return out
    cell = ["time_idx", "taper_id", "freq_id", "channel_id"]
    sums = out.groupBy(*cell).agg(*[(F.sum(c) / F.sum("trial_id")).alias(c) for c in parts])  # trial_id holds how many trials a sum has
    return sums.select(F.lit(0).alias("trial_id"), *cell, *parts)


def pick_frequencies(freqs: np.ndarray, foi=None, foilim=None) -> np.ndarray:
    """Positions of the bins nearest to ``foi`` without repetition, or within the closed range ``foilim``."""
    if foi is not None and foilim is not None:
        raise ParameterError("foi or foilim, not both")
    if foi is not None:
        foi = np.sort(np.atleast_1d(np.asarray(foi, float)))
        if len(foi) == 0 or foi[0] < 0 or foi[-1] > freqs[-1] + 1e-9:
            raise ParameterError(f"foi must lie from 0 to {freqs[-1]} Hz")
        return best_match(freqs, foi, squash_duplicates=True)[1]
    if foilim is not None and not (isinstance(foilim, str) and foilim == "all"):
        lo, hi = foilim
        if not 0 <= lo <= hi <= freqs[-1] + 1e-9:
            raise ParameterError(f"foilim must be [low, high] from 0 to {freqs[-1]} Hz")
        at = best_match(freqs, [lo, hi], span=True)[1]
        if not len(at):
            raise ParameterError("no frequency in the range")
        return at
    return np.arange(len(freqs))


def mismatched_frequencies(spec: Trials) -> Trials:
    """The object, with the trials whose frequency bins differ from the first trial's named in its info and in a warning."""
    bins = spec.facts.groupBy("trial_id").agg(F.array_sort(F.collect_set("freq_id")).alias("bins"))
    first = bins.agg(F.min_by("bins", "trial_id")).first()[0] or []
    other = [r[0] for r in bins.where(F.col("bins") != F.array(*[F.lit(b) for b in first])).select("trial_id").orderBy("trial_id").collect()]
    if not other:
        return spec
    note = f"the frequencies of {len(other)} trials differ from those of the first"
    log.warning("%s: %s", note, other[:20])
    return spec.having(note, info={**spec.info, "mismatched freq. axis trial ids": other})


def _taper(taper, taper_opt, tapsmofrq, n_taper, n, fs):
    if tapsmofrq is not None:
        if not tapsmofrq > 0:
            raise ParameterError("tapsmofrq must be positive")
        bandwidth = min(max(tapsmofrq, fs / n), fs / 2)
        return "dpss", slepian_options(bandwidth, n, fs, n_taper)
    if taper == "dpss":
        raise ParameterError("multitapers are set by tapsmofrq")
    return taper, dict(taper_opt or {})


@frontend
def freqanalysis(data: Trials, method: str = "mtmfft", output: str = "pow", keeptrials: bool = True, foi=None, foilim=None, pad="maxperlen", polyremoval: int | None = 0, taper: str | None = "hann", demean_taper: bool = False, taper_opt=None, tapsmofrq=None, nTaper=None, keeptapers: bool = False, toi="all", t_ftimwin=None, wavelet: str = "Morlet", width: float = 6, order=None, order_max=None, order_min: int = 1, c_1: float = 3, adaptive: bool = False, fooof_opt=None, ft_compat: bool = False) -> Trials:
    """(Time-)frequency analysis of analog trials.

    Every trial and channel is one block that a NumPy kernel transforms;
    selections, channels and trials are pruned before.  Powers of several tapers
    are averaged unless ``keeptapers``.  With ``keeptrials`` off the results
    are averaged over trials, which must have equal shapes.
    """
    choice(method, "method", METHODS)
    choice(output, "output", OUTPUTS + FITTED)
    if data.kind != "analog":
        raise DataError("spectra are of analog data")
    if polyremoval is not None:
        choice(polyremoval, "polyremoval", (0, 1))
    given = dict(t_ftimwin=t_ftimwin, order=order, order_max=order_max, tapsmofrq=tapsmofrq, nTaper=nTaper, taper_opt=taper_opt)
    used = {"mtmfft": {"tapsmofrq", "nTaper", "taper_opt"}, "mtmconvol": {"t_ftimwin", "tapsmofrq", "nTaper", "taper_opt"}, "welch": {"t_ftimwin", "tapsmofrq", "nTaper", "taper_opt"}, "wavelet": {"order"}, "superlet": {"order_max"}}
    ineffective(given, used[method], method)
    if output in FITTED:
        return _fitted(data, output, fooof_opt or {}, keeptrials, dict(foi=foi, foilim=foilim, pad=pad, polyremoval=polyremoval, taper=taper, taper_opt=taper_opt, tapsmofrq=tapsmofrq, nTaper=nTaper), method)
    if method == "welch":
        if output != "pow" or keeptapers:
            raise ParameterError("Welch's method gives powers, averaged over tapers")
        if isinstance(toi, str) or np.ndim(toi) != 0 or not 0 <= toi < 1:
            raise ParameterError("Welch's method needs the windows' overlap in [0, 1) as toi")
        spec = freqanalysis.plain(data, method="mtmconvol", foi=foi, foilim=foilim, polyremoval=polyremoval, taper=taper, taper_opt=taper_opt, tapsmofrq=tapsmofrq, nTaper=nTaper, toi=toi, t_ftimwin=t_ftimwin)
        from trialloom.operators.statistics import _statistic

        return _statistic(spec, "mean", "time", keeptrials)
    stats = data.trials.agg(F.max(F.col("stop") - F.col("start")).alias("top"), F.avg(F.col("stop") - F.col("start")).alias("mean")).first()
    if stats["top"] is None:
        raise DataError("there are no trials")
    longest, fs = int(stats["top"]), data.samplerate
    multi = tapsmofrq is not None
    if multi and output not in ("pow",) and not keeptapers and method in ("mtmfft", "mtmconvol"):
        raise ParameterError("several tapers are averaged as powers only; keep them for another output")
    times_per_trial = None
    if method == "mtmfft":
        total = spectra.padded_length(longest, pad, fs)
        name, opts = _taper(taper, taper_opt, tapsmofrq, nTaper, stats["mean"], fs)
        freqs = np.fft.rfftfreq(total, 1 / fs)
        at = pick_frequencies(freqs, foi, foilim)

        def kernel(x, _):
            n_opts = dict(opts)
            z, _f = spectra.mtmfft(x, fs, total, name, n_opts, polyremoval, demean_taper, ft_compat)
            return z[..., at][:, None]

        out_freqs, rate = freqs[at], None
    elif method == "mtmconvol":
        if t_ftimwin is None or not 1 / fs < t_ftimwin <= longest / fs + 1e-9:
            raise ParameterError("t_ftimwin must be the window's length in seconds, at most that of the trials")
        nper = max(2, int(round(t_ftimwin * fs)))
        name, opts = _taper(taper, taper_opt, tapsmofrq, nTaper, nper, fs)
        freqs = np.fft.rfftfreq(nper, 1 / fs)
        at = pick_frequencies(freqs, foi, foilim)
        rate, centres = _windows(toi, nper, fs)

        def kernel(x, start):
            z, _f = spectra.sliding_fft(x, fs, nper, centres(x.shape[-1], start), name, opts, polyremoval)
            return z[..., at]

        out_freqs = freqs[at]
        times_per_trial = centres
    else:
        if foi is None and foilim is not None and not isinstance(foilim, str):
            foi = np.arange(foilim[0], foilim[1] + 1e-9, 1.0)
        rate, centres = _windows(toi, None, fs)
        if method == "wavelet":
            choice(wavelet, "wavelet", wavelets.WAVELETS)
            par = width if wavelet == "Morlet" else (order if order is not None else wavelets.WAVELETS[wavelet][1])
            if foi is None:
                scales = wavelets.default_scales(wavelet, longest, fs, par)
                out_freqs = 1 / wavelets.period_of(wavelet, scales, par)
            else:
                out_freqs = _positive(foi, fs)
                scales = wavelets.scale_of(wavelet, 1 / out_freqs, par)

            def transform(x):
                return wavelets.cwt(x, fs, scales, wavelet, par)

        else:
            if order_max is None or not 1 <= order_min <= order_max:
                raise ParameterError("superlets need 1 <= order_min <= order_max")
            out_freqs = _positive(foi, fs) if foi is not None else 1 / (2 * np.pi * wavelets.default_scales("Morlet", longest, fs, 6.0) * (6 + np.sqrt(38)) / (4 * np.pi) / (0.5))
            out_freqs = np.sort(out_freqs)

            def transform(x):
                return wavelets.superlet(x, fs, out_freqs, int(order_max), int(order_min), c_1, adaptive)

        def kernel(x, start):
            z = transform(spectra.detrend(x, polyremoval))
            return np.swapaxes(z, -1, -2)[:, np.asarray(centres(x.shape[-1], start))][:, :, None, :]

        times_per_trial = centres
    facts = _map_blocks(data, kernel, output, not keeptapers, over_trials=not keeptrials)
    n_tapers = len(spectra.tapers(name, nper if method == "mtmconvol" else longest, longest, opts)) if method in ("mtmfft", "mtmconvol") else 1
    names = [f"taper{i + 1}" for i in range(n_tapers if keeptapers or output in ("fourier", "complex") else 1)]
    trials, new_rate = _spectral_trials(data, times_per_trial, rate, toi)
    labels = {"channel": data.labels.get("channel", []), "freq": [float(f) for f in out_freqs], "taper": names}
    out = Trials("spectral", facts, trials, new_rate, labels, dict(data.info), dict(data.cfg), (*data.log, f"{method} {output}"))
    if not keeptrials:
        from trialloom.operators.statistics import check_equal_shapes, first_trial

        check_equal_shapes(out)
        out = out.having("mean over trials", trials=first_trial(out))
    return out


def _positive(foi, fs: float) -> np.ndarray:
    f = np.unique(np.atleast_1d(np.asarray(foi, float)))
    if not len(f) or f[0] <= 0 or f[-1] > fs / 2:
        raise ParameterError(f"foi must lie above 0 and up to {fs / 2} Hz")
    return f


def _windows(toi, nper: int | None, fs: float):
    """Rate of the result, and the centres (samples) for a trial of given length and start."""
    if isinstance(toi, str):
        if toi != "all":
            raise ParameterError("toi: 'all', an overlap in [0, 1) or times")
        return fs, lambda n, start: np.arange(n)
    if np.ndim(toi) == 0:
        if nper is None or not 0 <= toi < 1:
            raise ParameterError("toi: an overlap in [0, 1) needs windows")
        step = max(1, nper - int(toi * nper))
        return fs / step, lambda n, start: np.arange(0, n, step)
    times = np.asarray(toi, float)
    if times.ndim != 1 or not len(times) or (np.diff(times) <= 0).any():
        raise ParameterError("toi: times in ascending order")

    def centres(n, start):
        c = np.rint(times * fs - start).astype(int)
        if (c < 0).any() or (c >= n).any():
            raise ParameterError("toi: a time lies outside a trial")
        return c

    return (1 / np.diff(times).mean() if len(times) > 1 else fs), centres


def _spectral_trials(data: Trials, centres, rate, toi):
    """One time point per trial without windows; else as many as the trial has centres."""
    n = F.col("stop") - F.col("start")
    if centres is None:
        return restack(data.trials.select("trial_id", F.lit(0.0).alias("t0"), "info", F.lit(1).cast("long").alias("n"))).select("trial_id", "start", "stop", "t0", "info"), data.samplerate
    if isinstance(toi, str):
        return data.trials, data.samplerate
    if np.ndim(toi) == 0:
        step = round(data.samplerate / rate)
        count, t0 = F.ceil(n / step), F.col("t0") / step
    else:
        count, t0 = F.lit(len(toi)), F.lit(float(np.asarray(toi)[0]) * rate)
    return restack(data.trials.select("trial_id", t0.alias("t0"), "info", count.cast("long").alias("n"))).select("trial_id", "start", "stop", "t0", "info"), rate


def _fitted(data: Trials, output: str, opts: dict, keeptrials: bool, how: dict, method: str) -> Trials:
    if method != "mtmfft":
        raise ParameterError("spectra are fitted after mtmfft")
    power = freqanalysis.plain(data, output="pow", keeptrials=keeptrials, **how)
    freqs = np.array(power.labels["freq"])
    if freqs[0] <= 0:
        raise ParameterError("leave out the frequency 0 (foilim) to fit a spectrum")
    blocks = to_blocks(power.facts, ["trial_id", "channel_id"], "freq_id", "re")
    known = {k: opts[k] for k in ("max_peaks", "threshold", "least_height", "width") if k in opts}

    def run(batches):
        for pdf in batches:
            rows, fits = [], []
            for p in pdf["samples"]:
                (c, chi), peaks, flat, bumps, full = spectra.fit_peaks(freqs, np.asarray(p, float), **known)
                rows.append({"fooof": 10**full, "fooof_aperiodic": 10**flat, "fooof_peaks": bumps}[output])
                fits.append([c, chi, *np.ravel(peaks)])
            yield pd.DataFrame({"trial_id": pdf["trial_id"], "channel_id": pdf["channel_id"], "samples": rows, "fit": fits})

    fitted = blocks.mapInPandas(run, "trial_id int, channel_id int, samples array<double>, fit array<double>")
    facts = fitted.select("trial_id", F.lit(0).alias("time_idx"), F.lit(0).alias("taper_id"), "channel_id", F.posexplode("samples").alias("freq_id", "re")).select("trial_id", "time_idx", "taper_id", "freq_id", "channel_id", "re")
    peaks = fitted.select("trial_id", "channel_id", F.col("fit")[0].alias("offset"), F.col("fit")[1].alias("exponent"), F.slice("fit", 3, F.size("fit")).alias("peaks"))
    return power.having(output, facts=facts).register("fit", peaks)
