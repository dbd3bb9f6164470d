"""Relations between channels: cross spectra, coherence, phase consistency, correlation, directed influence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, choice
from trialloom.frontend import frontend
from trialloom.kernels import network, spectra
from trialloom.model import Trials, to_blocks
from trialloom.operators.selection import positions
from trialloom.operators.spectral import converted, freqanalysis
from trialloom.operators.statistics import bias_variance, leave_one_out
from trialloom.plans.tables import materialise

METHODS = ("csd", "coh", "ppc", "granger", "corr")
OUTPUTS = ("abs", "pow", "complex", "fourier", "angle", "real", "imag")
CELL = ["time_idx", "freq_id", "channel_i", "channel_j"]


def cross_spectra(spec: DataFrame, pairs: DataFrame | None = None, keys=("trial_id", "time_idx", "freq_id"), taper: str | None = "taper_id") -> DataFrame:
    """S_ij = mean over tapers of z_i conj(z_j): (keys, channel_i, channel_j, re, im).

    All spectra of one cell meet in one array, so each channel's value is
    shuffled once; pairs with i <= j are formed there and mirrored (Hermitian).
    With ``pairs`` (channel_i, channel_j) only those are formed.
    """
    keys = list(keys)
    group = [*keys, taper] if taper else keys
    z = F.array_sort(F.collect_list(F.struct(F.col("channel_id").alias("c"), "re", "im")))
    cells = spec.groupBy(*group).agg(z.alias("z"))
    each = cells.select(*group, F.explode("z").alias("a"), "z").select(*group, "a", F.explode(F.filter("z", lambda x: x["c"] >= F.col("a.c")) if pairs is None else F.col("z")).alias("b"))
    re = F.col("a.re") * F.col("b.re") + F.col("a.im") * F.col("b.im")
    im = F.col("a.im") * F.col("b.re") - F.col("a.re") * F.col("b.im")
    flat = each.select(*keys, F.col("a.c").alias("channel_i"), F.col("b.c").alias("channel_j"), re.alias("re"), im.alias("im"))
    if pairs is not None:
        flat = flat.join(pairs, ["channel_i", "channel_j"], "left_semi")
    if taper:
        flat = flat.groupBy(*keys, "channel_i", "channel_j").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return flat if pairs is not None else mirrored(flat, keys)


def mirrored(half: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "channel_i", "channel_j", "re", "im"]
    both = F.explode(F.when(F.col("channel_i") < F.col("channel_j"), F.array(F.struct(F.col("channel_i").alias("i"), F.col("channel_j").alias("j"), "im"), F.struct(F.col("channel_j").alias("i"), F.col("channel_i").alias("j"), (-F.col("im")).alias("im")))).otherwise(F.array(F.struct(F.col("channel_i").alias("i"), F.col("channel_j").alias("j"), "im"))))
    return half.select(*keys, "re", both.alias("x")).select(*keys, F.col("x.i").alias("channel_i"), F.col("x.j").alias("channel_j"), "re", F.col("x.im").alias("im")).select(*cols)


def coherency(csd: DataFrame, keys: list[str]) -> DataFrame:
    """S_ij / sqrt(S_ii S_jj)."""
    auto = csd.where("channel_i = channel_j").select(*keys, F.col("channel_i").alias("c"), F.col("re").alias("p"))
    a = auto.select(*keys, F.col("c").alias("channel_i"), F.col("p").alias("pi"))
    b = auto.select(*keys, F.col("c").alias("channel_j"), F.col("p").alias("pj"))
    norm = F.sqrt(F.col("pi") * F.col("pj"))
    return csd.join(a, [*keys, "channel_i"]).join(b, [*keys, "channel_j"]).select(*keys, "channel_i", "channel_j", F.try_divide("re", norm).alias("re"), F.try_divide("im", norm).alias("im"))


def phase_consistency(single: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over pairs of trials of the cosine of their phase difference, in one pass: (|sum u|^2 - n) / (n (n - 1)).

    A zero has phase 0, as in the pairwise form.
    """
    r = F.hypot("re", "im")
    ure, uim = F.when(r == 0, 1.0).otherwise(F.col("re") / r), F.when(r == 0, 0.0).otherwise(F.col("im") / r)
    sums = single.groupBy(*keys).agg(F.sum(ure).alias("a"), F.sum(uim).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.where("n > 1").select(*keys, ((F.col("a") ** 2 + F.col("b") ** 2 - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("re"))


def phase_consistency_pairs(single: DataFrame, keys: list[str], trial: str = "trial_id") -> DataFrame:
    """The same by its definition, a join of trials with later trials; for tests."""
    a = single.select(*keys, F.col(trial).alias("ta"), F.atan2("im", "re").alias("pa"))
    b = single.select(*keys, F.col(trial).alias("tb"), F.atan2("im", "re").alias("pb"))
    return a.join(b, keys).where("ta < tb").groupBy(*keys).agg(F.avg(F.cos(F.col("pa") - F.col("pb"))).alias("re"))


def lag_correlation(facts: DataFrame, keys: list[str], n: int, normed: bool = True) -> DataFrame:
    """(keys, lag, channel_i, channel_j, value): mean of x_i(t + lag) x_j(t) over the overlap, by a self-join on samples.

    Series of ``n`` samples each without trend; lags up to half of it.
    """
    lags = F.explode(F.array(*[F.lit(x) for x in range(n // 2 if n % 2 == 0 else n // 2 + 1)]))
    a = facts.select(*keys, F.col("channel_id").alias("channel_i"), "sample", F.col("value").alias("x"))
    b = facts.select(*keys, F.col("channel_id").alias("channel_j"), "sample", F.col("value").alias("y"), lags.alias("lag")).withColumn("sample", F.col("sample") + F.col("lag"))
    out = a.join(b, [*keys, "sample"]).groupBy(*keys, "lag", "channel_i", "channel_j").agg((F.sum(F.col("x") * F.col("y")) / (n - F.first("lag"))).alias("value"))
    if not normed:
        return out
    sd = facts.groupBy(*keys, "channel_id").agg(F.stddev_pop("value").alias("sd"))
    si = sd.select(*keys, F.col("channel_id").alias("channel_i"), F.col("sd").alias("si"))
    sj = sd.select(*keys, F.col("channel_id").alias("channel_j"), F.col("sd").alias("sj"))
    return out.join(si, [*keys, "channel_i"]).join(sj, [*keys, "channel_j"]).select(*keys, "lag", "channel_i", "channel_j", F.try_divide("value", F.col("si") * F.col("sj")).alias("value"))


def granger_causality(csd: DataFrame, keys: list[str], n_freq: int, pairs: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Directed influence i -> j from trial-mean cross spectra, and the facts of each factorisation.

    One problem per ``keys`` with all channels, or one per pair of channels;
    the cross spectra of a problem go to one task, whose size is frequencies
    times channels squared, whatever the number of trials.
    """
    if pairs is None:
        groups = csd.withColumn("pair", F.lit(-1))
    else:
        table = csd.sparkSession.createDataFrame([(k, a, b) for k, (i, j) in enumerate(pairs) for a in (i, j) for b in (i, j)], "pair int, channel_i int, channel_j int")
        groups = csd.join(F.broadcast(table), ["channel_i", "channel_j"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chans = np.unique(pdf["channel_i"])
        at = {c: i for i, c in enumerate(chans)}
        s = np.zeros((n_freq, len(chans), len(chans)), complex)
        s[pdf["freq_id"], pdf["channel_i"].map(at), pdf["channel_j"].map(at)] = pdf["re"] + 1j * pdf["im"]
        loaded, eps, cond = network.regularise(s)
        h, sigma, err = network.factorise(loaded)
        g = network.granger(loaded, h, sigma)
        f, i, j = np.indices(g.shape)
        first = pdf.iloc[0]
        return pd.DataFrame({**{k: first[k] for k in keys}, "pair": first["pair"], "freq_id": f.ravel(), "channel_i": chans[i.ravel()], "channel_j": chans[j.ravel()], "re": g.ravel(), "error": err, "loading": eps, "condition": cond})

    kinds = dict(groups.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "pair int, freq_id int, channel_i int, channel_j int, re double, error double, loading double, condition double"
    out = groups.select(*keys, "pair", "freq_id", "channel_i", "channel_j", "re", "im").groupBy(*keys, "pair").applyInPandas(run, schema)
    out = materialise(out)  # influence and side output come from one factorisation
    if pairs is not None:
        wanted = csd.sparkSession.createDataFrame([(k, i, j) for k, (i, j) in enumerate(pairs)], "pair int, channel_i int, channel_j int")
        out = out.join(F.broadcast(wanted), ["pair", "channel_i", "channel_j"], "left_semi")
    return out.select(*keys, "freq_id", "channel_i", "channel_j", "re"), out.select(*keys, "pair", "error", "loading", "condition").distinct()


@frontend
def connectivityanalysis(data: Trials, method: str = "coh", keeptrials: bool = False, output: str = "abs", foi=None, foilim=None, pad="maxperlen", channelcmb=None, polyremoval: int | None = 0, tapsmofrq=None, nTaper=None, taper: str | None = "hann", taper_opt=None, jackknife: bool = False) -> Trials:
    """Connectivity of analog trials (transformed first) or complex spectra.

    'csd' cross spectra, 'coh' coherence, 'ppc' pairwise phase consistency,
    'granger' causality from i to j, 'corr' cross-correlation of analog trials.
    ``channelcmb`` = [senders, receivers] restricts pairs of spectral input.
    ``jackknife`` adds tables jack_bias and jack_var for 'coh' and 'granger'.
    """
    choice(method, "method", METHODS)
    choice(output, "output", OUTPUTS)
    if jackknife and method not in ("coh", "granger"):
        raise ParameterError("the jackknife is for coh and granger")
    if method == "corr":
        if data.kind != "analog":
            raise DataError("correlations are of analog data")
        return _correlation(data, keeptrials, polyremoval)
    if method == "granger" and data.kind == "analog" and (foi is not None or foilim is not None):
        raise ParameterError("granger needs all frequencies of analog data")
    n_trials = data.trials.count()
    if n_trials < 2:
        raise DataError("spectral connectivity needs two trials or more")
    if data.kind == "analog":
        if channelcmb is not None:
            raise ParameterError("channelcmb is for spectral data; select channels instead")
        spec = freqanalysis.plain(data, output="fourier", foi=foi, foilim=foilim, pad=pad, polyremoval=polyremoval, taper=taper, taper_opt=taper_opt, tapsmofrq=tapsmofrq, nTaper=nTaper, keeptapers=True, demean_taper=method == "granger")
    elif data.kind == "spectral" and "im" in data.values:
        spec = data
    else:
        raise DataError("connectivity needs analog data or complex spectra")
    names = spec.labels["channel"]
    pairs, restrict = None, None
    if channelcmb is not None:
        senders, receivers = (positions("channel", names, c) for c in channelcmb)
        pairs = [(i, j) for i in senders for j in receivers]
        restrict = data.spark.createDataFrame(pairs, "channel_i int, channel_j int")
    single = cross_spectra(spec.facts, restrict if method in ("csd", "ppc") else None)
    labels = {"channel_i": names, "channel_j": names, "freq": spec.labels["freq"]}
    made = lambda facts, trials: Trials("cross", facts, trials, spec.samplerate, labels, dict(data.info), dict(data.cfg), (*data.log, method))
    one = spec.trials.where("trial_id = 0")
    if method == "csd" and keeptrials:
        return made(single.select("trial_id", *CELL, "re", "im"), spec.trials)
    if method == "ppc":
        return made(phase_consistency(single, CELL).select(F.lit(0).alias("trial_id"), *CELL, "re"), one)
    average = single.groupBy(*CELL).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    if method == "csd":
        return made(average.select(F.lit(0).alias("trial_id"), *CELL, "re", "im"), one)
    if jackknife:
        single = materialise(single)  # read for the estimate and its replicates

    def estimate(csd, keys):
        """The measure of averaged cross spectra per ``keys`` (time, and the left-out trial)."""
        if method == "granger":
            return granger_causality(csd, keys, len(spec.labels["freq"]), pairs)[0]
        c = coherency(csd, [*keys, "freq_id"])
        if output in ("complex", "fourier"):
            return c
        return c.select(*keys, "freq_id", "channel_i", "channel_j", converted(F.col("re"), F.col("im"), output).alias("re"))

    factorisation = None
    if method == "granger":
        direct, factorisation = granger_causality(average, ["time_idx"], len(spec.labels["freq"]), pairs)
    else:
        direct = estimate(average, ["time_idx"])
    values = [v for v in ("re", "im") if v in direct.columns]
    if restrict is not None:
        direct = direct.join(restrict, ["channel_i", "channel_j"], "left_semi")
    out = made(direct.select(F.lit(0).alias("trial_id"), *CELL, *values), one)
    if method == "granger":
        out = out.register("factorisation", factorisation)
    if jackknife:
        without = leave_one_out(single, "trial_id", CELL, ["re", "im"])
        jack = bias_variance(estimate(without, ["trial_id", "time_idx"]), direct, CELL, values)
        out = out.register("jack_bias", jack.select(*CELL, "jack_bias")).register("jack_var", jack.select(*CELL, "jack_var", "jack_var_mean"))
    return out


def _correlation(data: Trials, keeptrials: bool, order: int | None) -> Trials:
    blocks = to_blocks(data.facts, ["trial_id", "channel_id"], "sample", "value")
    trials = blocks.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("channel_id", "samples"))).alias("x"))

    def run(batches):
        for pdf in batches:
            for trial, rows in zip(pdf["trial_id"], pdf["x"]):
                x = np.stack([np.asarray(r["samples"], float) for r in rows])
                c = network.cross_covariance(spectra.detrend(x, order), keeptrials)
                lag, i, j = np.indices(c.shape)
                ids = np.array([r["channel_id"] for r in rows])
                yield pd.DataFrame({"trial_id": trial, "time_idx": lag.ravel(), "freq_id": 0, "channel_i": ids[i.ravel()], "channel_j": ids[j.ravel()], "re": c.ravel()})

    facts = trials.mapInPandas(run, "trial_id int, time_idx int, freq_id int, channel_i int, channel_j int, re double")
    table = data.trials
    if not keeptrials:
        mean = facts.groupBy(*CELL).agg(F.avg("re").alias("re"))
        zero = mean.where("time_idx = 0 AND channel_i = channel_j").select(F.col("channel_i").alias("c"), F.col("re").alias("v"))
        a, b = zero.select(F.col("c").alias("channel_i"), F.col("v").alias("vi")), zero.select(F.col("c").alias("channel_j"), F.col("v").alias("vj"))
        facts = mean.join(a, "channel_i").join(b, "channel_j").select(F.lit(0).alias("trial_id"), *CELL, F.try_divide("re", F.sqrt(F.col("vi") * F.col("vj"))).alias("re"))
        table = data.trials.where("trial_id = 0")
    names = data.labels.get("channel", [])
    return Trials("cross", facts, table, data.samplerate, {"channel_i": names, "channel_j": names}, dict(data.info), dict(data.cfg), (*data.log, "corr"))
