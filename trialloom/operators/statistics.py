"""Summary statistics along axes and over trials, covariance, jackknife, inter-trial coherence, histograms of spikes."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, choice
from trialloom.frontend import frontend
from trialloom.model import CONTINUOUS, Trials, restack
from trialloom.operators import selection

DIMS = {"time": 0, "channel": "channel_id", "freq": "freq_id", "taper": "taper_id", "channel_i": "channel_i", "channel_j": "channel_j"}


def known(c: Column | str) -> Column:
    """NaN as null: what aggregates skip."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def _reduce(op: str, col: str, skip_nan: bool) -> Column:
    c = known(col) if skip_nan else F.col(col)
    return {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "median": F.median}[op](c)


def _columns(data: Trials, op: str, skip: bool) -> list[Column]:
    if "im" not in data.values:
        v = data.values[0]
        return [F.coalesce(_reduce(op, v, skip), F.lit(float("nan"))).alias(v)]
    if op == "mean":
        return [_reduce(op, c, skip).alias(c) for c in ("re", "im")]
    if op in ("var", "std"):  # real: the mean of the squared distance
        total = _reduce("var", "re", skip) + _reduce("var", "im", skip)
        return [(F.sqrt(total) if op == "std" else total).alias("re"), F.lit(0.0).alias("im")]
    return [_reduce(op, c, skip).alias(c) for c in ("re", "im")]


def check_equal_shapes(data: Trials) -> None:
    """All trials have one length, by the trial table; their other axes are the labels'."""
    if data.lengths().select("n").distinct().limit(2).count() > 1:
        raise DataError("the trials differ in shape")


def reduce_axis(facts: DataFrame, keys: list[str], value: str, op: str) -> DataFrame:
    """A NaN-aware statistic over all rows of each key."""
    return facts.groupBy(*keys).agg(F.coalesce(_reduce(op, value, True), F.lit(float("nan"))).alias(value))


def first_trial(data: Trials) -> DataFrame:
    """The trial table of a statistic over trials: one, as long as the first."""
    first = data.trials.agg(F.min_by("t0", "trial_id").alias("t0"), F.min_by(F.col("stop") - F.col("start"), "trial_id").alias("n"))
    return first.select(F.lit(0).alias("trial_id"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"), "t0", F.array().cast("array<double>").alias("info"))


def _statistic(data: Trials, op: str, dim: str, keeptrials: bool) -> Trials:
    if data.kind not in CONTINUOUS:
        raise DataError("statistics need continuous data")
    axes = list(data.axes)
    if dim == "trials":
        if op == "median":
            raise NotImplementedError("there is no median over trials")
        check_equal_shapes(data)
        facts = data.facts.groupBy(*axes).agg(*_columns(data, op, False)).select(F.lit(0).alias("trial_id"), *axes, *data.values)
        return data.having(f"{op} over trials", facts=facts, trials=first_trial(data))
    axis = axes[0] if dim == "time" else DIMS.get(dim)
    if axis not in axes:
        raise ParameterError(f"{data.kind} data has no axis {dim!r}")
    rest = [a for a in axes if a != axis]
    facts = data.facts.groupBy("trial_id", *rest).agg(*_columns(data, op, True)).withColumn(axis, F.lit(0)).select("trial_id", *axes, *data.values)
    labels = dict(data.labels)
    trials = data.trials
    if dim == "time":
        trials = restack(trials.withColumn("n", F.lit(1).cast("long"))).drop("n")
    elif dim == "freq":
        labels.pop("freq", None)
    else:
        labels[dim] = [op]
    out = data.having(f"{op} over {dim}", facts=facts, trials=trials, labels=labels)
    return out if keeptrials else _statistic(out, "mean", "trials", True)


@frontend
def mean(data: Trials, dim: str = "trials", keeptrials: bool = True) -> Trials:
    """Mean along an axis of each trial (NaN skipped), or over trials (NaN propagates)."""
    return _statistic(data, "mean", dim, keeptrials)


@frontend
def var(data: Trials, dim: str = "trials", keeptrials: bool = True) -> Trials:
    """Population variance; of complex data the mean squared distance from the mean."""
    return _statistic(data, "var", dim, keeptrials)


@frontend
def std(data: Trials, dim: str = "trials", keeptrials: bool = True) -> Trials:
    """Population standard deviation."""
    return _statistic(data, "std", dim, keeptrials)


@frontend
def median(data: Trials, dim: str = "time", keeptrials: bool = True) -> Trials:
    """Median along an axis, NaN skipped."""
    return _statistic(data, "median", dim, keeptrials)


@frontend
def itc(data: Trials) -> Trials:
    """Inter-trial coherence: length of the mean phase vector over trials and tapers; a zero has no phase and is skipped."""
    if data.kind != "spectral" or "im" not in data.values:
        raise DataError("inter-trial coherence needs complex spectra")
    check_equal_shapes(data)
    r = F.hypot("re", "im")
    axes = ["time_idx", "freq_id", "channel_id"]
    facts = data.facts.groupBy(*axes).agg(F.hypot(F.avg(F.try_divide("re", r)), F.avg(F.try_divide("im", r))).alias("re"))
    facts = facts.select(F.lit(0).alias("trial_id"), "time_idx", F.lit(0).alias("taper_id"), "freq_id", "channel_id", "re")
    trials = data.trials.where(F.col("trial_id") == 0)
    return data.having("inter-trial coherence", facts=facts, trials=trials, labels={**data.labels, "taper": ["itc"]})


def covariance(facts: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    """(keys, channel_i, channel_j, cov) across samples; each pair is computed once and mirrored."""
    # the values of one sample meet in one array, so each is shuffled once; pairs are formed there and added up at once
    z = F.array_sort(F.collect_list(F.struct(F.col("channel_id").alias("c"), F.col("value").cast("double").alias("v"))))
    cells = facts.groupBy(*keys, "sample").agg(z.alias("z"))
    each = cells.select(*keys, F.explode("z").alias("a"), "z").select(*keys, "a", F.explode(F.filter("z", lambda x: x["c"] >= F.col("a.c"))).alias("b"))
    met = each.select(*keys, F.col("a.c").alias("channel_i"), F.col("b.c").alias("channel_j"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    n = F.count(F.lit(1))
    half = met.groupBy(*keys, "channel_i", "channel_j").agg(F.try_divide(F.covar_pop("x", "y") * n, n - ddof).alias("cov"))
    return half.unionByName(half.where("channel_i < channel_j").select(*keys, F.col("channel_j").alias("channel_i"), F.col("channel_i").alias("channel_j"), "cov"))


@frontend
def timelockanalysis(data: Trials, latency="maxperiod", covariance_: bool = False, ddof: int = 1, trials="all", keeptrials: bool = False) -> Trials:
    """Average and variance over trials within a window, and on request the channels' covariance.

    The covariance is of single trials with ``keeptrials``, else of the
    average (T24).  Tables ``avg``, ``var`` and ``cov`` are in ``extras``.
    """
    if data.kind != "analog":
        raise DataError("time-locked averages need analog data")
    cut = selection.selectdata.plain(data, trials=trials, latency=latency)
    if not cut.is_time_locked():
        raise DataError("the trials are not locked to one time")
    stats = cut.facts.groupBy("sample", "channel_id").agg(F.avg("value").alias("avg"), F.var_pop("value").alias("var"))
    out = cut.having("time-locked", kind="timelock").register("avg", stats.select("sample", "channel_id", "avg")).register("var", stats.select("sample", "channel_id", "var"))
    if covariance_:
        source, keys = (cut.facts, ["trial_id"]) if keeptrials else (stats.select("sample", "channel_id", F.col("avg").alias("value")), [])
        out = out.register("cov", covariance(source, keys, ddof))
    return out


# --- jackknife ----------------------------------------------------------------------------------------------------


def leave_one_out(facts: DataFrame, trial: str, axes: list[str], values: list[str]) -> DataFrame:
    """Replicate means without each trial, (sum - x) / (n - 1), in one pass over the axes."""
    sums = facts.groupBy(*axes).agg(F.count(F.lit(1)).alias("n_"), *[F.sum(v).alias(f"{v}_") for v in values])
    met = facts.join(sums, axes)
    return met.where("n_ > 1").select(trial, *axes, *[((F.col(f"{v}_") - F.col(v)) / (F.col("n_") - 1)).alias(v) for v in values])


def bias_variance(replicates: DataFrame, direct: DataFrame, axes: list[str], values: list[str]) -> DataFrame:
    """Jackknife bias and variance of an estimate.

    ``jack_var`` is (n-1) times the sum of squared distances of the replicates
    from their mean, the variance of pseudo-values; ``jack_var_mean`` is that
    of the estimate itself, (n-1)/n times the sum.
    """
    n = F.count(F.lit(1))
    spread = sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0]))
    stats = replicates.groupBy(*axes).agg(n.alias("n"), *[F.avg(v).alias(f"{v}_rep") for v in values], spread.alias("spread"))
    met = stats.join(direct, axes)
    return met.select(
        *axes, *[((F.col("n") - 1) * (F.col(f"{v}_rep") - F.col(v))).alias("jack_bias" if i == 0 else "jack_bias_im") for i, v in enumerate(values)],
        ((F.col("n") - 1) * F.col("n") * F.col("spread")).alias("jack_var"), ((F.col("n") - 1) * F.col("spread")).alias("jack_var_mean"),
    )


# --- spikes ---------------------------------------------------------------------------------------------------------


def rice_bins(n: float) -> int:
    return int(2 * n ** (1 / 3))


def sqrt_bins(n: float) -> int:
    return math.ceil(math.sqrt(n))


def freedman_diaconis_width(iqr: float, n: float) -> float:
    return 2 * iqr / n ** (1 / 3)


def bin_edges(window: tuple[float, float], binsize, mean_length: float) -> list[float]:
    """Edges: a rule's count of edges over the window, or steps of seconds that may overshoot its end (T8)."""
    if isinstance(binsize, str):
        n = {"rice": rice_bins, "sqrt": sqrt_bins}[choice(binsize, "binsize", ("rice", "sqrt"))](mean_length)
        n = max(n, 2)
        return [window[0] + (window[1] - window[0]) * i / (n - 1) for i in range(n)]
    if not 0 < binsize <= window[1] - window[0]:
        raise ParameterError("binsize must be positive and not longer than the window")
    n = math.ceil((window[1] + binsize - window[0]) / binsize) - 1  # edges lie below the window's end plus one bin
    return [window[0] + i * binsize for i in range(n + 1)]


def histogram(events: DataFrame, keys: list[str], time: str, edges: list[float]) -> DataFrame:
    """(keys, bin, n) of times within equidistant edges; bins are half open, the last closed."""
    width, n = edges[1] - edges[0], len(edges) - 1
    at = F.floor((F.col(time) - edges[0]) / width)
    at = F.when(F.col(time) == edges[-1], n - 1).otherwise(at).cast("int")
    return events.withColumn("bin", at).where(F.col("bin").between(0, n - 1)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


@frontend
def spike_psth(data: Trials, binsize="rice", output: str = "rate", latency="maxperiod", vartriallen: bool = True, keeptrials: bool = True) -> Trials:
    """Histograms of spike times per trial and (channel, unit), with average and variance over trials.

    Bins that a trial does not cover are NaN; ``output`` is 'rate' (per
    second), 'spikecount' or 'proportion' (of the trial's counts).
    """
    if data.kind != "spike":
        raise DataError("the histogram is of spikes")
    choice(output, "output", ("rate", "spikecount", "proportion"))
    window = selection.analysis_window(data, latency) or selection.analysis_window(data, "maxperiod")
    picked = data if vartriallen else data.having(trials=selection.covering(data, window))
    length = picked.trials.agg(F.avg(F.col("stop") - F.col("start"))).first()[0]
    if length is None:
        raise DataError("no trial covers the window")
    edges = bin_edges(window, binsize, length)
    from trialloom.operators.trials import assign

    spikes = assign(picked, every=True).where("channel IS NOT NULL AND unit IS NOT NULL")
    combos = channel_units(picked)
    labelled = combos.withColumn("channel_id", (F.dense_rank().over(W.orderBy("channel", "unit")) - 1).cast("int"))
    counts = histogram(spikes, ["trial_id", "channel", "unit"], "time", edges)
    grid = psth_grid(picked, labelled, edges)
    width = edges[1] - edges[0]
    full = grid.join(counts, ["trial_id", "channel", "unit", "bin"], "left").withColumn("n", F.when(F.col("covered"), F.coalesce("n", F.lit(0)).cast("double")).otherwise(float("nan")))
    value = {"spikecount": F.col("n"), "rate": F.col("n") / width, "proportion": F.try_divide(F.col("n"), F.sum(known("n")).over(W.partitionBy("trial_id", "channel_id")))}[output]
    facts = full.select("trial_id", F.col("bin").alias("sample"), "channel_id", value.alias("value"))
    names = [f"channel{r['channel']}_unit{r['unit']}" for r in labelled.orderBy("channel_id").select("channel", "unit").collect()]
    fs = 1 / width
    trials = restack(picked.trials.select("trial_id", F.lit(edges[0] * fs).alias("t0"), "info", F.lit(len(edges) - 1).cast("long").alias("n"))).select("trial_id", "start", "stop", "t0", "info")
    stats = facts.groupBy("sample", "channel_id").agg(F.avg(known("value")).alias("avg"), F.var_pop(known("value")).alias("var"))
    out = Trials("timelock", facts, trials, fs, {"channel": names}, dict(data.info), dict(data.cfg), data.log)
    out = out.register("avg", stats.select("sample", "channel_id", "avg")).register("var", stats.select("sample", "channel_id", "var"))
    return out if keeptrials else out.having(facts=stats.select(F.lit(0).alias("trial_id"), "sample", "channel_id", F.col("avg").alias("value")), trials=trials.where("trial_id = 0"))


MOST_COMBINATIONS = 10_000


def channel_units(data: Trials) -> DataFrame:
    """(channel, unit) of every combination that has a spike, neither of them null."""
    return data.facts.where("channel IS NOT NULL AND unit IS NOT NULL").select("channel", "unit").distinct()


def event_codes(data: Trials) -> DataFrame:
    """(eventid) of every code that occurs."""
    return data.facts.where("eventid IS NOT NULL").select("eventid").distinct()


def psth_grid(data: Trials, combos: DataFrame, edges: list[float]) -> DataFrame:
    """Every (trial, channel, unit, bin) once, and whether the trial covers the bin.

    This is the size of the result: bins and combinations (at most
    ``MOST_COMBINATIONS``, as many as the result has channels) are part of the
    plan, so trials stay where they are.
    """
    rows = combos.select("channel", "unit", "channel_id").limit(MOST_COMBINATIONS + 1).collect()
    if len(rows) > MOST_COMBINATIONS:
        raise DataError(f"more than {MOST_COMBINATIONS} combinations of channel and unit")
    kinds = dict(combos.dtypes)
    fs, eps = data.samplerate, 1e-9
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]))
    spans = data.trials.select("trial_id", (F.col("t0") / fs).alias("first"), ((F.col("stop") - F.col("start") + F.col("t0")) / fs).alias("last"))
    kind = f"array<struct<channel:{kinds['channel']},unit:{kinds['unit']},channel_id:{kinds['channel_id']}>>"
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), kind)
    both = spans.select("*", F.explode(listed).alias("c")).select("trial_id", "first", "last", "c.*")
    cells = both.select("trial_id", "channel", "unit", "channel_id", "first", "last", bins.alias("x"))
    return cells.select("trial_id", "channel", "unit", "channel_id", F.col("x.bin").alias("bin"), ((F.col("x.a") >= F.col("first") - eps) & (F.col("x.b") <= F.col("last") + eps)).alias("covered"))
