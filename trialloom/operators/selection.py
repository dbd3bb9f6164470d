"""Selection of trials and axis entries, lowered to predicates and small joins before any kernel."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, ParameterTypeError
from trialloom.frontend import frontend
from trialloom.model import Trials, restack
from trialloom.plans.tables import running_total

KEYS = {
    "analog": {"trials", "latency", "channel"}, "timelock": {"trials", "latency", "channel"},
    "spectral": {"trials", "latency", "channel", "frequency", "taper"},
    "cross": {"trials", "latency", "frequency", "channel_i", "channel_j"},
    "spike": {"trials", "latency", "channel", "unit"}, "event": {"trials", "latency", "eventid"},
}
COLUMN = {"channel": "channel_id", "frequency": "freq_id", "taper": "taper_id", "unit": "unit", "eventid": "eventid", "channel_i": "channel_i", "channel_j": "channel_j"}
LABEL = {"frequency": "freq"}
WINDOWS = ("maxperiod", "minperiod", "prestim", "poststim", "all")


def best_match(source, selection, span: bool = False, tol: float | None = None, squash_duplicates: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(values, positions) of ``source`` nearest to each selected value, or within the closed span.

    ``source`` may be in any order; of two equally near values the larger
    wins.  With ``tol``, a value farther away is an error.
    """
    source, selection = np.asarray(source, float), np.asarray(selection, float)
    order = np.argsort(source, kind="stable")
    s = source[order]
    if span:
        lo, hi = selection
        at = np.sort(order[(s >= lo) & (s <= hi)])
        return source[at], at
    right = np.clip(np.searchsorted(s, selection, "left"), 0, len(s) - 1)
    left = np.clip(right - 1, 0, len(s) - 1)
    at = order[np.where(np.abs(selection - s[left]) < np.abs(s[right] - selection), left, right)]
    if tol is not None and (np.abs(source[at] - selection) > tol).any():
        raise ParameterError("a value lies farther from the axis than the tolerance")
    if squash_duplicates:
        at = at[np.sort(np.unique(at, return_index=True)[1])]
    return source[at], at


def positions(axis: str, labels: list, wanted) -> list[int]:
    """Positions on an axis of names, indices, slices, ranges or a single entry; order and repetition are kept."""
    n = len(labels)
    if wanted is None or (isinstance(wanted, str) and wanted == "all"):
        return list(range(n))
    if isinstance(wanted, slice):
        return list(range(n))[wanted]
    if isinstance(wanted, (str, int, np.integer)) and not isinstance(wanted, bool):
        wanted = [wanted]
    if not isinstance(wanted, (list, tuple, range, np.ndarray)):
        raise ParameterTypeError(f"{axis}: a name, index, slice or a list of them")
    out = []
    for w in wanted:
        if isinstance(w, str):
            if w not in labels:
                raise ParameterError(f"{axis}: no entry {w!r}")
            out.append(labels.index(w))
        else:
            i = int(w)
            if i != w or not -n <= i < n:
                raise ParameterError(f"{axis}: no entry {w}")
            out.append(i % n)
    if not out:
        raise ParameterError(f"{axis}: nothing selected")
    return out


def frequencies(axis: list[float], wanted) -> list[int]:
    """Positions of the bin nearest to a frequency, or of those in a closed range within the axis (ends may be infinite)."""
    if isinstance(wanted, str) and wanted == "all":
        return list(range(len(axis)))
    if np.ndim(wanted) == 0:
        if isinstance(wanted, str) or not min(axis) <= wanted <= max(axis):
            raise ParameterError("frequency: outside the axis")
        return best_match(axis, [wanted])[1].tolist()
    lo, hi = (float(x) for x in wanted)
    if math.isnan(lo) or math.isnan(hi) or lo > hi or (math.isfinite(lo) and lo < min(axis)) or (math.isfinite(hi) and hi > max(axis)):
        raise ParameterError("frequency: [low, high] within the axis")
    at = best_match(axis, [lo, hi], span=True)[1].tolist()
    if not at:
        raise ParameterError("frequency: no bin in the range")
    return at


def analysis_window(data: Trials, latency) -> tuple[float, float] | None:
    """A latency window in seconds; keywords are resolved by one aggregation of the trial table."""
    if latency is None or (isinstance(latency, str) and latency == "all"):
        return None
    if isinstance(latency, str):
        if latency not in WINDOWS:
            raise ParameterError(f"latency must be one of {', '.join(WINDOWS)} or [start, end]")
        r = data.intervals().agg(*[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("first", "last")]).first()
        lo, hi = {"maxperiod": (r["minfirst"], r["maxlast"]), "minperiod": (r["maxfirst"], r["minlast"]), "prestim": (r["minfirst"], 0.0), "poststim": (0.0, r["maxlast"])}[latency]
        if lo is None:
            raise DataError("there are no trials")
        if not lo <= hi:
            raise DataError(f"the trials have no {latency} window")
        return lo, hi
    if np.ndim(latency) != 1 or len(latency) != 2:
        raise ParameterError("latency must be [start, end]")
    lo, hi = (float(x) for x in latency)
    if not lo <= hi:
        raise ParameterError("latency: the start lies after the end")
    return lo, hi


def covering(data: Trials, window: tuple[float, float]) -> DataFrame:
    """The trials that cover the window from their first to their last sample."""
    eps = 1e-9
    lo, hi = window
    full = data.intervals().where((F.col("first") <= lo + eps) & (F.col("last") >= hi - eps)).select("trial_id")
    return data.trials.join(full, "trial_id", "left_semi")


def _ordered(data: Trials, name: str, at: list[int], n: int):
    """Facts and labels with the axis entries ``at`` in their order, repeated ones included."""
    col, label = COLUMN[name], LABEL.get(name, name)
    labels = data.labels.get(label)
    picked = [labels[i] for i in at] if labels else labels
    facts = data.facts
    if at == list(range(n)):
        return facts, picked
    if at == sorted(set(at)):
        facts = facts.where(F.col(col).isin(at))
    # positions are part of the plan: no table, no shuffle
    new = F.array(*[F.lit(i) for i in range(len(at))])
    old = F.array(*[F.lit(i) for i in at])
    hits = F.filter(new, lambda i: F.element_at(old, i + 1) == F.col(col))
    others = [c for c in facts.columns if c != col]
    facts = facts.select(*others, F.explode(hits).alias(col)).select(*data.facts.columns)
    return facts, picked


@frontend
def selectdata(data: Trials, trials=None, channel=None, channel_i=None, channel_j=None, latency=None, frequency=None, taper=None, unit=None, eventid=None, discard: bool = True) -> Trials:
    """A subset of trials and axis entries, in the order asked for, repeated entries included.

    ``latency`` is a closed window in seconds or one of 'maxperiod',
    'minperiod', 'prestim' and 'poststim'; trials that do not cover it are
    discarded, unless ``discard`` is off.  Trials are renumbered in the order of
    the selection and put one after another.  ``unit`` and ``eventid`` take
    labels, or positions on the sorted axis (T7).
    """
    asked = {k: v for k, v in dict(trials=trials, channel=channel, channel_i=channel_i, channel_j=channel_j, latency=latency, frequency=frequency, taper=taper, unit=unit, eventid=eventid).items() if v is not None}
    wrong = set(asked) - KEYS[data.kind]
    if wrong:
        raise ParameterError(f"{data.kind} data has no {', '.join(sorted(wrong))}")
    if data.kind in ("spike", "event"):
        return _select_discrete(data, asked, discard)

    out = data
    for name in ("channel", "channel_i", "channel_j", "taper", "frequency"):
        if name in asked:
            label = LABEL.get(name, name)
            labels = out.labels.get(label) or []
            at = frequencies(labels, asked[name]) if name == "frequency" else positions(name, labels, asked[name])
            facts, picked = _ordered(out, name, at, len(labels))
            out = out.having(facts=facts, labels={**out.labels, label: picked})
    if "trials" in asked:
        out = _take_trials(out, asked["trials"])
    window = analysis_window(out, asked.get("latency"))
    if window is not None:
        out = cut(out, window, discard)
    return out.having("selected " + ", ".join(sorted(asked)))


def _take_trials(data: Trials, wanted) -> Trials:
    if isinstance(wanted, str) and wanted == "all":
        return data
    wanted = [wanted] if np.ndim(wanted) == 0 else list(wanted)
    if any(isinstance(w, (bool, str)) or int(w) != w for w in wanted) or not wanted:
        raise ParameterError("trials: integers")
    there = {r[0] for r in data.trials.where(F.col("trial_id").isin([int(w) for w in wanted])).select("trial_id").collect()}
    missing = sorted({int(w) for w in wanted} - there)
    if missing:
        raise ParameterError(f"trials: no trial {missing[0]}")
    picked = data.spark.createDataFrame([(i, int(w)) for i, w in enumerate(wanted)], "place int, old int")
    table = data.trials.join(F.broadcast(picked), F.col("trial_id") == F.col("old")).select(F.col("place").alias("trial_id"), "start", "stop", "t0", "info")
    if data.kind in ("spike", "event"):
        return data.having(trials=table)
    facts = data.facts.where(F.col("trial_id").isin([int(w) for w in wanted])).join(F.broadcast(picked), F.col("trial_id") == F.col("old"))
    facts = facts.select(*[F.col("place").alias(c) if c == "trial_id" else F.col(c) for c in data.facts.columns])
    return data.having(facts=facts, trials=restack(table.withColumn("n", F.col("stop") - F.col("start"))).drop("n"))


def cut(data: Trials, window: tuple[float, float], discard: bool = True) -> Trials:
    """The samples of continuous trials within a closed window; each trial's times stay as they are."""
    fs, eps = data.samplerate, 1e-6
    kept = covering(data, window) if discard else data.trials
    first = F.greatest(F.ceil(F.lit(window[0] * fs - eps) - F.col("t0")), F.lit(0)).cast("long")
    last = F.least(F.floor(F.lit(window[1] * fs + eps) - F.col("t0")), F.col("stop") - F.col("start") - 1).cast("long")
    spans = kept.select("trial_id", "t0", "info", first.alias("a"), last.alias("b")).where("a <= b")
    if spans.isEmpty():
        raise DataError("no trial has a sample in the latency window")
    spans = running_total(spans, "trial_id", F.lit(1), "place").withColumn("place", F.col("place").cast("int"))
    axis = data.axes[0]
    s = spans.select(F.col("trial_id").alias("old"), "a", "b", "place")
    facts = data.facts.join(s, F.col("trial_id") == F.col("old")).where(F.col(axis).between(F.col("a"), F.col("b")))
    facts = facts.select(*[F.col("place").alias(c) if c == "trial_id" else (F.col(axis) - F.col("a")).cast("int").alias(c) if c == axis else F.col(c) for c in data.facts.columns])
    table = spans.select(F.col("place").alias("trial_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), (F.col("t0") + F.col("a")).alias("t0"), "info", (F.col("b") - F.col("a") + 1).alias("n"))
    return data.having(facts=facts, trials=restack(table).drop("n"))


def _select_discrete(data: Trials, asked: dict, discard: bool) -> Trials:
    from trialloom.operators.trials import assign

    out = data
    for name in ("channel", "unit", "eventid"):
        if name in asked:
            col = "channel" if name == "channel" else name
            codes = out.info.get(f"{name}_codes")
            if codes is None:
                codes = [r[0] for r in out.facts.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]
            labels = out.labels.get(name) or [str(c) for c in codes]
            at = positions(name, labels, asked[name])
            out = out.having(facts=out.facts.where(F.col(col).isin([codes[i] for i in sorted(set(at))])), labels={**out.labels, name: [labels[i] for i in sorted(set(at))]})
    if "trials" in asked:
        out = _take_trials(out, asked["trials"])
    window = analysis_window(out, asked.get("latency"))
    if "trials" in asked or window is not None:
        if window is not None and discard:
            out = out.having(trials=covering(out, window))
        rows = assign(out, every=True)
        if window is not None:
            rows = rows.where(F.col("time").between(window[0] - 1e-9, window[1] + 1e-9))
        else:
            rows = rows.where(F.col("trial_id") >= 0)
        out = out.having(facts=rows.select(*data.facts.columns).distinct())
    return out.having("selected " + ", ".join(sorted(asked)))


def show(data: Trials, **select):
    """The selected values as arrays, one per trial (axes in the object's order), or one array if there is one trial."""
    picked = selectdata.plain(data, discard=False, **select) if select else data
    axes = list(picked.axes)
    if picked.kind in ("spike", "event"):
        return np.array([tuple(r) for r in picked.facts.orderBy("sample").collect()])
    rows = picked.facts.select("trial_id", *axes, *picked.values).toPandas()
    out = []
    for _, g in rows.sort_values(["trial_id", *axes]).groupby("trial_id"):
        shape = [g[a].nunique() for a in axes]
        v = g[picked.values[0]].to_numpy() + (1j * g["im"].to_numpy() if "im" in picked.values else 0)
        out.append(np.squeeze(v.reshape(shape)))
    return out[0] if len(out) == 1 else out
