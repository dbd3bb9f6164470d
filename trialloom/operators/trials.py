"""Trials: assignment of samples, definition from arrays or events, re-segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError
from trialloom.frontend import frontend
from trialloom.model import Trials, trial_table
from trialloom.plans.tables import running_total


USUAL = 8  # spans up to so many widths are of the first class
SIZE_STEP = 16  # ratio of lengths of neighbouring size classes
MOST_CLASSES = 15
MOST_TOUCHED = 16  # buckets that spans may touch on average without classes


def range_join(points: DataFrame, at: str, spans: DataFrame, lo: str = "start", hi: str = "stop", keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Rows of ``points`` with every span that holds them, lo <= at < hi (one-to-many).

    Spans are put into all buckets that they touch, so that the join is an
    equi-join on bucket, whatever the number of spans.  Buckets are ``width``
    wide, by default the median length.  Where spans touch more than 16 of them
    on average, those of more than 8 widths are in classes 16 times as long, with
    buckets as wide as the longest span of the class before: a span then touches
    17 buckets at most, and a point looks into one bucket of each class that
    there is.  Nulls match nothing.
    """
    keys = keys or []
    length = F.col(hi) - F.col(lo)
    valid = spans.where(length > 0)
    stats = valid.agg(F.percentile_approx(length, 0.5).alias("usual"), F.avg(length.cast("double")).alias("mean")).first()
    width = width or max(1, int(stats["usual"] or 1))
    size = F.ceil(F.log(F.greatest(length / (USUAL * width), F.lit(1.0))) / F.log(F.lit(float(SIZE_STEP))) - 1e-9)
    classed, present = valid.withColumn("class_", F.lit(0)), [0]
    if (stats["mean"] or 0) > MOST_TOUCHED * width:
        classed = valid.withColumn("class_", F.least(size, F.lit(MOST_CLASSES)).cast("int"))
        present = sorted(r[0] for r in classed.select("class_").distinct().collect())  # at most MOST_CLASSES + 1

    def wide(c):
        return F.when(c == 0, F.lit(width).cast("long")).otherwise(F.lit(USUAL * width) * F.pow(F.lit(float(SIZE_STEP)), c - 1).cast("long"))

    s = classed.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(lo) / wide(F.col("class_"))), F.floor((F.col(hi) - 1) / wide(F.col("class_"))))))
    there = points.where(F.col(at).isNotNull())
    if present == [0]:
        p = there.select("*", F.lit(0).alias("class_"), F.floor(F.col(at) / width).alias("bucket_"))
    else:
        looks = F.array(*[F.struct(F.lit(c).alias("class_"), F.floor(F.col(at) / wide(F.lit(c))).alias("bucket_")) for c in present])
        p = there.withColumn("look_", F.explode(looks)).select(*points.columns, "look_.class_", "look_.bucket_")
    met = p.join(s, [*keys, "class_", "bucket_"])
    return met.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("class_", "bucket_")


def assign(data: Trials, every: bool = False) -> DataFrame:
    """Events with trial_id and time; an event in no trial has trial -1 and time NaN, of several trials the last wins.

    With ``every`` an event of several trials is a row for each of them, and
    events in none are left out.
    """
    spans = data.trials.select("trial_id", "start", "stop", "t0").where("start IS NOT NULL AND stop IS NOT NULL")
    fs = data.samplerate
    if every:
        met = range_join(data.facts, "sample", spans)
        return met.select(*data.facts.columns, "trial_id", ((F.col("sample") - F.col("start") + F.col("t0")) / fs).alias("time"))
    last = range_join(data.facts.select("sample").distinct(), "sample", spans).groupBy("sample").agg(F.max_by(F.struct("trial_id", "start", "t0"), "trial_id").alias("t"))
    met = data.facts.join(last, "sample", "left")
    time = (F.col("sample") - F.col("t.start") + F.col("t.t0")) / fs
    return met.select(*data.facts.columns, F.coalesce("t.trial_id", F.lit(-1)).alias("trial_id"), F.coalesce(time, F.lit(float("nan"))).alias("time"))


def cut_recording(recording: DataFrame, spans: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """Long readings of recordings as trials: each span's rows with samples counted from its start (J1)."""
    met = range_join(recording, sample, spans, keys=keys)
    return met.withColumn(sample, (F.col(sample) - F.col("start")).cast("int"))


@frontend
def definetrial(data: Trials, trialdefinition=None, pre=None, post=None, start=None, trigger=None, stop=None, clip_edges: bool = False, n_samples: int | None = None, recording: str | None = None) -> Trials:
    """A new trial table: an array of rows (start, stop, t0, info ...), another object's trials, events, or one whole trial.

    Event codes ``start``, ``trigger`` and ``stop`` are matched in order of
    time: the next start, the next trigger after it, the next stop after the
    start; matched events are used up.  A single code repeats until no match
    is left, a list gives one entry per trial.  ``pre`` and ``post`` (seconds)
    put borders around the trigger or beyond start and stop.  ``recording`` names
    a column of the events; each recording is then matched by itself, and its
    value follows the code in the info of its trials.
    """
    options = dict(pre=pre, post=post, start=start, trigger=trigger, stop=stop)
    if trialdefinition is None and all(v is None for v in options.values()):
        return data.having(trials=_whole(data))
    if isinstance(trialdefinition, Trials):
        events = trialdefinition
        if all(v is None for v in options.values()):
            ratio = data.samplerate / events.samplerate
            scaled = [F.round(F.col(c) * ratio).cast(t).alias(c) for c, t in (("start", "long"), ("stop", "long"), ("t0", "double"))]
            table = events.trials.select("trial_id", *scaled, "info")
        else:
            table = match_events(events.facts, events.samplerate, data.samplerate, **options, recording=recording)
    elif trialdefinition is not None:
        a = np.asarray(trialdefinition, float)
        if a.ndim != 2 or a.shape[1] < 3 or np.isnan(a[:, :2]).any() or (a[:, :2] != np.round(a[:, :2])).any() or (a[:, 1] <= a[:, 0]).any():
            raise ParameterError("a trial definition has rows (start, stop, offset, ...) with start before stop")
        table = trial_table(data.spark, a.tolist())
    elif data.kind == "event":
        table = match_events(data.facts, data.samplerate, data.samplerate, **options, recording=recording)
    else:
        raise ParameterError("trials of continuous data from events need the events")
    if recording is not None and recording in table.columns:
        table = _one_axis(table, recording)
    if clip_edges:
        table = clip(table, n_samples if n_samples is not None else _length(data))
    return data.having("trials defined", trials=table)


def _one_axis(table: DataFrame, recording: str) -> DataFrame:
    """Trials of recordings numbered over all of them; a recording's number is the last value of its trials' info."""
    n = table.groupBy(recording).agg(F.count(F.lit(1)).alias("n"))
    before = n.select(F.col(recording).alias("r_"), F.coalesce(F.sum("n").over(W.orderBy(recording).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    met = table.join(before, F.col(recording).eqNullSafe(F.col("r_")))
    return met.select((F.col("trial_id") + F.col("before")).cast("int").alias("trial_id"), "start", "stop", "t0", F.concat("info", F.array(F.col(recording).cast("double"))).alias("info"))


def _length(data: Trials) -> int:
    r = data.trials.agg(F.max("stop")).first()[0]
    return int(r or 0)


def _whole(data: Trials) -> DataFrame:
    if data.kind in ("spike", "event"):
        # half-open: an event at the very last sample lies outside (T6)
        span = data.facts.agg(F.min("sample").alias("start"), F.max("sample").alias("stop"))
    else:
        span = data.trials.agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return span.where("start IS NOT NULL").select(F.lit(0).alias("trial_id"), F.col("start").cast("long"), F.col("stop").cast("long"), F.lit(0.0).alias("t0"), F.array().cast("array<double>").alias("info"))


def clip(table: DataFrame, n_samples: int | str) -> DataFrame:
    """Trials cut to the recording, ``n_samples`` long or as the column of that name says; an empty one is an error."""
    length = F.col(n_samples) if isinstance(n_samples, str) else F.lit(n_samples)
    # least() leaves nulls out: a recording of unknown length cuts nothing
    out = table.select("trial_id", F.greatest("start", F.lit(0)).alias("a"), F.least("stop", length).alias("b"), "start", "t0", "info")
    if not out.where("a >= b").isEmpty():
        raise DataError("a trial lies outside the recording")
    return out.select("trial_id", F.col("a").alias("start"), F.col("b").alias("stop"), (F.col("t0") + F.col("a") - F.col("start")).alias("t0"), "info")


def trials_around(events: DataFrame, code: int, pre: float, post: float, samplerate: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """One trial around every event of a code: a projection, for matching by trigger alone; with the events' columns ``keep``."""
    a, b = int(round(pre * samplerate)), int(round(post * samplerate))
    hit = events.where((F.col("eventid") == code) & F.col("sample").isNotNull())
    hit = running_total(hit.select("sample", *keep), "sample", F.lit(1), "place", 1 << 22)
    numbered = hit.select(F.col("place").cast("int").alias("trial_id"), (F.col("sample") - a).cast("long").alias("start"), (F.col("sample") + b).cast("long").alias("stop"), *keep)
    return numbered.select("trial_id", "start", "stop", F.lit(float(-a)).alias("t0"), F.array(F.lit(float(code))).alias("info"), *keep)


class _Unused:
    """Ordered places of the events of one code, of which the next unused one is found without looking at used ones."""

    def __init__(self, places: np.ndarray):
        self.places = places
        self.next = np.arange(len(places) + 1)

    def after(self, place: int) -> int | None:
        i = int(np.searchsorted(self.places, place, "right"))
        root = i
        while self.next[root] != root:
            root = int(self.next[root])
        while self.next[i] != root:
            self.next[i], i = root, int(self.next[i])
        return int(self.places[root]) if root < len(self.places) else None

    def use(self, place: int) -> None:
        i = int(np.searchsorted(self.places, place))
        self.next[i] = i + 1


def match_events(events: DataFrame, rate: float, target: float, pre=None, post=None, start=None, trigger=None, stop=None, recording: str | None = None) -> DataFrame:
    """Trials from coded events, each recording by itself (T4).

    The match runs along time and uses events up, so it is sequential within
    a recording, in time linear in its events; recordings run in parallel.  Only time and code of events
    whose code is asked for reach it.  Without ``recording`` all events are one
    recording.  Info of a trial is its trigger's code (NaN without).
    """
    if start is None and trigger is None:
        raise ParameterError("give a start or a trigger code")
    if stop is not None and start is None:
        raise ParameterError("a stop code needs a start code")
    if stop is None and (post is None):
        raise ParameterError("give a stop code or the time after the trigger")
    if start is None and pre is None:
        raise ParameterError("give a start code or the time before the trigger")
    specs = [np.atleast_1d(x).tolist() if x is not None else None for x in (start, trigger, stop)]
    lists = [np.ndim(x) == 1 for x in (start, trigger, stop)]
    lengths = {len(s) for s, is_list in zip(specs, lists) if is_list}
    if len(lengths) > 1:
        raise ParameterError("lists of codes need the same length")
    n_specs = lengths.pop() if lengths else None
    codes = sorted({int(c) for s in specs if s for c in s})
    key = recording or "__all"
    slim = events.where(F.col("eventid").isin(codes) & F.col("sample").isNotNull())
    slim = slim.select((F.col(recording) if recording else F.lit(0)).alias(key), "sample", "eventid")
    before, after = int(round((pre or 0) * target)), int(round((post or 0) * target))
    ratio = target / rate

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sample", "eventid"])
        at, code = pdf["sample"].to_numpy(), pdf["eventid"].to_numpy()
        unused = {c: _Unused(np.flatnonzero(code == c)) for c in codes}

        def following(c, after_i):
            return unused[c].after(after_i)

        rows, k = [], 0
        while n_specs is None or k < n_specs:
            s, t, e = (None if x is None else x[k] if is_list else x[0] for x, is_list in zip(specs, lists))
            i = following(s, -1) if s is not None else None
            j = following(t, -1 if i is None else i) if t is not None else None
            m = following(e, i) if e is not None and i is not None else None
            if (s is not None and i is None) or (t is not None and j is None) or (e is not None and m is None):
                if n_specs is None:
                    break
                k += 1
                continue
            zero = j if j is not None else i
            first = round(at[i] * ratio) - before if i is not None else round(at[zero] * ratio) - before
            last = round(at[m] * ratio) + after if m is not None else round(at[zero] * ratio) + after
            rows.append((pdf[key].iloc[0], int(first), int(last), float(first - round(at[zero] * ratio)), [float(code[j])] if j is not None else [float("nan")]))
            for x in (i, j, m):
                if x is not None:
                    unused[int(code[x])].use(x)
            k += 1
        return pd.DataFrame(rows, columns=[key, "start", "stop", "t0", "info"])

    kind = dict(slim.dtypes)[key]
    found = slim.groupBy(key).applyInPandas(run, f"{key} {kind}, start long, stop long, t0 double, info array<double>")
    if recording:
        order = W.partitionBy(key).orderBy("start", "stop")
        return found.select(recording, (F.row_number().over(order) - 1).cast("int").alias("trial_id"), "start", "stop", "t0", "info")
    found = running_total(found.drop(key), "start", F.lit(1), "place", 1 << 22)
    return found.select(F.col("place").cast("int").alias("trial_id"), "start", "stop", "t0", "info")


@frontend
def redefinetrial(data: Trials, trials=None, minlength=None, offset=None, toilim=None, begsample=None, endsample=None, trl=None) -> Trials:
    """Trials chosen, cut by a window or relative samples, shifted in time, or replaced altogether."""
    if trl is not None and any(v is not None for v in (minlength, offset, toilim, begsample, endsample)):
        raise ParameterError("trl replaces the trials; it goes with no other option but trials")
    if toilim is not None and (begsample is not None or endsample is not None):
        raise ParameterError("cut by toilim or by samples, not both")
    if (begsample is None) != (endsample is None):
        raise ParameterError("begsample and endsample go together")
    if data.kind not in ("analog", "timelock", "spike", "event"):
        raise ParameterError("trials of time series, spikes or events can be redefined")
    from trialloom.operators.selection import _take_trials

    out = data if trials is None else _take_trials(data, trials)
    discrete = out.kind in ("spike", "event")
    if trl is not None:
        return definetrial.plain(out, trl) if discrete else _recut(out, trial_table(out.spark, np.asarray(trl, float).tolist()))
    if minlength is not None:
        least = F.col("stop") - F.col("start") >= int(minlength * out.samplerate)
        out = out.having(trials=out.trials.where(least))
        if not discrete:
            out = out.having(facts=out.facts.join(out.trials.select("trial_id"), "trial_id", "left_semi"))
    if toilim is not None or begsample is not None:
        fs = out.samplerate
        if toilim is not None:
            a = F.greatest(F.round(F.lit(toilim[0] * fs)) - F.col("t0"), F.lit(0)).cast("long")
            b = F.least(F.round(F.lit(toilim[1] * fs)) - F.col("t0") + 1, F.col("stop") - F.col("start")).cast("long")
        else:
            a, b = F.lit(int(begsample)).cast("long"), F.lit(int(endsample)).cast("long")
            a, b = F.greatest(a, F.lit(0)), F.least(b, F.col("stop") - F.col("start"))
        spans = out.trials.select("trial_id", a.alias("a"), b.alias("b"), "start", "t0", "info").where("a < b")
        table = spans.select("trial_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"), (F.col("t0") + F.col("a")).alias("t0"), "info")
        if not discrete:
            s = spans.select("trial_id", "a", "b")
            facts = out.facts.join(s, "trial_id").where((F.col("sample") >= F.col("a")) & (F.col("sample") < F.col("b")))
            out = out.having(facts=facts.withColumn("sample", (F.col("sample") - F.col("a")).cast("int")).select(*out.facts.columns))
        out = out.having(trials=table)
    if offset is not None:
        out = out.having(trials=out.trials.withColumn("t0", F.lit(float(offset))))
    return out.having("trials redefined")


def _recut(data: Trials, table: DataFrame) -> Trials:
    """Continuous values in new trials, by absolute sample; overlapping trials share values."""
    absolute = data.facts.join(data.trials.select("trial_id", F.col("start").alias("s_")), "trial_id").select((F.col("sample") + F.col("s_")).alias("sample"), "channel_id", *data.values).dropDuplicates(["sample", "channel_id"])
    cut = cut_recording(absolute, table.select("trial_id", "start", "stop"), [])
    return data.having(facts=cut.select(*data.facts.columns), trials=table)
