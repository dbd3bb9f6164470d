"""Trial-structured data as DataFrames: facts, a trial table, labels and attributes.

Facts are in long form, one row per value:

=========  =======================================================================
analog     trial_id, sample, channel_id, value
spectral   trial_id, time_idx, taper_id, freq_id, channel_id, re, im
cross      trial_id, time_idx, freq_id, channel_i, channel_j, re, im
timelock   sample, channel_id, avg, var (with the single trials beside it)
spike      sample, channel, unit
event      sample, eventid, and further integer columns
=========  =======================================================================

``sample`` of analog data counts from the start of its trial, that of discrete
data is absolute.  Continuous data also has a block form, one row per trial and
channel with ``samples array<double>``, on which kernels that treat channels
apart run without a shuffle.
"""

from __future__ import annotations

import copy as _copy
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.errors import DataError
from trialloom.plans.tables import running_total

AXES = {
    "analog": ("sample", "channel_id"),
    "spectral": ("time_idx", "taper_id", "freq_id", "channel_id"),
    "cross": ("time_idx", "freq_id", "channel_i", "channel_j"),
    "timelock": ("sample", "channel_id"),
    "spike": ("sample", "channel", "unit"),
    "event": ("sample", "eventid"),
}
CONTINUOUS = ("analog", "spectral", "cross", "timelock")
VALUES = {"analog": ("value",), "timelock": ("value",), "spectral": ("re", "im"), "cross": ("re", "im"), "spike": (), "event": ()}
TRIAL_SCHEMA = "trial_id int, start long, stop long, t0 double, info array<double>"


@dataclass(frozen=True)
class Trials:
    """One data object; nothing is computed until an action, and nothing is changed in place."""

    kind: str
    facts: DataFrame
    trials: DataFrame
    samplerate: float
    labels: dict[str, list] = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    cfg: dict = field(default_factory=dict)
    log: tuple[str, ...] = ()
    extras: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in AXES:
            raise DataError(f"unknown kind {self.kind!r}; known: {', '.join(AXES)}")
        if not self.samplerate > 0:
            raise DataError("the sampling rate must be positive")

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[self.kind]

    @property
    def values(self) -> tuple[str, ...]:
        return tuple(c for c in VALUES[self.kind] if c in self.facts.columns)

    def having(self, note: str | None = None, **changes) -> Trials:
        """A copy with other parts, and a line in its log."""
        if note:
            changes["log"] = (*self.log, note)
        return replace(self, **changes)

    # S10: further tables that belong to the object
    def register(self, name: str, df: DataFrame) -> Trials:
        return self.having(extras={**self.extras, name: df})

    def unregister(self, name: str) -> Trials:
        return self.having(extras={k: v for k, v in self.extras.items() if k != name})

    def is_time_locked(self) -> bool:
        """All trials begin at the same time and have the same length."""
        r = self.trials.agg(F.countDistinct("t0").alias("a"), F.countDistinct(F.col("stop") - F.col("start")).alias("b")).first()
        return r["a"] <= 1 and r["b"] <= 1

    def shape_tail(self) -> tuple[int, ...] | None:
        """Lengths of the axes after time, from the labels; None if an axis has no labels."""
        names = {"channel_id": "channel", "freq_id": "freq", "taper_id": "taper", "channel_i": "channel_i", "channel_j": "channel_j"}
        found = [self.labels.get(names[a]) for a in self.axes[1:]]
        return None if any(not x for x in found) else tuple(len(x) for x in found)

    def lengths(self) -> DataFrame:
        """(trial_id, n): samples of each trial by the trial table, without a look at the facts."""
        return self.trials.select("trial_id", (F.col("stop") - F.col("start")).alias("n"))

    def intervals(self) -> DataFrame:
        """(trial_id, first, last): times of the first and last sample of each trial, in seconds."""
        return self.trials.select("trial_id", (F.col("t0") / self.samplerate).alias("first"), ((F.col("stop") - F.col("start") - 1 + F.col("t0")) / self.samplerate).alias("last"))

    def timed(self) -> DataFrame:
        """Facts with ``time`` in seconds relative to the trial's trigger."""
        if self.kind in ("spike", "event"):
            from trialloom.operators.trials import assign

            return assign(self)
        axis = self.axes[0]
        t = self.trials.select("trial_id", "t0")
        return self.facts.join(t, "trial_id").withColumn("time", (F.col(axis) + F.col("t0")) / self.samplerate).drop("t0")

    # P14: single trials on the driver
    @property
    def array(self) -> TrialIndexer:
        """``data.array[k]``: the values of one trial, (sample x channel) for analog data, rows of columns for discrete data."""
        return TrialIndexer(self)

    @property
    def time(self) -> TimeIndexer:
        """``data.time[k]``: the times of one trial's samples (or events) in seconds."""
        return TimeIndexer(self)

    def save(self, container: str | None = None, tag: str | None = None, overwrite: bool = False) -> Trials:
        """Save the object; without a place, again where it was saved or loaded last.  Returns the saved object."""
        from trialloom.sources import container as files

        place = self.cfg.get("saved", {})
        if container is None:
            if not place:
                raise DataError("the object was not saved before: name a container")
            container, tag, overwrite = place["container"], tag or place["tag"], True
        return files.load(self.spark, files.save(self, container, tag, overwrite))

    # operators of M1 to M4
    def __add__(self, other):
        return self._arith("+", other)

    def __radd__(self, other):
        return self._arith("+", other, True)

    def __sub__(self, other):
        return self._arith("-", other)

    def __rsub__(self, other):
        return self._arith("-", other, True)

    def __mul__(self, other):
        return self._arith("*", other)

    def __rmul__(self, other):
        return self._arith("*", other, True)

    def __truediv__(self, other):
        return self._arith("/", other)

    def __rtruediv__(self, other):
        return self._arith("/", other, True)

    def __pow__(self, other):
        return self._arith("**", other)

    def __rpow__(self, other):
        return self._arith("**", other, True)

    def _arith(self, op, other, swapped=False):
        from trialloom.operators.arithmetic import arithmetic

        return arithmetic(self, op, other, swapped)

    __hash__ = None

    def __eq__(self, other):
        from trialloom.operators.arithmetic import equal

        return equal(self, other)


class TrialIndexer:
    """Values of single trials by id, or of all one after another; each is collected by itself."""

    def __init__(self, data: Trials):
        self.data = data

    def ids(self) -> list[int]:
        return [r[0] for r in self.data.trials.select("trial_id").orderBy("trial_id").collect()]

    def __len__(self) -> int:
        return self.data.trials.count()

    def __iter__(self):
        return (self[k] for k in self.ids())

    def _one(self, k: int) -> int:
        if isinstance(k, bool) or not isinstance(k, (int, np.integer)):
            raise TypeError("a trial is chosen by its id")
        if self.data.trials.where(F.col("trial_id") == int(k)).isEmpty():
            raise IndexError(f"there is no trial {k}")
        return int(k)

    def __getitem__(self, k: int) -> np.ndarray:
        k, data = self._one(k), self.data
        if data.kind in ("spike", "event"):
            columns = [c for c in data.facts.columns if c != "trial_id"]
            return data.timed().where(F.col("trial_id") == k).select(*columns).orderBy(*columns).toPandas().to_numpy()
        axes = [c for c in data.axes if c in data.facts.columns]
        pdf = data.facts.where(F.col("trial_id") == k).select(*axes, *data.values).toPandas()
        # time and frequency count from 0; channels and tapers are those that occur
        levels = [np.arange(pdf[c].max() + 1) if c in ("sample", "time_idx", "freq_id") and len(pdf) else np.unique(pdf[c]) for c in axes]
        out = np.full([len(x) for x in levels], np.nan, complex if "im" in data.values else float)
        at = tuple(np.searchsorted(x, pdf[c]) for x, c in zip(levels, axes))
        out[at] = pdf["re"] + 1j * pdf["im"] if "im" in data.values else pdf[data.values[0]]
        return out


class TimeIndexer(TrialIndexer):
    """Times of single trials."""

    def __getitem__(self, k: int) -> np.ndarray:
        k, data = self._one(k), self.data
        if data.kind in ("spike", "event"):
            return np.array([r[0] for r in data.timed().where(F.col("trial_id") == k).select("time").orderBy("time").collect()])
        r = data.trials.where(F.col("trial_id") == k).first()
        return (np.arange(r["stop"] - r["start"]) + r["t0"]) / data.samplerate


def copy(data: Trials) -> Trials:
    """An independent object on the same immutable tables."""
    return replace(data, labels=_copy.deepcopy(data.labels), info=_copy.deepcopy(data.info), cfg=_copy.deepcopy(data.cfg), extras=dict(data.extras))


def default_labels(axis: str, n: int) -> list[str]:
    """channel1 ... , zero-padded to the width of the count."""
    width = len(str(n))
    return [f"{axis}{i + 1:0{width}d}" for i in range(n)]


def to_blocks(long: DataFrame, keys: list[str], order: str, value: str, samples: str = "samples") -> DataFrame:
    """One row per ``keys`` with its values in order; a null value becomes NaN."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(samples))


def to_long(blocks: DataFrame, keys: list[str], order: str = "sample", value: str = "value", samples: str = "samples") -> DataFrame:
    return blocks.select(*keys, F.posexplode(samples).alias(order, value))


def trial_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The trial table of (start, stop, t0, *info) rows, numbered from 0."""
    return spark.createDataFrame([(i, int(r[0]), int(r[1]), float(r[2]), [float(x) for x in r[3:]]) for i, r in enumerate(rows)], TRIAL_SCHEMA)


def analog_from_arrays(spark: SparkSession, arrays, samplerate: float, channel: list[str] | None = None, t0: float | None = None) -> Trials:
    """Trials given as (sample x channel) arrays; they lie one after another and start at -1 s by default."""
    ids, series, defs, at, n_ch = [], [], [], 0, None
    for k, a in enumerate(arrays):
        a = np.asarray(a, float)
        a = a[:, None] if a.ndim == 1 else a
        if n_ch not in (None, a.shape[1]):
            raise DataError("all trials need the same channels")
        n_ch = a.shape[1]
        ids += [(k, c) for c in range(n_ch)]
        series += [np.ascontiguousarray(a[:, c]) for c in range(n_ch)]
        defs.append((at, at + len(a), -samplerate if t0 is None else t0))
        at += len(a)
    # values go to Spark as Arrow columns, not as Python numbers
    whole = np.concatenate(series) if series else np.zeros(0)
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in series]))).astype(np.int64)
    samples = pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(whole))
    trial, ch = (pa.array([x[i] for x in ids], pa.int32()) for i in range(2))
    blocks = spark.createDataFrame(pa.table([trial, ch, samples], ["trial_id", "channel_id", "samples"]), "trial_id int, channel_id int, samples array<double>")
    labels = {"channel": list(channel) if channel else default_labels("channel", n_ch or 0)}
    if n_ch is not None and len(labels["channel"]) != n_ch:
        raise DataError("as many channel labels as channels, please")
    return Trials("analog", to_long(blocks, ["trial_id", "channel_id"]), trial_table(spark, defs), samplerate, labels)


def make(spark: SparkSession, source, samplerate: float | None = None, trialdefinition=None, kind: str = "analog", **options) -> Trials:
    """An object from what there is: arrays (or a generator of them), a table of facts, a saved object's path, objects to join, or nothing.

    Discrete facts need a ``trialdefinition`` (rows of start, stop, t0, ...) or
    become one trial; ``options`` go to ``analog_from_arrays``, or are further
    fields of the object.
    """
    if isinstance(source, str):
        from trialloom.sources.container import load

        return load(spark, source)
    if source is None:
        columns = {"analog": "trial_id int, sample int, channel_id int, value double", "spike": "sample long, channel int, unit int", "event": "sample long, eventid int"}
        return Trials(kind, spark.createDataFrame([], columns[kind]), spark.createDataFrame([], TRIAL_SCHEMA), samplerate or 1.0, **options)
    if isinstance(source, DataFrame):
        from trialloom.operators.trials import definetrial

        if samplerate is None:
            raise DataError("facts need a sampling rate")
        x = Trials(kind, source, spark.createDataFrame([], TRIAL_SCHEMA), samplerate, **options)
        if trialdefinition is not None:
            return definetrial.plain(x, trialdefinition)
        if kind in ("spike", "event"):
            return definetrial.plain(x)
        n = source.groupBy("trial_id").agg((F.max("sample") + 1).cast("long").alias("n")).select("trial_id", F.lit(0.0).alias("t0"), F.array().cast("array<double>").alias("info"), "n")
        return x.having(trials=restack(n).select("trial_id", "start", "stop", "t0", "info"))
    if isinstance(source, np.ndarray) and source.ndim <= 2:
        source = [source]
    source = list(source)
    if source and all(isinstance(x, Trials) for x in source):
        return concat_trials(source)
    if samplerate is None:
        raise DataError("arrays need a sampling rate")
    x = analog_from_arrays(spark, source, samplerate, **options)
    if trialdefinition is None:
        return x
    from trialloom.operators.trials import redefinetrial

    return redefinetrial.plain(x, trl=trialdefinition)


def concat_trials(parts: list[Trials]) -> Trials:
    """Objects of one kind one after another along trials (M8); labels and rates must agree."""
    first = parts[0]
    for p in parts[1:]:
        if (p.kind, p.samplerate, p.labels) != (first.kind, first.samplerate, first.labels):
            raise DataError("objects differ in kind, sampling rate or labels")
    facts, trials, before, at = None, None, 0, 0
    for p in parts:
        stats = p.trials.agg(F.coalesce(F.max("trial_id") + 1, F.lit(0)).alias("n"), F.coalesce(F.max("stop"), F.lit(0)).alias("end")).first()
        f = p.facts.withColumn("trial_id", (F.col("trial_id") + before).cast("int"))
        t = p.trials.select((F.col("trial_id") + before).cast("int").alias("trial_id"), (F.col("start") + at).alias("start"), (F.col("stop") + at).alias("stop"), "t0", "info")
        facts, trials = (f, t) if facts is None else (facts.unionByName(f), trials.unionByName(t))
        before, at = before + stats["n"], at + stats["end"]
    return first.having("trials joined", facts=facts, trials=trials)


def restack(trials: DataFrame, length: str = "n") -> DataFrame:
    """New starts and stops of trials put one after another in the order of their ids (P16)."""
    placed = running_total(trials.drop("start", "stop"), "trial_id", length, "start").withColumn("stop", F.col("start") + F.col(length))
    rest = [c for c in placed.columns if c not in ("trial_id", "start", "stop")]
    return placed.select("trial_id", "start", "stop", *rest)
