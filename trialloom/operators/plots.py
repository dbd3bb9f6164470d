"""Tables that are ready to plot: x, y and what separates series and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.errors import DataError
from trialloom.model import Trials
from trialloom.operators import trials as tr

MOST_PANELS = 25


def lines(data: Trials, trial: int = 0, shift: bool = False) -> DataFrame:
    """(panel, series, x, y) of analog data over time, or of spectra over frequency in log10 of power.

    ``shift`` stacks channels by the largest range of values.
    """
    if data.kind in ("analog", "timelock"):
        one = data.having(facts=data.facts.where(F.col("trial_id") == trial))
        rows = one.timed().select("channel_id", F.col("time").alias("x"), F.col("value").alias("y"))
    elif data.kind == "spectral":
        freq = F.array(*[F.lit(float(f)) for f in data.labels["freq"]])
        y = F.log10("re") if "im" not in data.values else F.log10(F.hypot("re", "im"))
        rows = data.facts.where((F.col("trial_id") == trial) & (F.col("time_idx") == 0)).select("channel_id", F.element_at(freq, F.col("freq_id") + 1).alias("x"), y.alias("y"))
    else:
        raise DataError("lines show time series or spectra")
    if shift:
        span = rows.groupBy("channel_id").agg((F.max("y") - F.min("y")).alias("r")).agg(F.max("r").alias("r"))
        rows = rows.join(F.broadcast(span)).withColumn("y", F.col("y") - F.col("channel_id") * F.col("r")).drop("r")
    names = F.array(*[F.lit(c) for c in data.labels["channel"]])
    return rows.select(F.lit(0).alias("panel"), F.element_at(names, F.col("channel_id") + 1).alias("series"), "x", "y")


def panels(data: Trials, trial: int = 0) -> DataFrame:
    """The lines with one panel per channel, at most 25."""
    if len(data.labels["channel"]) > MOST_PANELS:
        raise DataError(f"at most {MOST_PANELS} panels; select channels first")
    at = F.array_position(F.array(*[F.lit(c) for c in data.labels["channel"]]), F.col("series")) - 1
    return lines(data, trial).withColumn("panel", at.cast("int"))


def raster(data: Trials, by: str = "unit") -> DataFrame:
    """(trial_id, x, y) of spikes: time in the trial, and unit or channel."""
    return tr.assign(data, every=True).select("trial_id", F.col("time").alias("x"), F.col(by).alias("y"))
