"""Event streams: windowed counts with late data, and trials cut around triggers as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and key; events later than ``late`` behind the newest are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n")


def trials_from_stream(events: DataFrame, key: str, start: int, stop: int, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(key, first, last): a trial from each start code to the next stop code of its recording, across batches.

    A further start before the stop begins the trial anew.  The state is one
    open start per recording; it expires with the watermark.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_at = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("sample")
        out = []
        for sample, code in zip(rows["sample"], rows["eventid"]):
            if code == start:
                open_at = int(sample)
            elif code == stop and open_at is not None:
                out.append((k[0], open_at, int(sample)))
                open_at = None
        if open_at is not None:
            state.update((open_at,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows[time].max().timestamp() * 1000) + 3_600_000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first", "last"])

    slim = events.withWatermark(time, late).where(F.col("eventid").isin([start, stop])).select(key, "sample", "eventid", time)
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first long, last long", "open long", "append", GroupStateTimeout.EventTimeTimeout)
