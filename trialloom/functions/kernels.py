"""User-defined kernels: a NumPy function of one trial, with its output schema, run on every trial."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError
from trialloom.model import Trials, to_blocks


@dataclass(frozen=True)
class TrialKernel:
    """``function(x, **options)`` takes a (time x channel) array of a trial and returns one of the same kind, of any length.

    ``channelwise`` kernels get one channel at a time, in any number of tasks;
    others need all channels of a trial together.  ``trials`` may change the
    trial table, e.g. for another rate; ``labels`` the labels.
    """

    name: str
    function: Callable
    channelwise: bool = True
    trials: Callable | None = None
    labels: Callable | None = None
    options: dict = field(default_factory=dict)

    def __call__(self, data: Trials, keeptrials: bool = True, **options) -> Trials:
        if data.kind != "analog":
            raise DataError("kernels run on analog data")
        options = {**self.options, **options}
        function, channelwise = self.function, self.channelwise
        blocks = to_blocks(data.facts, ["trial_id", "channel_id"], "sample", "value")
        out = "trial_id int, channel_id int, samples array<double>"

        def per_channel(batches):
            for pdf in batches:
                rows = [np.asarray(function(np.asarray(x, float)[:, None], **options), float)[:, 0] for x in pdf["samples"]]
                yield pd.DataFrame({"trial_id": pdf["trial_id"], "channel_id": pdf["channel_id"], "samples": rows})

        def per_trial(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("channel_id")
            y = np.asarray(function(np.stack(pdf["samples"].to_numpy()).astype(float).T, **options), float)
            return pd.DataFrame({"trial_id": pdf["trial_id"].iloc[0], "channel_id": np.arange(y.shape[1], dtype=np.int32), "samples": list(y.T)})

        mapped = blocks.mapInPandas(per_channel, out) if channelwise else blocks.groupBy("trial_id").applyInPandas(per_trial, out)
        facts = mapped.select("trial_id", "channel_id", F.posexplode("samples").alias("sample", "value")).select("trial_id", "sample", "channel_id", "value")
        result = data.having(self.name, facts=facts, trials=self.trials(data) if self.trials else data.trials, labels=self.labels(data) if self.labels else data.labels)
        if not keeptrials:
            from trialloom.operators.statistics import _statistic

            result = _statistic(result, "mean", "trials", True)
        return result


REGISTRY: dict[str, TrialKernel] = {}


def register(kernel: TrialKernel) -> TrialKernel:
    if kernel.name in REGISTRY:
        raise ParameterError(f"there is a kernel {kernel.name!r} already")
    REGISTRY[kernel.name] = kernel
    return kernel
