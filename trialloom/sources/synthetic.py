"""Synthetic trials, generated in parallel, each from its own seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trialloom.model import Trials, default_labels, to_long


def trials_of(spark: SparkSession, make, n_trials: int, n_samples: int, n_channels: int, samplerate: float, seed: int | None = None, t0: float | None = None) -> Trials:
    """Trials from ``make(rng, trial)``, which gives a (sample x channel) array; trial k has the k-th seed derived from ``seed``."""
    root = np.random.SeedSequence(seed).generate_state(1)[0]

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                x = make(np.random.default_rng([int(root), int(k)]), int(k))
                rows += [(k, c, x[:, c]) for c in range(x.shape[1])]
            yield pd.DataFrame(rows, columns=["trial_id", "channel_id", "samples"])

    blocks = spark.range(n_trials).mapInPandas(run, "trial_id int, channel_id int, samples array<double>")
    ids = spark.range(n_trials)
    trials = ids.select(
        F.col("id").cast("int").alias("trial_id"), (F.col("id") * n_samples).alias("start"), ((F.col("id") + 1) * n_samples).alias("stop"),
        F.lit(-float(samplerate) if t0 is None else float(t0)).alias("t0"), F.array().cast("array<double>").alias("info"),
    )
    return Trials("analog", to_long(blocks, ["trial_id", "channel_id"]), trials, samplerate, {"channel": default_labels("channel", n_channels)})


def white_noise(spark, n_trials=10, n_samples=1000, n_channels=2, samplerate=1000.0, seed=None) -> Trials:
    return trials_of(spark, lambda rng, k: rng.normal(size=(n_samples, n_channels)), n_trials, n_samples, n_channels, samplerate, seed)


def linear_trend(spark, n_trials=10, n_samples=1000, n_channels=2, samplerate=1000.0, y_max=1.0) -> Trials:
    ramp = np.linspace(0, y_max, n_samples)
    return trials_of(spark, lambda rng, k: np.tile(ramp[:, None], n_channels), n_trials, n_samples, n_channels, samplerate)


def harmonic(spark, freq, n_trials=10, n_samples=1000, n_channels=2, samplerate=1000.0) -> Trials:
    wave = np.cos(2 * np.pi * freq * np.arange(n_samples) / samplerate)
    return trials_of(spark, lambda rng, k: np.tile(wave[:, None], n_channels), n_trials, n_samples, n_channels, samplerate)


def phase_diffusion(spark, freq, eps=0.1, n_trials=10, n_samples=1000, n_channels=2, samplerate=1000.0, fix_initial_phase=False, return_phase=False, seed=None) -> Trials:
    """Cosines whose phase does a Brownian walk about a constant rotation."""

    def make(rng, k):
        step = 2 * np.pi * freq / samplerate + eps * rng.normal(size=(n_samples, n_channels))
        start = 0.0 if fix_initial_phase else rng.uniform(0, 2 * np.pi, n_channels)
        phase = np.cumsum(step, axis=0) - step[:1] + start
        return phase if return_phase else np.cos(phase)

    return trials_of(spark, make, n_trials, n_samples, n_channels, samplerate, seed)


def ar2_network(spark, adjacency=None, n_trials=10, n_samples=1000, samplerate=1000.0, alphas=(0.55, -0.8), seed=None) -> Trials:
    """Coupled AR(2) processes; the entry [i, j] of ``adjacency`` couples i to j."""
    a = np.zeros((2, 2)) if adjacency is None else np.asarray(adjacency, float)
    n = len(a)
    first = alphas[0] * np.eye(n) + a.T

    def make(rng, k):
        x = np.zeros((n_samples, n))
        x[:2] = rng.normal(size=(2, n))
        noise = rng.normal(size=(n_samples, n))
        for i in range(2, n_samples):
            x[i] = first @ x[i - 1] + alphas[1] * x[i - 2] + noise[i]
        return x

    return trials_of(spark, make, n_trials, n_samples, n, samplerate, seed)


def ar2_peak_freq(a1: float, a2: float, samplerate: float = 1.0) -> float:
    """Frequency of the spectral peak of an AR(2) process."""
    if a1**2 + 4 * a2 > 0:
        raise ValueError("no spectral peak for these parameters")
    return float(np.arccos(a1 * (a2 - 1) / (4 * a2)) / (2 * np.pi) * samplerate)


def random_adjacency(n: int = 3, conn_thresh: float = 0.25, max_coupling: float = 0.25, seed=None) -> np.ndarray:
    """Random couplings: links below a threshold of uniform draws, none of a node with itself."""
    rng = np.random.default_rng(seed)
    a = (rng.uniform(size=(n, n)) < conn_thresh) * rng.uniform(0.2 * max_coupling, max_coupling, size=(n, n))
    np.fill_diagonal(a, 0)
    return a


def red_noise(spark, alpha=0.9, n_trials=10, n_samples=1000, n_channels=2, samplerate=1000.0, seed=None) -> Trials:
    """AR(1) processes."""

    def make(rng, k):
        noise = rng.normal(size=(n_samples, n_channels))
        x = np.empty_like(noise)
        x[0] = noise[0]
        for i in range(1, n_samples):
            x[i] = alpha * x[i - 1] + noise[i]
        return x

    return trials_of(spark, make, n_trials, n_samples, n_channels, samplerate, seed)


def poisson_noise(spark, n_trials=10, n_spikes=10_000, n_channels=3, n_units=10, intensity=0.1, samplerate=10_000.0, seed=None) -> Trials:
    """Spikes with exponential gaps, on random channels and units; earlier units are more frequent."""
    length = int(n_spikes / intensity / n_trials)
    per_trial = n_spikes // n_trials
    root = int(np.random.SeedSequence(seed).generate_state(1)[0])
    weight = 1 / np.arange(1, n_units + 1)

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                rng = np.random.default_rng([root, int(k)])
                at = np.minimum(np.cumsum(rng.geometric(min(intensity, 1.0), per_trial)) - 1, length - 1)
                yield pd.DataFrame({"sample": k * length + at, "channel": rng.integers(0, n_channels, per_trial), "unit": rng.choice(n_units, per_trial, p=weight / weight.sum())})

    facts = spark.range(n_trials).mapInPandas(run, "sample long, channel int, unit int")
    trials = spark.range(n_trials).select(F.col("id").cast("int").alias("trial_id"), (F.col("id") * length).alias("start"), ((F.col("id") + 1) * length).alias("stop"), F.lit(-0.1 * length).cast("double").alias("t0"), F.array().cast("array<double>").alias("info"))
    return Trials("spike", facts, trials, samplerate, {"channel": default_labels("channel", n_channels), "unit": default_labels("unit", n_units)}, {"channel_codes": list(range(n_channels)), "unit_codes": list(range(n_units))})
