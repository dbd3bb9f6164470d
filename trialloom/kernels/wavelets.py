"""Wavelet and superlet transforms as filter banks; arrays are (..., time), results (..., scale or frequency, time).

A bank is the matrix of all filters of one transform, sampled on the taps of
the longest and zero beyond each one's own support.  The signal is
transformed once, multiplied by the spectra of the bank, and all filters come
back in one inverse transform.  Mother wavelets and their constants are those
of Torrence and Compo (1998).
"""

from __future__ import annotations

import math

import numpy as np

# Length of a filter in scales, and the factors by which amplitudes of the two transforms are scaled.
SUPPORT = 10.0
WAVELET_FACTOR = 1 / (8 * math.pi)
SUPERLET_FACTOR = 1 / (4 * math.pi)
SUPERLET_SPREAD = 5.0  # standard deviations of the Gaussian that a superlet's cycles cover
# Fixed values of the literature: reconstruction factors of (wavelet, parameter).
RECONSTRUCTION = {("Morlet", 6): 0.776, ("Paul", 4): 1.132, ("DOG", 2): 3.541, ("DOG", 6): 1.966}

MOST = 1 << 22  # values of an intermediate array; more filters are taken in several goes


# --- mother wavelets, of time and of angular frequency, without units ------------------------------------------------


def morlet(x, w0=6.0):
    return np.pi**-0.25 * (np.exp(1j * w0 * x) - np.exp(-0.5 * w0**2)) * np.exp(-0.5 * x**2)


def paul(x, m=4):
    return 2**m * 1j**m * math.factorial(m) / math.sqrt(math.pi * math.factorial(2 * m)) * (1 - 1j * x) ** -(m + 1)


def dog(x, m=2):
    """Derivative of a Gaussian; m = 2 is the Ricker wavelet."""
    hermite = np.polynomial.hermite_e.hermeval(x, [0] * m + [1])
    return -hermite * np.exp(-0.5 * x**2) / math.sqrt(math.gamma(m + 0.5))


def morlet_spectrum(w, w0=6.0):
    return np.where(w > 0, np.pi**-0.25 * np.exp(-0.5 * (w - w0) ** 2), 0)


def paul_spectrum(w, m=4):
    v = np.maximum(w, 0)
    return 2**m / math.sqrt(m * math.factorial(2 * m - 1)) * v**m * np.exp(-v)


def dog_spectrum(w, m=2):
    return -(1j**m) / math.sqrt(math.gamma(m + 0.5)) * w**m * np.exp(-0.5 * w**2)


WAVELETS = {"Morlet": (morlet, 6.0), "Paul": (paul, 4), "DOG": (dog, 2), "Ricker": (dog, 2), "Marr": (dog, 2), "Mexican_hat": (dog, 2)}
SPECTRA = {morlet: morlet_spectrum, paul: paul_spectrum, dog: dog_spectrum}


def period_of(name: str, scale, par: float):
    """The Fourier period of a scale."""
    if name == "Morlet":
        return 4 * np.pi * scale / (par + math.sqrt(2 + par**2))
    if name == "Paul":
        return 4 * np.pi * scale / (2 * par + 1)
    return 2 * np.pi * scale / math.sqrt(par + 0.5)


def scale_of(name: str, period, par: float):
    return period / period_of(name, 1.0, par)


def default_scales(name: str, n: int, samplerate: float, par: float, per_octave: int = 4) -> np.ndarray:
    """From two samples' period to the signal's length in steps of a quarter octave, low frequency first."""
    dt = 1 / samplerate
    s0 = scale_of(name, 2 * dt, par)
    top = int(per_octave * math.log2(max(n * dt / s0, 1)))
    return (s0 * 2 ** (np.arange(top + 1) / per_octave))[::-1]


# --- filter banks ----------------------------------------------------------------------------------------------------


def bank(spans: np.ndarray, samplerate: float, shape) -> tuple[np.ndarray, np.ndarray]:
    """Filters (filter x tap), and the tap of each that lies at lag zero.

    ``spans`` are the supports in samples, whole or not; taps lie
    symmetrically about time zero.  ``shape`` gives the filters for times
    (filter x tap, in seconds).
    """
    spans = np.asarray(spans, float)
    taps = np.maximum(np.ceil(spans - 1e-9).astype(int), 1)
    tap = np.arange(taps.max())
    times = (tap - 0.5 * (spans[:, None] - 1)) / samplerate
    return np.where(tap < taps[:, None], shape(times), 0), (taps - 1) // 2


def through(x: np.ndarray, filters: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Convolution of the last axis with each filter, as long as the signal: complex (..., filter, time)."""
    n = x.shape[-1]
    size = 1 << max(0, n + filters.shape[1] - 2).bit_length()
    signal = np.fft.fft(x, size)[..., None, :]
    turn = np.exp(2j * np.pi * np.fft.fftfreq(size) * zero[:, None])  # moves lag zero to the first place
    out = np.empty((*x.shape[:-1], len(filters), n), complex)
    group = max(1, MOST // max(1, signal.size))
    for i in range(0, len(filters), group):
        part = slice(i, i + group)
        out[..., part, :] = np.fft.ifft(signal * (np.fft.fft(filters[part], size) * turn[part]))[..., :n]
    return out


def cwt(x: np.ndarray, samplerate: float, scales: np.ndarray, name: str = "Morlet", par: float | None = None) -> np.ndarray:
    """Continuous wavelet transform with filters that end at ``SUPPORT`` scales: complex (..., scale, time)."""
    shape, usual = WAVELETS[name]
    s = np.asarray(scales, float)[:, None]
    weight = WAVELET_FACTOR / (s * math.sqrt(samplerate))
    return through(x, *bank(SUPPORT * s[:, 0] * samplerate, samplerate, lambda t: weight * shape(t / s, usual if par is None else par)))


def superlet(x: np.ndarray, samplerate: float, foi: np.ndarray, order_max: int, order_min: int = 1, c_1: float = 3, adaptive: bool = False) -> np.ndarray:
    """Geometric mean of Morlet transforms with rising numbers of cycles (..., frequency, time).

    Adaptive: the order rises linearly from the lowest to the highest frequency, a
    fractional order taking the next transform to that power.
    """
    foi = np.asarray(foi, float)
    if adaptive:
        span = foi.max() - foi.min()
        orders = order_min + (order_max - order_min) * ((foi - foi.min()) / span if span else np.zeros(len(foi)))
    else:
        orders = np.full(len(foi), float(order_max))
    out = np.ones((*x.shape[:-1], len(foi), x.shape[-1]), complex)
    for order in range(order_min, math.ceil(orders.max()) + 1):
        part = np.clip(orders - order + 1, 0, 1)  # 1 for whole orders, the fraction for the last
        use = np.flatnonzero(part > 0)
        if len(use):
            f, cycles = foi[use, None], c_1 * order
            sd = cycles / (SUPERLET_SPREAD * f)  # of the envelope, seconds
            weight = SUPERLET_FACTOR / (math.sqrt(2 * np.pi * samplerate) * sd)
            spans = SUPPORT * cycles * samplerate / (2 * np.pi * f[:, 0])
            z = through(x, *bank(spans, samplerate, lambda t: weight * np.exp(2j * np.pi * f * t - 0.5 * (t / sd) ** 2)))
            out[..., use, :] *= np.power(z, (part / (orders - order_min + 1))[use, None])
    return out


# --- what follows from a transform on scales s0 * 2^(j * dj), by Torrence and Compo ----------------------------------


def periodic_cwt(x: np.ndarray, samplerate: float, scales: np.ndarray, name: str = "Morlet", par: float | None = None) -> np.ndarray:
    """The transform by the wavelet's analytic spectrum, with unit energy at each scale; the signal is continued by zeros to a power of 2."""
    shape, usual = WAVELETS[name]
    n, s = x.shape[-1], np.asarray(scales, float)[:, None]
    size = 1 << max(0, n - 1).bit_length()
    w = 2 * np.pi * samplerate * np.fft.fftfreq(size)
    daughters = np.sqrt(2 * np.pi * s * samplerate) * SPECTRA[shape](s * w, usual if par is None else par)
    return np.fft.ifft(np.fft.fft(x, size)[..., None, :] * np.conj(daughters))[..., :n]


def cone_of_influence(name: str, scale):
    """The e-folding time at the edges of a scale."""
    return scale / math.sqrt(2) if name == "Paul" else scale * math.sqrt(2)


def outside_cone(n: int, samplerate: float, scales: np.ndarray, name: str) -> np.ndarray:
    """(scale, time): whether a value is free of the signal's edges."""
    t, edge = np.arange(n) / samplerate, cone_of_influence(name, np.asarray(scales, float))[:, None]
    return (edge < t) & (t < t[-1] - edge)


def reconstruction_factor(name: str, par: float, dj: float = 0.125, n: int = 4096) -> float:
    """C_delta: the published one, else from the transform of an impulse on scales of step ``dj``."""
    shape, _ = WAVELETS[name]
    family = {paul: "Paul", morlet: "Morlet"}.get(shape, "DOG")
    if (family, par) in RECONSTRUCTION:
        return RECONSTRUCTION[family, par]
    first = scale_of(name, 2.0, par) / 16  # an impulse has power at all frequencies
    scales = first * 2 ** (dj * np.arange(int(math.log2(n / first) / dj) + 1))
    impulse = np.zeros(n)
    impulse[n // 2] = 1.0
    at = periodic_cwt(impulse, 1.0, scales, name, par)[:, n // 2]
    return float(dj / shape(0.0, par).real * (at.real / np.sqrt(scales)).sum())


def reconstruct(z: np.ndarray, samplerate: float, scales: np.ndarray, dj: float, name: str = "Morlet", par: float | None = None, mean=0.0) -> np.ndarray:
    """The signal (..., time) whose ``periodic_cwt`` less its mean is ``z``."""
    shape, usual = WAVELETS[name]
    par = usual if par is None else par
    s = np.asarray(scales, float)[:, None]
    return dj / (math.sqrt(samplerate) * reconstruction_factor(name, par) * shape(0.0, par).real) * (z.real / np.sqrt(s)).sum(axis=-2) + mean


def wavelet_power(z: np.ndarray, scales: np.ndarray | None = None) -> np.ndarray:
    """Squared size; divided by the scale if ``scales`` are given, which takes the bias to low frequencies away."""
    power = np.abs(z) ** 2
    return power if scales is None else power / np.asarray(scales, float)[:, None]


def global_spectrum(power: np.ndarray, variance, free: np.ndarray | None = None) -> np.ndarray:
    """Mean power of each scale over time, in units of the signal's variance; only where ``free`` if given, NaN without such a time."""
    if free is None:
        return power.mean(axis=-1) / variance
    n = free.sum(axis=-1)
    return np.where(n > 0, np.where(free, power, 0).sum(axis=-1) / np.maximum(n, 1), np.nan) / variance


def wavelet_variance(z: np.ndarray, samplerate: float, scales: np.ndarray, dj: float, name: str = "Morlet", par: float | None = None) -> np.ndarray:
    """Variance of the signal from its ``periodic_cwt``."""
    par = WAVELETS[name][1] if par is None else par
    s = np.asarray(scales, float)[:, None]
    return dj / (samplerate * reconstruction_factor(name, par) * z.shape[-1]) * (np.abs(z) ** 2 / s).sum(axis=(-2, -1))
