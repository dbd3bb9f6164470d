"""Spectra of signals; arrays are (..., time), results (..., taper, [time,] frequency)."""

from __future__ import annotations

import math

import numpy as np

from trialloom.kernels.windows import tapers


def detrend(x: np.ndarray, order: int | None) -> np.ndarray:
    """Along the last axis: nothing, the mean or the least-squares line is taken away."""
    if order is None:
        return x
    x = x - x.mean(axis=-1, keepdims=True)
    if order == 1:
        t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2.0
        norm = (t * t).sum()
        if norm:
            x = x - (x @ t)[..., None] / norm * t
    return x


def padded_length(n_max: int, pad, samplerate: float) -> int:
    """Samples of all trials after zero padding: 'maxperlen', 'nextpow2' or seconds."""
    if pad == "maxperlen":
        return n_max
    if pad == "nextpow2":
        return 1 << max(0, int(n_max - 1).bit_length())
    if isinstance(pad, bool) or not isinstance(pad, (int, float)) or pad * samplerate < n_max - 1e-9:
        raise ValueError("pad must be 'maxperlen', 'nextpow2' or seconds that cover the longest trial")
    return int(round(pad * samplerate))


def mtmfft(x: np.ndarray, samplerate: float, total: int | None = None, taper: str | None = None, options: dict | None = None, order: int | None = None, demean_taper: bool = False, compat: bool = False):
    """Tapered Fourier transform: complex (..., taper, frequency), and the frequencies."""
    n = x.shape[-1]
    total = total or n
    w = tapers(taper, n, total, options)
    y = detrend(np.asarray(x, float), order)[..., None, :] * w
    if demean_taper:
        y = y - y.mean(axis=-1, keepdims=True)
    scale = math.sqrt(2) / (total if compat else math.sqrt(total * n))
    return np.fft.rfft(y, n=total, axis=-1) * scale, np.fft.rfftfreq(total, 1 / samplerate)


def sliding_fft(x: np.ndarray, samplerate: float, width: int, centres: np.ndarray, taper: str | None = None, options: dict | None = None, order: int | None = None):
    """Windows of ``width`` samples about ``centres``, zeros beyond the signal: complex (..., time, taper, frequency)."""
    half = width // 2
    w = tapers(taper, width, width, options)
    padded = np.concatenate([np.zeros((*x.shape[:-1], half)), x, np.zeros((*x.shape[:-1], width))], axis=-1)
    index = np.asarray(centres)[:, None] + np.arange(width)
    pieces = detrend(padded[..., index], order)
    y = pieces[..., None, :] * w
    return np.fft.rfft(y, axis=-1) * (math.sqrt(2) / width), np.fft.rfftfreq(width, 1 / samplerate)


# --- parametrised spectra ------------------------------------------------------------------------------------------


def fit_peaks(freqs: np.ndarray, power: np.ndarray, max_peaks: int = 12, threshold: float = 2.0, least_height: float = 0.0, width: tuple[float, float] = (0.5, 12.0)):
    """A power spectrum as an aperiodic part and Gaussian peaks over it, both in log10 units.

    A line is fitted to log power over log frequency, once to all and again to
    the lowest quarter of what remains; the largest remaining peaks are taken
    off one by one while they stand out by ``threshold`` standard deviations,
    then fitted together by damped Gauss-Newton steps; the line is fitted again
    without them.  Returns (offset, exponent), peaks (centre, height, width),
    the aperiodic part, the peaks and the full model.
    """
    if freqs[0] <= 0:
        raise ValueError("the frequency 0 cannot be fitted; leave it out")
    lf, lp = np.log10(freqs), np.log10(np.maximum(power, 1e-300))

    def line(use):
        a = np.stack([np.ones(use.sum()), lf[use]], axis=1)
        return np.linalg.lstsq(a, lp[use], rcond=None)[0]

    c = line(np.ones(len(freqs), bool))
    flat = lp - (c[0] + c[1] * lf)
    c = line(np.maximum(flat, 0) <= np.percentile(np.maximum(flat, 0), 25) + 1e-12)
    flat = lp - (c[0] + c[1] * lf)
    step = freqs[1] - freqs[0] if len(freqs) > 1 else 1.0
    rest, guess = flat.copy(), []
    while len(guess) < max_peaks:
        i = int(np.argmax(rest))
        height = rest[i]
        if height <= threshold * rest.std() or height <= least_height:
            break
        left = next((i - j for j in range(i, -1, -1) if rest[j] <= height / 2), len(freqs))
        right = next((j - i for j in range(i, len(freqs)) if rest[j] <= height / 2), len(freqs))
        sd = np.clip(2 * min(left, right) * step / 2.3548, width[0] / 2, width[1] / 2)
        guess.append([freqs[i], height, sd])
        rest = rest - height * np.exp(-0.5 * ((freqs - freqs[i]) / sd) ** 2)
    edge = [g for g in guess if g[0] - freqs[0] > g[2] and freqs[-1] - g[0] > g[2]]
    peaks = _refine(freqs, flat, np.array(edge), width) if edge else np.zeros((0, 3))
    bumps = sum((h * np.exp(-0.5 * ((freqs - m) / s) ** 2) for m, h, s in peaks), np.zeros(len(freqs)))
    a = np.stack([np.ones(len(freqs)), lf], axis=1)
    c = np.linalg.lstsq(a, lp - bumps, rcond=None)[0]
    aperiodic = c[0] + c[1] * lf
    return (float(c[0]), float(-c[1])), peaks, aperiodic, bumps, aperiodic + bumps


def _refine(f: np.ndarray, y: np.ndarray, p: np.ndarray, width: tuple[float, float]) -> np.ndarray:
    damp = 1e-2

    def model(q):
        return (q[:, 1, None] * np.exp(-0.5 * ((f - q[:, 0, None]) / q[:, 2, None]) ** 2)).sum(axis=0)

    err = ((y - model(p)) ** 2).sum()
    for _ in range(60):
        d = (f - p[:, 0, None]) / p[:, 2, None]
        e = np.exp(-0.5 * d**2)
        jac = np.stack([p[:, 1, None] * e * d / p[:, 2, None], e, p[:, 1, None] * e * d**2 / p[:, 2, None]], axis=1).reshape(-1, len(f))
        a = jac @ jac.T
        move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), jac @ (y - model(p)), rcond=None)[0].reshape(p.shape)
        q = p + move
        q[:, 0] = np.clip(q[:, 0], f[0], f[-1])
        q[:, 1] = np.maximum(q[:, 1], 0)
        q[:, 2] = np.clip(q[:, 2], width[0] / 2, width[1] / 2)
        now = ((y - model(q)) ** 2).sum()
        if now < err:
            gain, p, err, damp = err - now, q, now, damp / 3
            if gain < 1e-12 * max(err, 1e-12):
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    return p
