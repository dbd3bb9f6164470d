"""Spectral factorisation and directed influence; matrices are (frequency, channel, channel)."""

from __future__ import annotations

import numpy as np


def regularise(csd: np.ndarray, most: float = 1e4, largest: float = 1e-1, steps: int = 15) -> tuple[np.ndarray, float, float]:
    """Add the least of some diagonal loadings that brings the condition number below ``most``.

    Returns the matrices, the loading (0: none needed, -1: none sufficed) and
    the condition number found.
    """
    found = float(np.linalg.cond(csd).max())
    if found < most:
        return csd, 0.0, found
    eye = np.eye(csd.shape[-1])
    loaded = csd
    for eps in np.logspace(-10, np.log10(largest), steps):
        loaded = csd + eps * eye
        if np.linalg.cond(loaded).max() < most:
            return loaded, float(eps), found
    return loaded, -1.0, found


def factorise(csd: np.ndarray, rounds: int = 100, tolerance: float = 5e-6):
    """Wilson's iteration: transfer function H, noise covariance S and the relative error, with H S H* = csd.

    ``csd`` runs from frequency 0 to the Nyquist frequency.
    """
    full = np.concatenate([csd, np.conj(csd[-2:0:-1])])
    size, half = len(full), len(full) // 2
    eye = np.eye(csd.shape[-1])
    start = np.linalg.cholesky(np.real(np.fft.ifft(full, axis=0)[0])).T
    psi = np.broadcast_to(start, full.shape).astype(complex)
    lower = np.linalg.cholesky(full)
    a0 = start.astype(float)
    err = np.inf
    for _ in range(rounds):
        g = np.linalg.solve(psi, lower)
        g = g @ np.conj(np.swapaxes(g, 1, 2)) + eye
        lags = np.real(np.fft.ifft(g, axis=0))
        lags[0] *= 0.5
        zero = lags[0].copy()
        lags[half] *= 0.5
        lags[half + 1 :] = 0
        plus = np.fft.fft(lags, axis=0)
        skew = -np.tril(zero, -1)
        skew = skew - skew.T
        psi = psi @ (plus + skew)
        a0 = a0 @ (zero + skew)
        rebuilt = psi @ np.conj(np.swapaxes(psi, 1, 2))
        err = float(np.max(np.abs(full - rebuilt) / np.abs(full)))
        if err < tolerance:
            break
    sigma = a0 @ a0.T
    transfer = psi @ np.linalg.inv(a0)
    return transfer[: len(csd)], sigma, err


def granger(csd: np.ndarray, transfer: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Causality from i to j at [f, i, j]: log of power over the power not explained by i."""
    n = csd.shape[-1]
    power = np.real(np.diagonal(csd, axis1=1, axis2=2))
    out = np.zeros(csd.shape)
    for i in range(n):
        for j in range(n):
            if i != j:
                noise = sigma[i, i] - abs(sigma[j, i]) ** 2 / sigma[j, j]
                out[:, i, j] = np.log(power[:, j] / (power[:, j] - noise * np.abs(transfer[:, j, i]) ** 2))
    return out


def cross_covariance(x: np.ndarray, normed: bool = False) -> np.ndarray:
    """(lag, i, j) of signals (channel, time): the mean of x_i(t + lag) x_j(t) over the overlap, lags up to half."""
    c, n = x.shape
    lags = n // 2 if n % 2 == 0 else n // 2 + 1
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size, axis=-1)
    full = np.fft.irfft(f[:, None] * np.conj(f[None, :]), size, axis=-1)[..., :lags]
    out = np.moveaxis(full / (n - np.arange(lags)), -1, 0)
    if normed:
        sd = x.std(axis=-1)
        out = out / (sd[:, None] * sd[None, :])
    return out
