"""Tapers of length n (symmetric), by their textbook formulas."""

from __future__ import annotations

import functools
import math

import numpy as np


def _centred(n: int) -> np.ndarray:
    return np.arange(n) - (n - 1) / 2.0


def cosine_sum(n: int, weights) -> np.ndarray:
    x = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return sum(((-1) ** k) * a * np.cos(k * x) for k, a in enumerate(weights))


def _barthann(n):
    f = np.abs(np.arange(n) / max(n - 1, 1) - 0.5)
    return 0.62 - 0.48 * f + 0.38 * np.cos(2 * np.pi * f)


def _bohman(n):
    f = np.abs(np.linspace(-1, 1, n))
    w = (1 - f) * np.cos(np.pi * f) + np.sin(np.pi * f) / np.pi
    w[[0, -1]] = 0.0
    return w


def _parzen(n):
    x = np.abs(_centred(n)) / (n / 2.0)
    return np.where(x <= 0.5, 1 - 6 * x**2 + 6 * x**3, 2 * (1 - x) ** 3)


def _triang(n):
    k = np.arange(1, (n + 1) // 2 + 1)
    half = 2 * k / (n + 1.0) if n % 2 else (2 * k - 1.0) / n
    return np.r_[half, half[-2::-1]] if n % 2 else np.r_[half, half[::-1]]


def _tukey(n, alpha=0.5):
    if alpha <= 0:
        return np.ones(n)
    edge = np.minimum(np.arange(n), np.arange(n)[::-1]) / (min(alpha, 1.0) * (n - 1) / 2.0)
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * np.minimum(edge, 1))), 1.0)


def _kaiser_derived(n, beta=14.0):
    if n % 2:
        raise ValueError("a Kaiser-Bessel derived window has an even length")
    c = np.cumsum(np.kaiser(n // 2 + 1, beta))
    half = np.sqrt(c[:-1] / c[-1])
    return np.r_[half, half[::-1]]


def _chebwin(n, at=100.0):
    order = n - 1.0
    beta = math.cosh(math.acosh(10 ** (abs(at) / 20.0)) / order)
    x = beta * np.cos(np.pi * np.arange(n) / n)
    p = np.empty(n)
    above, below, inside = x > 1, x < -1, np.abs(x) <= 1
    p[above] = np.cosh(order * np.arccosh(x[above]))
    p[below] = (2 * (n % 2) - 1) * np.cosh(order * np.arccosh(-x[below]))
    p[inside] = np.cos(order * np.arccos(x[inside]))
    if n % 2:
        w = np.real(np.fft.fft(p))
        m = (n + 1) // 2
        w = np.r_[w[m - 1 : 0 : -1], w[:m]]
    else:
        w = np.real(np.fft.fft(p * np.exp(1j * np.pi / n * np.arange(n))))
        m = n // 2 + 1
        w = np.r_[w[m - 1 : 0 : -1], w[1:m]]
    return w / w.max()


def _taylor(n, nbar=4, sll=30.0):
    a = math.acosh(10 ** (sll / 20.0)) / np.pi
    s2 = nbar**2 / (a**2 + (nbar - 0.5) ** 2)
    m = np.arange(1, nbar)
    f = np.empty(nbar - 1)
    for i, k in enumerate(m):
        top = (-1) ** (k + 1) * np.prod(1 - k**2 / s2 / (a**2 + (m - 0.5) ** 2))
        f[i] = top / (2 * np.prod(1 - k**2 / m[m != k] ** 2.0))
    w = 1 + 2 * (f[:, None] * np.cos(2 * np.pi * m[:, None] * (np.arange(n) - n / 2.0 + 0.5) / n)).sum(axis=0)
    return w / (1 + 2 * (f * np.cos(2 * np.pi * m * ((n - 1) / 2.0 - n / 2.0 + 0.5) / n)).sum())


# Coefficients of the cosine-sum windows.
COSINE_SUMS = {
    "boxcar": [1.0],
    "hann": [0.5, 0.5],
    "hamming": [0.54, 0.46],
    "blackman": [0.42, 0.50, 0.08],
    "nuttall": [0.3635819, 0.4891775, 0.1365995, 0.0106411],
    "blackmanharris": [0.35875, 0.48829, 0.14128, 0.01168],
    "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368],
}

OTHERS = {
    "barthann": _barthann,
    "bartlett": np.bartlett,
    "bohman": _bohman,
    "chebwin": _chebwin,
    "cosine": lambda n: np.sin(np.pi / n * (np.arange(n) + 0.5)),
    "gaussian": lambda n, std: np.exp(-0.5 * (_centred(n) / std) ** 2),
    "general_cosine": cosine_sum,
    "general_gaussian": lambda n, p, sig: np.exp(-0.5 * np.abs(_centred(n) / sig) ** (2 * p)),
    "general_hamming": lambda n, alpha: cosine_sum(n, [alpha, 1 - alpha]),
    "kaiser": lambda n, beta=14.0: np.kaiser(n, beta),
    "kaiser_bessel_derived": _kaiser_derived,
    "lanczos": lambda n: np.sinc(2 * np.arange(n) / max(n - 1, 1) - 1),
    "parzen": _parzen,
    "taylor": _taylor,
    "triang": _triang,
    "tukey": _tukey,
}

NEED_OPTIONS = {"gaussian": {"std"}, "general_cosine": {"weights"}, "general_gaussian": {"p", "sig"}, "general_hamming": {"alpha"}}
NAMES = sorted([*COSINE_SUMS, *OTHERS])


def window(name: str, n: int, **options) -> np.ndarray:
    """The taper ``name`` with ``n`` values."""
    if name not in COSINE_SUMS and name not in OTHERS:
        raise ValueError(f"unknown taper {name!r}; known: {', '.join(NAMES)}, dpss")
    missing = NEED_OPTIONS.get(name, set()) - set(options)
    if missing:
        raise ValueError(f"taper {name!r} needs {', '.join(sorted(missing))}")
    if n <= 1:
        return np.ones(max(n, 0))
    if name in COSINE_SUMS:
        return np.asarray(cosine_sum(n, COSINE_SUMS[name]), float) * np.ones(n)
    return np.asarray(OTHERS[name](n, **options), float)


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first ``k`` Slepian sequences (k x n), orthonormal.

    They are eigenvectors of a symmetric tridiagonal matrix that commutes with
    the concentration kernel; for long series the matrix is projected onto as many
    orthonormal polynomials as represent them to rounding.  Even orders have a
    positive sum, odd ones begin positive.
    """
    k = min(k, n)
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * nw / n)
    side = i[1:] * (n - i[1:]) / 2.0
    size = int(1.6 * math.pi * nw) + k + 40  # polynomials that represent them
    if size > n // 2 or n < 200:
        v = _mirrored_eigenvectors(main, side, k)
    else:
        basis = np.linalg.qr(np.polynomial.legendre.legvander(np.linspace(-1, 1, n), size - 1))[0]
        moved = main[:, None] * basis
        moved[:-1] += side[:, None] * basis[1:]
        moved[1:] += side[:, None] * basis[:-1]
        v = (basis @ np.linalg.eigh(basis.T @ moved)[1][:, ::-1][:, :k]).T.copy()
    for j in range(k):
        if (j % 2 == 0 and v[j].sum() < 0) or (j % 2 == 1 and v[j][np.argmax(np.abs(v[j]) > 1e-7 * np.abs(v[j]).max())] < 0):
            v[j] = -v[j]
    return v


def _mirrored_eigenvectors(main: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors of the largest eigenvalues of a tridiagonal matrix that equals its mirror image.

    They are even and odd by turns, so two problems of half the size give them.
    """
    n = len(main)
    h = n // 2
    half = np.diag(main[:h]) + np.diag(side[: h - 1], 1) + np.diag(side[: h - 1], -1) if h else np.zeros((0, 0))
    out = np.zeros((k, n))
    if n % 2:
        even = np.zeros((h + 1, h + 1))
        even[:h, :h] = half
        even[h, h] = main[h]
        if h:
            even[h - 1, h] = even[h, h - 1] = math.sqrt(2) * side[h - 1]
        odd = half
    else:
        even, odd = half.copy(), half.copy()
        even[h - 1, h - 1] += side[h - 1]
        odd[h - 1, h - 1] -= side[h - 1]
    u = np.linalg.eigh(even)[1][:, ::-1]
    w = np.linalg.eigh(odd)[1][:, ::-1] if h else np.zeros((0, 0))
    for j in range(k):
        x, sign = (u[:, j // 2], 1) if j % 2 == 0 else (w[:, j // 2], -1)
        out[j, :h] = x[:h] / math.sqrt(2)
        out[j, n - h :] = sign * x[:h][::-1] / math.sqrt(2)
        if n % 2 and sign == 1:
            out[j, h] = x[h]
    return out


def tapers(name: str | None, n: int, total: int, options: dict | None = None) -> np.ndarray:
    """Tapers (k x n) scaled so that power spreads over the window's response; ``total`` is the padded length."""
    return _tapers(name, n, total, tuple(sorted((k, tuple(v) if isinstance(v, (list, np.ndarray)) else v) for k, v in (options or {}).items())))


@functools.lru_cache(maxsize=64)
def _tapers(name: str | None, n: int, total: int, items: tuple) -> np.ndarray:
    options = dict(items)
    if name is None:
        name = "boxcar"
    if name == "dpss":
        return dpss(n, options["NW"], int(options["Kmax"])) * math.sqrt(total)
    w = window(name, n, **options)[None, :]
    return w * math.sqrt(total / w.sum()) * (1.0 if name == "boxcar" else math.sqrt(4 / 3))


def slepian_options(bandwidth: float, n: float, samplerate: float, k: int | None = None) -> dict:
    """NW and number of tapers for a half bandwidth in Hz, at least one taper."""
    nw = bandwidth * n / samplerate
    return {"NW": nw, "Kmax": k or max(1, int(2 * nw - 1))}
