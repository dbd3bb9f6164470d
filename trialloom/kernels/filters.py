"""Filters, resampling and analytic signals; arrays are (..., time)."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from trialloom.kernels.windows import window

TYPES = ("lp", "hp", "bp", "bs")

# Fixed values of the minimum-phase kernel: least length of its transform in kernels, and least gain.
PHASE_SIZE = 1000
LEAST_GAIN = 1e-8


# --- windowed sinc ------------------------------------------------------------------------------------------------


def fft_convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The middle len(x) values of the full convolution of real arrays along the last axis."""
    n, m = x.shape[-1], len(kernel)
    size = 1 << max(0, n + m - 2).bit_length()
    start = (m - 1) // 2
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(kernel, size), size)[..., start : start + n] if size > 1 else x * kernel


def sinc_lowpass(name: str, order: int, cut: float) -> np.ndarray:
    """Low-pass of ``order`` + 1 taps with unit gain at 0; ``cut`` in cycles per sample."""
    m = np.arange(-(order // 2), order // 2 + 1)
    k = 2 * cut * np.sinc(2 * cut * m) * window(name, order + 1)
    return k / k.sum()


def sinc_kernel(name: str, order: int, cut, kind: str) -> np.ndarray:
    """Low-, high-, band-pass or band-stop kernel; a band's ends are ordered low to high."""
    order += order % 2
    delta = np.zeros(order + 1)
    delta[order // 2] = 1.0
    if kind == "lp":
        return sinc_lowpass(name, order, cut)
    if kind == "hp":
        return delta - sinc_lowpass(name, order, cut)
    low, high = cut
    passed = sinc_lowpass(name, order, high) - sinc_lowpass(name, order, low)
    return passed if kind == "bp" else delta - passed


def minimum_phase(kernel: np.ndarray) -> np.ndarray:
    """The causal kernel with the same gain and least delay, by folding the real cepstrum."""
    n = len(kernel)
    size = 1 << int(np.ceil(np.log2(n * PHASE_SIZE)))
    spectrum = np.maximum(np.abs(np.fft.fft(kernel, size)), LEAST_GAIN)
    cepstrum = np.fft.ifft(np.log(spectrum)).real
    fold = np.zeros(size)
    fold[0] = fold[size // 2] = 1
    fold[1 : size // 2] = 2
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[:n]


def apply_kernel(x: np.ndarray, kernel: np.ndarray, direction: str = "twopass") -> np.ndarray:
    """Centred convolution once or twice, or causal with the minimum-phase kernel.

    With NaN in a signal its values are summed directly, so that only samples
    within the kernel's reach of a NaN become NaN.
    """
    if direction == "onepass-minphase":
        k = minimum_phase(kernel)
        y = np.concatenate([x, np.zeros((*x.shape[:-1], len(k) - 1))], axis=-1)
        full = fft_convolve(y, np.concatenate([k, np.zeros(len(k) - 1)]))
        start = (2 * len(k) - 2) // 2 - (len(k) - 1)
        return _causal(x, k) if np.isnan(x).any() or start != 0 else full[..., : x.shape[-1]]
    for _ in range(2 if direction == "twopass" else 1):
        if np.isnan(x).any():
            flat = x.reshape(-1, x.shape[-1])
            half = (len(kernel) - 1) // 2
            x = np.stack([np.convolve(row, kernel)[half : half + len(row)] for row in flat]).reshape(x.shape)
        else:
            x = fft_convolve(x, kernel)
    return x


def _causal(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    flat = x.reshape(-1, x.shape[-1])
    return np.stack([np.convolve(row, k)[: len(row)] for row in flat]).reshape(x.shape)


# --- Butterworth --------------------------------------------------------------------------------------------------


def butterworth(order: int, cut, kind: str, samplerate: float) -> np.ndarray:
    """Second-order sections (n x 6) of the bilinear transform of the analogue prototype."""
    if kind not in TYPES:
        raise ValueError(f"filter type must be one of {', '.join(TYPES)}")
    warped = 2 * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / samplerate)
    p = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    if kind == "lp":
        w = warped[0]
        z, poles, gain = np.zeros(0, complex), p * w, w**order
    elif kind == "hp":
        w = warped[0]
        z, poles, gain = np.zeros(order, complex), w / p, 1.0
    else:
        bw, w0 = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = p * bw / 2 if kind == "bp" else (bw / 2) / p
        root = np.sqrt(half**2 - w0**2 + 0j)
        poles = np.r_[half + root, half - root]
        if kind == "bp":
            z, gain = np.zeros(order, complex), bw**order
        else:
            z, gain = np.r_[np.full(order, 1j * w0), np.full(order, -1j * w0)], 1.0
    k = gain * np.real(np.prod(2 - z) / np.prod(2 - poles))
    zd, pd = (2 + z) / (2 - z), (2 + poles) / (2 - poles)
    zd = np.r_[zd, -np.ones(len(pd) - len(zd))]
    return _sections(zd, pd, k)


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    def grouped(r):
        """Conjugate pairs, then pairs of real roots."""
        up = sorted((x for x in r if x.imag > 1e-10), key=abs)
        real = sorted(x.real for x in r if abs(x.imag) <= 1e-10)
        pairs = [(x, np.conj(x)) for x in up] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
        return pairs

    poles, zeros = grouped(p), grouped(z)
    flat = [x for pair in zeros for x in pair]
    out = []
    for pair in poles:
        n = len(pair)
        mine = []
        conj = next((x for x in flat if abs(x.imag) > 1e-10), None) if n == 2 else None
        if conj is not None:
            twin = min(flat, key=lambda y: abs(y - np.conj(conj)))
            mine = [conj, twin]
            flat = [y for y in flat if y is not conj and y is not twin]
        else:
            real = [y for y in flat if abs(y.imag if isinstance(y, complex) else 0) <= 1e-10]
            # one zero at either end of the band for a pair of poles, if there are both
            ends = sorted(real, key=lambda y: np.real(y))
            mine = [ends[0], ends[-1]] if n == 2 and len(ends) > 1 else ends[:n]
            for y in mine:
                flat.remove(y)
        b, a = np.real(np.poly(mine)), np.real(np.poly(pair))
        out.append(np.r_[np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))])
    sos = np.array(out)
    sos[0, :3] *= k
    return sos


def _section_start(sos: np.ndarray) -> np.ndarray:
    """States of the steady response to a unit step."""
    scale, out = 1.0, np.zeros((len(sos), 2))
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = b2 - a2 * gain
        s0 = b1 - a1 * gain + s1
        out[i] = scale * np.array([s0, s1])
        scale *= gain
    return out


def sos_filter(sos: np.ndarray, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Causal filtering; the recursion runs over time, for all signals at once."""
    y = np.moveaxis(np.array(x, float), -1, 0).copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s0 = np.zeros(y.shape[1:]) if start is None else start[i][0]
        s1 = np.zeros(y.shape[1:]) if start is None else start[i][1]
        for t in range(len(y)):
            v = y[t]
            w = b0 * v + s0
            s0 = b1 * v - a1 * w + s1
            s1 = b2 * v - a2 * w
            y[t] = w
    return np.moveaxis(y, 0, -1)


def butter_filter(x: np.ndarray, sos: np.ndarray, direction: str = "twopass") -> np.ndarray:
    """Forward, or forward and backward over odd-mirrored ends, so without a phase shift."""
    flat = x.reshape(-1, x.shape[-1])
    return np.stack(butter_series(list(flat), sos, direction)).reshape(x.shape)


def butter_series(rows: list[np.ndarray], sos: np.ndarray, direction: str = "twopass") -> list[np.ndarray]:
    """The same for series of any lengths, which go through the recursion side by side."""
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    edges = [min(3 * taps, len(r) - 1) if direction == "twopass" else 0 for r in rows]
    longer = [np.concatenate([2 * r[:1] - r[e:0:-1], r, 2 * r[-1:] - r[-2 : -e - 2 : -1]]) if e > 0 else r for r, e in zip(rows, edges)]
    n = np.array([len(r) for r in longer])
    x = np.zeros((len(rows), n.max()))
    for i, r in enumerate(longer):
        x[i, : len(r)] = r
    if direction == "onepass":
        y = sos_filter(sos, x)
    else:
        back = np.maximum(n[:, None] - 1 - np.arange(n.max()), 0)  # each series from its own end
        y = x
        for _ in range(2):
            start = [[s * y[:, 0] for s in pair] for pair in _section_start(sos)]
            y = np.take_along_axis(sos_filter(sos, y, start), back, 1)
    return [y[i, e : e + len(r)] for i, (r, e) in enumerate(zip(rows, edges))]


# --- analytic signal, resampling -----------------------------------------------------------------------------------

HILBERT = {
    "abs": np.abs, "complex": lambda z: z, "real": np.real, "imag": np.imag, "absreal": lambda z: np.abs(z.real), "absimag": lambda z: np.abs(z.imag), "angle": np.angle,
}


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def rates(old: float, new: float, most: int = 1000) -> tuple[int, int]:
    f = Fraction(new / old).limit_denominator(most)
    return f.numerator, f.denominator


def resample(x: np.ndarray, old: float, new: float, cut: float | None = None, order: int | None = None) -> np.ndarray:
    """Rational resampling: zeros between samples, windowed-sinc low-pass at the lower Nyquist rate, every n-th kept."""
    up, down = rates(old, new)
    n = x.shape[-1]
    order = order or min(1000, n)
    order = order * up + (order * up) % 2
    limit = (cut or min(old, new) / 2) / (old * up)
    kernel = sinc_lowpass("hamming", order, limit) * up
    wide = np.zeros((*x.shape[:-1], n * up))
    wide[..., ::up] = x
    return fft_convolve(wide, kernel)[..., ::down][..., : -(-n * up // down)]
