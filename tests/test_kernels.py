import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from trialloom.kernels import filters, network, spectra, wavelets, windows


def test_dpss_is_orthonormal_for_short_and_long_series():
    for n in (200, 2000):
        v = windows.dpss(n, 4, 6)
        assert np.allclose(v @ v.T, np.eye(6), atol=1e-8)
        assert v[0].sum() > 0


@pytest.mark.parametrize("name", [n for n in windows.NAMES if n not in windows.NEED_OPTIONS])
def test_windows_are_symmetric(name):
    for n in (64, 65):
        if name == "kaiser_bessel_derived" and n % 2:
            with pytest.raises(ValueError):
                windows.window(name, n)
            continue
        w = windows.window(name, n)
        assert len(w) == n and np.allclose(w, w[::-1], atol=1e-9) and w.max() < 1.01


def test_windows_need_their_options():
    with pytest.raises(ValueError):
        windows.window("gaussian", 10)
    with pytest.raises(ValueError):
        windows.window("no such", 10)
    assert windows.window("gaussian", 11, std=2.0)[5] == 1


def test_harmonic_has_half_squared_amplitude_as_power():
    x = 4 * np.cos(2 * np.pi * 50 * np.arange(1000) / 500)
    for total in (1000, 2000):
        z, f = spectra.mtmfft(x, 500, total)
        p = np.abs(z[0]) ** 2
        assert np.isclose(p.max(), 8) and f[p.argmax()] == 50
    z, f = spectra.mtmfft(x, 500, taper="hann")
    assert np.isclose((np.abs(z) ** 2).sum(), 8)


@settings(deadline=None, max_examples=30)
@given(some.integers(4, 60), some.integers(0, 10**6))
def test_parseval(n, seed):
    x = np.random.default_rng(seed).normal(size=n)
    z, _ = spectra.mtmfft(x, 1.0)
    p = np.abs(z[0]) ** 2
    p[0] /= 2
    if n % 2 == 0:
        p[-1] /= 2
    assert np.isclose(p.sum(), (x * x).mean())


def test_butterworth_gains():
    def gain(sos, f, fs):
        z = np.exp(-2j * np.pi * f / fs)
        return abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos]))

    for order in (1, 2, 3, 4, 5):
        assert np.allclose([gain(filters.butterworth(order, 50, "lp", 500), f, 500) for f in (0, 50)], [1, 2**-0.5])
        assert np.allclose([gain(filters.butterworth(order, 50, "hp", 500), f, 500) for f in (50, 250)], [2**-0.5, 1])
        assert np.allclose([gain(filters.butterworth(order, (40, 60), "bp", 500), f, 500) for f in (0, 40, 60)], [0, 2**-0.5, 2**-0.5], atol=1e-9)
        assert np.allclose([gain(filters.butterworth(order, (40, 60), "bs", 500), f, 500) for f in (0, 40, 60)], [1, 2**-0.5, 2**-0.5])


def test_two_pass_filter_keeps_phase_and_constants():
    t = np.arange(2000) / 500
    x = np.stack([np.cos(2 * np.pi * 5 * t), np.ones(2000)])
    y = filters.butter_filter(x, filters.butterworth(4, 50, "lp", 500))
    assert np.abs(y[0, 200:-200] - x[0, 200:-200]).max() < 1e-3 and np.allclose(y[1], 1)


def test_sinc_filters():
    lp = np.abs(np.fft.rfft(filters.sinc_kernel("hamming", 200, 0.1, "lp"), 2000))
    bp = np.abs(np.fft.rfft(filters.sinc_kernel("hamming", 200, (0.1, 0.2), "bp"), 2000))
    bs = np.abs(np.fft.rfft(filters.sinc_kernel("hamming", 200, (0.1, 0.2), "bs"), 2000))
    assert np.isclose(lp[0], 1) and lp[600] < 1e-2 and bp[0] < 1e-2 and abs(bp[300] - 1) < 1e-2 and bs[300] < 1e-2
    mp = filters.minimum_phase(filters.sinc_kernel("hamming", 100, 0.1, "lp"))
    assert np.argmax(np.abs(mp)) < 15


def test_a_nan_spreads_over_the_kernel_only():
    x = np.ones((1, 200))
    x[0, 100] = np.nan
    y = filters.apply_kernel(x, filters.sinc_kernel("hamming", 10, 0.2, "lp"), "onepass")
    assert np.isnan(y).sum() == 11


def test_resampling_and_envelope():
    t = np.arange(2000) / 500
    x = np.cos(2 * np.pi * 20 * t)[None]
    y = filters.resample(x, 500, 250)
    assert y.shape == (1, 1000) and np.abs(y[0, 300:700] - x[0, 600:1400:2]).max() < 1e-2
    assert filters.resample(x, 500, 205).shape == (1, 820)
    assert np.allclose(np.abs(filters.analytic(x))[0, 200:-200], 1, atol=1e-6)


def test_wavelets_and_superlets_peak_at_the_frequency():
    x = np.cos(2 * np.pi * 20 * np.arange(0, 2, 1e-3))[None]
    foi = np.array([10.0, 20, 30])
    for z in (wavelets.superlet(x, 1000, foi, 5), wavelets.superlet(x, 1000, foi, 5, adaptive=True), wavelets.cwt(x, 1000, wavelets.scale_of("Morlet", 1 / foi, 6.0))):
        assert np.abs(z[0, :, 1000]).argmax() == 1


def test_influence_has_a_direction():
    rng = np.random.default_rng(1)
    x = np.zeros((60, 2, 600))
    e = rng.normal(size=x.shape)
    for i in range(2, 600):
        x[:, 0, i] = 0.55 * x[:, 0, i - 1] - 0.8 * x[:, 0, i - 2] + 0.25 * x[:, 1, i - 1] + e[:, 0, i]
        x[:, 1, i] = 0.55 * x[:, 1, i - 1] - 0.8 * x[:, 1, i - 2] + e[:, 1, i]
    z, f = spectra.mtmfft(x, 200, taper="dpss", options=windows.slepian_options(3, 600, 200), order=0, demean_taper=True)
    s = np.einsum("nckf,ndkf->fcd", z, np.conj(z)) / (60 * z.shape[2])
    s, _, _ = network.regularise(s)
    h, sigma, err = network.factorise(s)
    g = network.granger(s, h, sigma)
    assert err < 1e-5 and g[:, 1, 0].max() > 0.3 and g[:, 0, 1].max() < 0.1


def test_regularisation_of_a_singular_matrix():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(10, 20))
    s = np.stack([v.T @ v] * 3).astype(complex)
    loaded, eps, cond = network.regularise(s)
    assert cond > 1e4 and 0 < eps <= 0.1 and np.linalg.cond(loaded).max() < 1e4


def test_correlation_of_cosine_and_sine():
    t = np.arange(1001) / 1000
    c = network.cross_covariance(np.stack([np.cos(2 * np.pi * 30 * t), np.sin(2 * np.pi * 30 * t)]), True)
    assert np.abs(c[:300, 0, 1] + np.sin(2 * np.pi * 30 * t[:300])).max() < 1e-4


def test_fitted_spectrum_recovers_its_parts():
    f = np.arange(1, 100, 0.5)
    p = 10 ** (2 - 1.5 * np.log10(f) + 0.8 * np.exp(-0.5 * ((f - 20) / 2) ** 2))
    (offset, exponent), peaks, *_ = spectra.fit_peaks(f, p)
    assert abs(offset - 2) < 0.1 and abs(exponent - 1.5) < 0.1 and abs(peaks[0][0] - 20) < 0.5
    with pytest.raises(ValueError):
        spectra.fit_peaks(np.arange(0.0, 10), np.ones(10))


def test_padding():
    assert spectra.padded_length(1000, "nextpow2", 100) == 1024 and spectra.padded_length(1000, 12, 100) == 1200
    for bad in (-0.1, "often", [1]):
        with pytest.raises(ValueError):
            spectra.padded_length(1000, bad, 100)


def test_cwt_is_the_convolution_with_each_daughter():
    x = np.random.default_rng(3).normal(size=(2, 90))
    fs, scales = 50.0, np.array([0.05, 0.11, 0.4])
    for name, (shape, par) in wavelets.WAVELETS.items():
        z = wavelets.cwt(x, fs, scales, name)
        for j, s in enumerate(scales):
            taps = int(np.ceil(10 * s * fs - 1e-9))
            t = (np.arange(taps) - (10 * s * fs - 1) / 2) / fs
            k = shape(t / s, par) / (8 * np.pi * s * np.sqrt(fs))
            at = (taps - 1) // 2
            assert np.allclose(z[1, j], np.convolve(x[1], k)[at : at + 90], atol=1e-12)


def test_wavelet_toolbox_returns_the_signal_and_its_variance(monkeypatch):
    x = np.convolve(np.random.default_rng(1).normal(size=512), np.ones(5) / 5, "same")
    dj = 0.125
    for name in ("Morlet", "DOG"):
        par = wavelets.WAVELETS[name][1]
        first = wavelets.scale_of(name, 2.0, par)
        scales = first * 2 ** (dj * np.arange(int(np.log2(512 / first) / dj) + 1))
        z = wavelets.periodic_cwt(x - x.mean(), 1.0, scales, name)
        assert np.abs(wavelets.reconstruct(z, 1.0, scales, dj, name, mean=x.mean()) - x).mean() < 0.15 * x.std()
        assert 0.9 < wavelets.wavelet_variance(z, 1.0, scales, dj, name) / x.var() < 1.05
        free = wavelets.outside_cone(512, 1.0, scales, name)
        whole, inner = (wavelets.global_spectrum(wavelets.wavelet_power(z), x.var(), f) for f in (None, free))
        assert np.isfinite(whole).all() and np.isnan(inner).sum() == (~free.any(axis=1)).sum() > 0
        assert np.allclose(wavelets.wavelet_power(z, scales) * scales[:, None], np.abs(z) ** 2)
    known = dict(wavelets.RECONSTRUCTION)
    monkeypatch.setattr(wavelets, "RECONSTRUCTION", {})
    for (name, par), c in known.items():
        assert np.isclose(wavelets.reconstruction_factor(name, par), c, rtol=0.03)
