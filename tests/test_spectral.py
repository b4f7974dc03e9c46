"""Spectral kernels against what is known of them."""

import numpy as np
import pytest

from pulsegrid.functions import spectral

FS = 500.0
T = np.arange(5000) / FS


def test_filters_keep_to_their_losses():
    for edges, fs in ((spectral.NOISE, 500.0), (spectral.BASELINE, 500.0), (spectral.NOISE, 100.0)):
        num, den = spectral.butterworth(fs, edges)
        gain = lambda f: abs(np.polyval(num, np.exp(2j * np.pi * f / fs)) / np.polyval(den, np.exp(2j * np.pi * f / fs)))  # noqa: E731, B023
        assert gain(0) == pytest.approx(1) and 20 * np.log10(gain(edges[0])) == pytest.approx(-0.1, abs=1e-6) and 20 * np.log10(gain(edges[1])) <= -20
        # a lower order does not keep to them
        assert np.all(np.abs(np.roots(den)) < 1)


def test_low_pass_shifts_no_phase():
    slow, fast = np.sin(2 * np.pi * 3 * T), np.sin(2 * np.pi * 60 * T)
    out = spectral.low_passed(np.stack([slow + fast, np.full(5000, 2.5)]), FS)
    assert np.abs(out[0] - slow)[500:-500].max() < 0.02 and np.allclose(out[1], 2.5)
    back = spectral.low_passed(slow[None, ::-1], FS)[0] - spectral.low_passed(slow[None], FS)[0, ::-1]
    assert np.abs(back)[500:-500].max() < 1e-6  # the ends are continued by what came before
    assert spectral.low_passed(np.array([[1.0]]), FS).tolist() == [[1.0]] and spectral.low_passed(np.array([[1.0, 2.0]]), FS).shape == (1, 2)


def test_spectrogram_of_a_sine():
    z = spectral.spectrogram(2 * np.sin(2 * np.pi * 40 * T), 125)
    # 4 Hz a bin: an amplitude of two is one at its bin, inside the signal
    assert z.shape == (81, 63) and np.allclose(z[2:-2, 10], 1, atol=1e-6) and z[2:-2, 20].max() < 1e-6
    assert spectral.spectrogram(np.ones(10), 125).shape[1] == 63


def test_power_is_one_sided():
    # two waves of one amplitude, one at half the rate, where it stands for itself alone
    n = np.arange(64)
    x = np.cos(2 * np.pi * 8 * n / 64) + np.cos(np.pi * n)
    f, p = spectral.power(x, 64.0)
    assert p[8] == pytest.approx(2 * 32**2) and p[32] == pytest.approx(64**2)
    assert spectral.snr(np.cos(2 * np.pi * 5 * T) + 0.5 * np.cos(2 * np.pi * 100 * T), FS) == pytest.approx(4, rel=1e-6)
    assert spectral.snr(np.zeros(100), FS) is None and spectral.share(np.zeros(100), FS, 0, 2) == 0


def test_resampled_sine():
    x = np.sin(2 * np.pi * 5 * np.arange(1000) / 250)
    y = spectral.resampled(x, 500, 250)
    assert len(y) == 2000 and np.abs(y - np.sin(2 * np.pi * 5 * np.arange(2000) / 500))[100:-100].max() < 0.01
    assert spectral.resampled(x, 3, 3) is x and len(spectral.resampled(x, 2, 5)) == 400


def test_polyphase_is_the_stuffed_signal_through_the_taps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 301):
        for up, down in ((5, 2), (2, 5), (1, 3), (3, 1), (7, 8)):
            x, half = rng.normal(size=n), 10 * max(up, down)
            stuffed = np.zeros(n * up)
            stuffed[::up] = x
            want = np.convolve(stuffed, spectral.low_pass_taps(up, down))[half : half + len(stuffed)][::down]
            assert np.allclose(spectral.resampled(x, up, down), want)


def test_sections_are_the_filter_in_parts():
    x = np.random.default_rng(2).normal(size=(3, 400))
    for edges, fs in ((spectral.NOISE, 100.0), (spectral.BASELINE, 500.0), ((5.0, 8.0), 100.0)):
        num, den = np.ones(1), np.ones(1)
        for a, b in spectral.sections(fs, edges):
            num, den = np.polymul(num, a), np.polymul(den, b)
        whole = spectral.butterworth(fs, edges)
        assert np.allclose(num, whole[0]) and np.allclose(den, whole[1])
        y = x
        for a, b in spectral.sections(fs, edges):
            y = spectral.passed(y, a, b)
        assert np.allclose(y, spectral.passed(x, *whole), atol=1e-6)


def test_one_transform_judges_as_three_did():
    x = np.random.default_rng(3).normal(size=(5, 333))
    x[2] = 4.0
    snr, drift, buzz = spectral.judged(x, FS)
    for i, row in enumerate(x):
        want = spectral.snr(row, FS)
        assert (np.isnan(snr[i]) if want is None else snr[i] == pytest.approx(want)) and drift[i] == pytest.approx(spectral.share(row, FS, 0.0, 2.0)) and buzz[i] == pytest.approx(spectral.share(row, FS, 40.0, FS))
