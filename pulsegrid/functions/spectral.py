"""Spectral kernels that built-in expressions can't state, as Arrow UDFs over arrays of samples."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def power(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the one-sided periodogram of a signal without its mean: all but the ends stand for two."""
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    p[1 : -1 if len(x) % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), p


def snr(x: np.ndarray, fs: float, low: float = 2.0, high: float = 40.0) -> float | None:
    """Power in [low, high) over the rest; null where there is no power or no rest, which passes."""
    if len(x) < 2:
        return None
    f, p = power(x, fs)
    band = (f >= low) & (f < high)
    rest = p[~band].sum()
    return float(p[band].sum() / rest) if p.sum() > 0 and rest > 0 else None


def share(x: np.ndarray, fs: float, low: float, high: float) -> float:
    """The share of the power in [low, high); 0 without power."""
    if len(x) < 2:
        return 0.0
    f, p = power(x, fs)
    return float(p[(f >= low) & (f < high)].sum() / p.sum()) if p.sum() > 0 else 0.0


def low_pass_taps(up: int, down: int) -> np.ndarray:
    """The windowed sinc of resampled(), for coprime up and down."""
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return taps * (up / taps.sum())


def resampled(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down with a windowed-sinc low-pass: each sample is the product of a stretch of the signal and the taps of its phase."""
    g = gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return x
    half, taps = 10 * max(up, down), low_pass_taps(up, down)
    # sample n stands at n * down of the finer grid, where every up-th place has a sample of the signal
    n = -(-len(x) * up // down)
    most = -(-len(taps) // up)
    padded = np.pad(x, most)
    out = np.empty(n)
    for first in range(min(up, n)):
        at = first * down + half
        own = taps[at % up :: up]
        # the samples that these taps meet end at that one
        ends = at // up + most + np.arange(len(range(first, n, up))) * down
        ends = np.minimum(ends, len(padded) + most)
        padded_ = np.pad(padded, (0, max(0, int(ends[-1]) + 1 - len(padded))))
        out[first::up] = np.lib.stride_tricks.sliding_window_view(padded_, len(own))[ends - len(own) + 1] @ own[::-1]
    return out


def spectrogram(x: np.ndarray, window: int = 125) -> np.ndarray:
    """Magnitudes of periodic-Hann frames over half of each other, by the window's sum, of the signal between zeros of half a window."""
    half, hop = window // 2, window - window // 2
    x = np.pad(x, half)
    x = np.pad(x, (0, max(0, window - len(x)) or -(len(x) - window) % hop))
    weights = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    return np.abs(np.fft.rfft(frames * weights, axis=1)) / weights.sum()


#: Fixed: dB lost in the pass band at most and in the stop band at least; edges (pass, stop) in Hz of the filters for noise and for the baseline.
LOSSES, NOISE, BASELINE = (0.1, 20.0), (20.0, 30.0), (0.5, 8.0)


def poles(fs: float, edges: tuple[float, float], losses: tuple[float, float] = LOSSES) -> np.ndarray:
    """Poles of the lowest-order Butterworth low-pass that keeps to the losses at the edges; its zeros are all at -1."""
    low, high = (np.tan(np.pi * f / fs) for f in edges)
    kept, lost = (10 ** (x / 10) - 1 for x in losses)
    order = int(np.ceil(np.log10(lost / kept) / (2 * np.log10(high / low))))
    cut = low * kept ** (-1 / (2 * order))  # loses just what is allowed at the pass edge
    # on the left half of a circle, then by the bilinear transform
    analog = cut * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    return (1 + analog) / (1 - analog)


def butterworth(fs: float, edges: tuple[float, float], losses: tuple[float, float] = LOSSES) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (numerator, denominator) of that filter, as one fraction."""
    den = np.poly(poles(fs, edges, losses)).real
    num = np.poly(-np.ones(len(den) - 1))
    return num * (den.sum() / num.sum()), den


def sections(fs: float, edges: tuple[float, float], losses: tuple[float, float] = LOSSES) -> list[tuple[np.ndarray, np.ndarray]]:
    """That filter as a chain of fractions of order two (one of order one, if its order is odd), each of which lets a constant through: their coefficients lose no digits."""
    out = []
    every = poles(fs, edges, losses)
    for p in every[every.imag > -1e-12]:
        own = [p] if abs(p.imag) <= 1e-12 else [p, p.conjugate()]
        den, num = np.poly(own).real, np.poly(-np.ones(len(own)))
        out.append((num * (den.sum() / num.sum()), den))
    return out


def steady(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The filter's state after a very long input of ones."""
    n = len(den) - 1
    companion = np.vstack([-den[1:], np.eye(n)[: n - 1]])
    return np.linalg.solve(np.eye(n) - companion.T, num[1:] - den[1:] * num[0])


def passed(x: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Signals (a row each) through a filter that is in its steady state for their first samples."""
    state = steady(num, den)[:, None] * x[:, 0]
    out = np.empty_like(x)
    for i, now in enumerate(x.T):
        y = num[0] * now + state[0]
        state = np.vstack([state[1:], np.zeros(len(now))]) + num[1:, None] * now - den[1:, None] * y
        out[:, i] = y
    return out


def low_passed(x: np.ndarray, fs: float, edges: tuple[float, float] = NOISE) -> np.ndarray:
    """Signals (a row each) through the Butterworth low-pass forwards and backwards, so no phase is shifted; ends are continued by turning the signal about them."""
    chain = sections(fs, edges)
    order = sum(len(den) - 1 for _, den in chain)
    more = min(3 * (order + 1), x.shape[1] - 1)
    if more < 1:
        return x.copy()
    y = np.concatenate([2 * x[:, :1] - x[:, more:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -more - 2 : -1]], axis=1)
    for _ in range(2):
        for num, den in chain:
            y = passed(y, num, den)
        y = y[:, ::-1]
    return y[:, more:-more]


def judged(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """snr() and the shares below 2 Hz and from 40 Hz on of signals (a row each), by one transform; NaN for an snr that there is none of."""
    p = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True))) ** 2
    n = x.shape[1]
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    f = np.fft.rfftfreq(n, 1 / fs)
    whole = p.sum(axis=1)
    band = p[:, (f >= 2.0) & (f < 40.0)].sum(axis=1)
    rest = p[:, (f < 2.0) | (f >= 40.0)].sum(axis=1)
    some = np.where(whole > 0, whole, 1.0)
    share_of = lambda own: np.where(whole > 0, p[:, own].sum(axis=1) / some, 0.0)
    return np.where((whole > 0) & (rest > 0), band / np.where(rest > 0, rest, 1.0), np.nan), share_of(f < 2.0), share_of((f >= 40.0) & (f < fs))


def _array(x) -> np.ndarray:
    return np.asarray(x, dtype=np.float64)


def snr_udf(fs: float):
    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else snr(_array(x), fs)).astype("float64")

    return run


def share_udf(fs: float, low: float, high: float):
    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else share(_array(x), fs, low, high)).astype("float64")

    return run


def quality_udf(fs: float):
    """struct<snr, drift, buzz> of judged(); signals of one length go through together. Null for null."""

    @F.pandas_udf("snr double, drift double, buzz double")
    def run(samples: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"snr": np.nan, "drift": 0.0, "buzz": 0.0}, index=samples.index, dtype="float64")
        known = samples.dropna()
        out.loc[samples.index.difference(known.index)] = np.nan
        for length, same in known.groupby(known.map(len)):
            if length > 1:
                out.loc[same.index] = np.stack(judged(np.stack([_array(x) for x in same]), fs), axis=1)
        return out

    return run


def resample_udf(up: int, down: int):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else resampled(_array(x), up, down))

    return run


def low_pass_udf(fs: float, edges: tuple[float, float] = NOISE):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(samples), index=samples.index, dtype=object)
        known = samples.dropna()
        for length, same in known.groupby(known.map(len)):  # signals of a length go through together
            made = low_passed(np.stack([_array(x) for x in same]), fs, edges) if length else np.empty((len(same), 0))
            for i, y in zip(same.index, made, strict=True):
                out[i] = y
        return out

    return run


def spectrogram_udf(window: int = 125):
    @F.pandas_udf("array<array<double>>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else [list(r) for r in spectrogram(_array(x), window)])

    return run
