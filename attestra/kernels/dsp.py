"""Signal building blocks from their public definitions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=16)
def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)
    d = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    d[0] /= np.sqrt(2)
    return d


def convolve_axis(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Symmetric taps with mirrored edges."""
    r = len(taps) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p = np.pad(x, pad, mode="symmetric")
    n = x.shape[axis]
    return sum(t * np.take(p, np.arange(i, i + n), axis) for i, t in enumerate(taps))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Over the last two axes, cut at 4 sigma."""
    r = int(4 * sigma + 0.5)
    t = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    t /= t.sum()
    return convolve_axis(convolve_axis(x, t, -1), t, -2)


def laplacian(x: np.ndarray) -> np.ndarray:
    t = np.array([1.0, -2.0, 1.0])
    return convolve_axis(x, t, -1) + convolve_axis(x, t, -2)


def uniform(x: np.ndarray, size: int, axes=(-1, -2)) -> np.ndarray:
    for a in axes:
        x = convolve_axis(x, np.full(size, 1 / size), a)
    return x


def moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Ends repeated."""
    p = np.pad(x, (size // 2, size - 1 - size // 2), mode="edge")
    c = np.cumsum(np.insert(p, 0, 0.0))
    return (c[size:] - c[:-size]) / size


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames x bins, periodic Hann, scaled by the window's sum; zero-extended at the ends."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    x = np.pad(x, size // 2)
    x = np.pad(x, (0, -(len(x) - size) % hop))
    at = np.arange(0, len(x) - size + 1, hop)[:, None] + np.arange(size)
    return np.fft.rfft(x[at] * w, axis=1) / w.sum()


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = max(1, 1 + (len(x) - size) // hop) if len(x) >= size else 1
    return x[np.minimum(np.arange(n)[:, None] * hop + np.arange(size), len(x) - 1)]


def band(x: np.ndarray, rate: float, low: float | None, high: float | None, order: int = 4) -> np.ndarray:
    """Zero-phase band-pass with a Butterworth magnitude, applied twice, in the frequency domain of an oddly extended signal."""
    n = min(len(x) - 1, int(rate))
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
    f = np.fft.rfftfreq(len(ext), 1 / rate)
    gain = np.ones(len(f))
    if high:
        gain /= 1 + (f / high) ** (2 * order)
    if low:
        gain *= 1 - 1 / (1 + (f / low) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(ext) * gain, len(ext))[n : n + len(x)]


def envelope(x: np.ndarray) -> np.ndarray:
    """Size of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def triangles(n: int, bins: int, low: float, high: float, rate: float, mel: bool = False) -> np.ndarray:
    """n triangular filters between low and high Hz over rFFT bins."""
    up = (lambda f: 2595 * np.log10(1 + f / 700)) if mel else (lambda f: f)
    down = (lambda m: 700 * (10 ** (m / 2595) - 1)) if mel else (lambda m: m)
    edge = down(np.linspace(up(low), up(high), n + 2))
    f = np.linspace(0, rate / 2, bins)
    return np.maximum(0, np.minimum((f - edge[:-2, None]) / np.maximum(edge[1:-1] - edge[:-2], 1e-9)[:, None], (edge[2:, None] - f) / np.maximum(edge[2:] - edge[1:-1], 1e-9)[:, None]))


def safe(x: float) -> float:
    x = float(x)
    return x if np.isfinite(x) else 0.0


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def ratio(a, b, tiny: float = 1e-12) -> float:
    return safe(a / b) if abs(b) > tiny else 0.0
