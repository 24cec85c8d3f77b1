"""Manipulations of clips for a corpus: of the picture's most active box, of the voice, and of their timing.

Each works on whole arrays; a seed makes it repeat. Names are those of operators.corpus's pools.
"""

from __future__ import annotations

import numpy as np

from attestra.kernels.dsp import gaussian, moving_mean, stft


def face_box(frames: np.ndarray, share: float = 0.12) -> tuple[slice, slice]:
    """The box around the pixels that vary most; the middle half where nothing moves."""
    var = frames.astype(float).mean(3).var(0)
    h, w = var.shape
    if var.max() <= 0:
        return slice(h // 4, h - h // 4), slice(w // 4, w - w // 4)
    k = max(16, int(share * var.size))
    ys, xs = np.nonzero(var >= np.partition(var.ravel(), -min(k, var.size))[-min(k, var.size)])
    return slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Linear, over axes 1 and 2 of (time, height, width, 3), by two matrices."""

    def matrix(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        out = np.zeros((m, n))
        out[np.arange(m), low] = 1 - (at - low)
        if n > 1:
            out[np.arange(m), low + 1] += at - low
        return out

    return np.einsum("ah,thwc,bw->tabc", matrix(x.shape[1], h), x, matrix(x.shape[2], w), optimize=True)


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    return np.moveaxis(gaussian(np.moveaxis(x, 3, 1), sigma), 1, 3)


def manipulate_frames(frames: np.ndarray, ops: list[str], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = frames.astype(float)
    rows, cols = face_box(frames)
    n = len(x)
    for op in ops:
        face = x[:, rows, cols]
        h, w = face.shape[1:3]
        if op == "blend_seam":
            # A colour cast within the box, with a soft edge of two pixels.
            edge = np.minimum.outer(np.minimum(np.arange(h), np.arange(h)[::-1]), np.minimum(np.arange(w), np.arange(w)[::-1]))
            x[:, rows, cols] = face + np.clip(edge / 2, 0, 1)[..., None] * rng.uniform(4, 10, 3)
        elif op == "resample_blur":
            x[:, rows, cols] = resize(resize(face, max(2, int(h * 0.6)), max(2, int(w * 0.6))), h, w)
        elif op == "face_denoise":
            x[:, rows, cols] = 0.3 * face + 0.7 * blur(face, 1.5)
        elif op == "temporal_flicker":
            x[:, rows, cols] = face * (1 + 0.03 * rng.standard_normal(n))[:, None, None, None]
        elif op == "warp_jitter":
            shift = rng.integers(-1, 2, (n, 2))
            x[:, rows, cols] = np.stack([np.roll(f, s, (0, 1)) for f, s in zip(face, shift, strict=True)])
        elif op == "checkerboard":
            x[:, rows, cols] = face + 2.5 * (np.indices((h, w)).sum(0) % 2 * 2 - 1)[..., None]
        elif op == "frame_dup_drop":
            # Some frames repeat the one before them: as many frames, with repeats and jumps.
            keep = np.arange(n)
            again = rng.random(n) < 0.08
            again[0] = False
            x = x[np.maximum.accumulate(np.where(again, 0, keep))]
        else:
            raise ValueError(f"no such manipulation: {op}")
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


def overlap_add(spec: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """The inverse of dsp.stft, by weighted overlap of the frames."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.fft.irfft(spec * w.sum(), size, axis=1) * w
    out, weight = np.zeros(hop * (len(parts) - 1) + size), np.zeros(hop * (len(parts) - 1) + size)
    for i, p in enumerate(parts):
        out[i * hop : i * hop + size] += p
        weight[i * hop : i * hop + size] += w * w
    out = out / np.maximum(weight, 1e-3)
    return np.pad(out[size // 2 :], (0, max(0, length - len(out) + size // 2)))[:length]


def manipulate_audio(x: np.ndarray, rate: int, ops: list[str], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    size, hop = int(0.025 * rate) // 2 * 2, int(0.010 * rate)
    y = x.astype(float)
    for op in ops:
        if op == "silence_floor":
            # Digital silence where the voice pauses.
            level = np.sqrt(moving_mean(y * y, size))
            y = np.where(level < 0.1 * level.max(), 0.0, y) if len(y) else y
            continue
        spec = stft(y, size, hop)
        mag, phase = np.abs(spec), np.angle(spec)
        if op == "band_limit":
            mag = mag * (np.linspace(0, rate / 2, mag.shape[1]) <= min(6000, 0.4 * rate))
        elif op == "spectral_oversmooth":
            mag = np.exp(np.apply_along_axis(moving_mean, 1, np.log(mag + 1e-9), 9))
        elif op == "mel_phase_preserve":
            mag = np.exp(np.apply_along_axis(moving_mean, 1, np.log(mag + 1e-9), 5))
        elif op == "mel_griffinlim":
            # Only magnitudes survive; phases are found again by a few rounds of projection.
            mag = np.exp(np.apply_along_axis(moving_mean, 1, np.log(mag + 1e-9), 5))
            phase = rng.uniform(-np.pi, np.pi, mag.shape)
            for _ in range(8):
                phase = np.angle(stft(overlap_add(mag * np.exp(1j * phase), size, hop, len(y)), size, hop)[: len(mag)])
        else:
            raise ValueError(f"no such manipulation: {op}")
        y = overlap_add(mag * np.exp(1j * phase), size, hop, len(y))
    return y.astype(np.float32)


def shift(x: np.ndarray, samples: int) -> np.ndarray:
    """Later by so many samples (earlier if negative), with silence where nothing is left."""
    out = np.zeros_like(x)
    k = min(abs(samples), len(x))
    if samples >= 0:
        out[k:] = x[: len(x) - k]
    else:
        out[: len(x) - k] = x[k:]
    return out


def warp(x: np.ndarray, depth: float, seed: int) -> np.ndarray:
    """Time that runs fast and slow by up to ``depth`` of the clip, fixed at both ends."""
    n = len(x)
    if n < 2:
        return x.copy()
    t = np.arange(n) / (n - 1)
    at = t + depth * np.sin(2 * np.pi * t + np.random.default_rng(seed).uniform(0, 2 * np.pi)) * np.sin(np.pi * t) ** 2 / (2 * np.pi)
    return np.interp(np.clip(at, 0, 1) * (n - 1), np.arange(n), x).astype(x.dtype)
