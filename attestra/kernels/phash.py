"""Perceptual hashes of frames and audio: DCT coefficients against their median, 64 bits."""

from __future__ import annotations

import numpy as np

from attestra.kernels.dsp import dct_matrix


def bits_to_hash(values: np.ndarray) -> int:
    """64 values to a signed 64-bit hash: above the median of all but the first, first bit highest."""
    bits = values > np.median(values[1:])
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64))


def shrink(gray: np.ndarray, side: int = 32) -> np.ndarray:
    """Area means over integer edges, one pixel at least."""
    h, w = gray.shape
    table = np.pad(gray, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y0, x0 = np.arange(side) * h // side, np.arange(side) * w // side
    y1, x1 = np.maximum((np.arange(side) + 1) * h // side, y0 + 1), np.maximum((np.arange(side) + 1) * w // side, x0 + 1)
    y0, y1, x0, x1 = (np.minimum(v, n) for v, n in ((y0, h - 1), (y1, h), (x0, w - 1), (x1, w)))
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def frame_hash(frame: np.ndarray) -> int:
    d = dct_matrix(32)
    return bits_to_hash((d @ shrink(frame.astype(float).mean(2)) @ d.T)[:8, :8].ravel())


def video_hashes(frames: np.ndarray, most: int = 32) -> list[int]:
    if not len(frames):
        return []
    at = np.unique(np.linspace(0, len(frames) - 1, min(most, len(frames))).astype(int))
    return [frame_hash(frames[i]) for i in at]


def audio_hashes(x: np.ndarray, segments: int = 16, bands: int = 64, least: int = 256) -> list[int]:
    """A hash a segment; fewer segments where they would be shorter than ``least``, and none under 64 samples."""
    n = max(1, min(segments, len(x) // least)) if len(x) else 0
    ends = np.linspace(0, len(x), n + 1).astype(int) if n else []
    out = []
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        part = x[a:z].astype(float)
        if len(part) < 64:
            continue
        mag = np.abs(np.fft.rfft(part * np.hanning(len(part))))
        edge = np.unique(np.geomspace(1, max(2, len(mag) - 1), bands + 1).astype(int))
        if len(edge) < bands + 1:
            edge = np.linspace(1, len(mag) - 1, bands + 1).astype(int)
        level = np.array([mag[lo : max(hi, lo + 1)].mean() for lo, hi in zip(edge[:-1], edge[1:], strict=True)])
        out.append(bits_to_hash(dct_matrix(bands) @ np.log1p(level)))
    return out
