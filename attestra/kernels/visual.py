"""28 visual features of a clip's frames (time, height, width, 3)."""

from __future__ import annotations

import numpy as np

from attestra.kernels.dsp import entropy, gaussian, laplacian, moving_mean, ratio, safe, uniform

#: Feature names in order.
NAMES = (
    "hf_energy_mean",
    "hf_energy_std",
    "hf_ratio",
    "hf_grid_min_ratio",
    "hf_grid_dispersion",
    "noise_residual_std",
    "noise_autocorr_lag1",
    "noise_residual_kurtosis",
    "noise_grid_dispersion",
    "color_residual_corr",
    "blockiness",
    "edge_density",
    "seam_score",
    "spectral_peakiness",
    "local_var_mean",
    "local_var_dispersion",
    "frame_diff_mean",
    "frame_diff_std",
    "flicker_index",
    "second_order_mean",
    "second_order_ratio",
    "motion_smoothness",
    "selfsim_offdiag_mean",
    "selfsim_decay_slope",
    "selfsim_entropy",
    "duplicate_frame_rate",
    "hf_temporal_std",
    "residual_temporal_std",
)


def grid_mean(x: np.ndarray, n: int = 6) -> np.ndarray:
    return np.array([[c.mean() if c.size else 0.0 for c in np.array_split(r, n, axis=1)] for r in np.array_split(x, n, axis=0)])


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    return ratio((a * b).sum(), np.sqrt((a * a).sum() * (b * b).sum()))


def features(frames: np.ndarray, most: int = 48) -> dict[str, float]:
    if frames.ndim != 4 or not len(frames) or min(frames.shape[1:3]) < 2:
        raise ValueError("frames must be (time, height, width, 3), 2 x 2 at least")
    at = np.arange(len(frames)) if len(frames) <= most else np.unique(np.linspace(0, len(frames) - 1, most).astype(int))
    rgb = frames[at].astype(float)
    y = rgb @ np.array([0.299, 0.587, 0.114])
    n, h, w = y.shape
    f: dict[str, float] = {}

    detail = np.abs(laplacian(y))
    energy, level = detail.mean((1, 2)), y.mean() + 1e-6
    f["hf_energy_mean"], f["hf_energy_std"], f["hf_temporal_std"] = energy.mean() / level, energy.std() / level, ratio(energy.std(), energy.mean())
    # Half the spectrum, as that of real frames is symmetric.
    power = (np.abs(np.fft.rfft2(y - y.mean((1, 2), keepdims=True))) ** 2).mean(0)
    radius = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :])
    radius /= radius.max() or 1
    f["hf_ratio"] = ratio(power[radius > 0.5].sum(), power.sum())
    ring = power[(radius > 0.55) & (radius < 0.98)]
    f["spectral_peakiness"] = ratio(np.percentile(ring, 99.9), np.median(ring)) if len(ring) > 16 else 0.0
    grid = grid_mean(detail.mean(0))
    f["hf_grid_min_ratio"], f["hf_grid_dispersion"] = ratio(grid.min(), np.median(grid)), ratio(grid.std(), np.median(grid))

    rest = y - gaussian(y, 1.2)
    f["noise_residual_std"] = rest.std()
    moment = lambda k: ((rest - rest.mean((1, 2), keepdims=True)) ** k).mean((1, 2))
    f["noise_residual_kurtosis"] = (moment(4) / (moment(2) + 1e-12) ** 2).mean() - 3
    left, right = rest[:, :, :-1], rest[:, :, 1:]
    f["noise_autocorr_lag1"] = ratio((left * right).mean(), np.sqrt((left**2).mean() * (right**2).mean()))
    grid = grid_mean(np.abs(rest).mean(0))
    f["noise_grid_dispersion"] = ratio(grid.std(), np.median(grid))
    red, blue = (rgb[..., c] - gaussian(rgb[..., c], 1.2) for c in (0, 2))
    f["color_residual_corr"] = _corr(red, blue)
    level = np.abs(rest).mean((1, 2))
    f["residual_temporal_std"] = ratio(level.std(), level.mean())

    mean = y.mean(0)
    # Steps of the mean frame between rows and between columns, on the grid of eight (phase 7) and off it.
    on = off = 0.0
    for steps in (np.abs(np.diff(mean, axis=0)), np.abs(np.diff(mean, axis=1)).T):
        grid = np.arange(len(steps)) % 8 == 7
        on += steps[grid].mean() if len(steps) > 8 else steps.mean()
        off += steps[~grid].mean()
    f["blockiness"] = on / (off + 1e-9) - 1
    edge = np.hypot(*np.gradient(mean))
    f["edge_density"] = (edge > np.percentile(edge, 90)).mean()
    square = lambda x: uniform(x[None], 9)[0]
    variance = np.maximum(square(mean * mean) - square(mean) ** 2, 0)
    f["local_var_mean"], f["local_var_dispersion"] = variance.mean(), ratio(variance.std(), variance.mean())
    slope = np.hypot(*np.gradient(gaussian(np.log1p(variance)[None], 2.0)[0]))
    f["seam_score"] = np.percentile(slope, 99.5) / (np.median(slope) + 1e-9)

    step = np.abs(np.diff(y, axis=0)).mean((1, 2))
    f["frame_diff_mean"], f["frame_diff_std"] = (step.mean(), step.std()) if n > 1 else (0.0, 0.0)
    f["duplicate_frame_rate"] = (step < 0.15).mean() if n > 1 else 0.0
    bright = y.mean((1, 2))
    f["flicker_index"] = ratio((bright - moving_mean(bright, 5)).std(), bright.mean())
    f["second_order_mean"] = f["second_order_ratio"] = f["motion_smoothness"] = 0.0
    if n >= 3:
        second = np.abs(y[2:] - 2 * y[1:-1] + y[:-2]).mean((1, 2))
        f["second_order_mean"], f["second_order_ratio"] = second.mean(), ratio(second.mean(), step.mean())
        change = np.diff(y, axis=0).reshape(n - 1, -1)
        size = np.linalg.norm(change, axis=1)
        f["motion_smoothness"] = ((change[1:] * change[:-1]).sum(1) / (size[1:] * size[:-1] + 1e-12)).mean()
    small = y[:, ::8, ::8].reshape(n, -1)
    small = small - small.mean(1, keepdims=True)
    small /= np.linalg.norm(small, axis=1, keepdims=True) + 1e-9
    i, j = np.triu_indices(n, 2)
    f["selfsim_offdiag_mean"] = f["selfsim_decay_slope"] = f["selfsim_entropy"] = 0.0
    if len(i) > 4:
        like, gap = (small[i] * small[j]).sum(1), (j - i).astype(float)
        f["selfsim_offdiag_mean"] = like.mean()
        f["selfsim_decay_slope"] = ratio(((gap - gap.mean()) * (like - like.mean())).sum(), ((gap - gap.mean()) ** 2).sum()) * n
        f["selfsim_entropy"] = entropy(np.histogram(like, 16, (-1, 1))[0] / len(like)) / 4.0
    return {k: safe(f[k]) for k in NAMES}


def region_features(frames: np.ndarray, most: int = 48) -> dict[str, float]:
    """The full frame and its four quadrants: 140 features."""
    h, w = frames.shape[1] // 2, frames.shape[2] // 2
    regions = {"": frames, "tl_": frames[:, :h, :w], "tr_": frames[:, :h, w:], "bl_": frames[:, h:, :w], "br_": frames[:, h:, w:]}
    return {p + k: v for p, x in regions.items() for k, v in features(x, most).items()}
