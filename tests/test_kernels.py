"""Kernels against direct NumPy versions of the surveyed formulas, on small clips."""

import numpy as np
import pytest

from attestra.kernels import audio, av, visual


def clip(n=12, side=40, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, side, side, 3)).astype(np.uint8)


def luma(frames):
    return frames.astype(float) @ np.array([0.299, 0.587, 0.114])


def test_visual_temporal_features():
    f = clip()
    got, y = visual.features(f), luma(f)
    d = np.diff(y, axis=0)
    cos = [(a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) for a, b in zip(d[:-1], d[1:], strict=True)]
    step = np.abs(d).mean((1, 2))
    assert got["motion_smoothness"] == pytest.approx(np.mean(cos), rel=1e-6) and got["motion_smoothness"] < -0.4
    assert got["frame_diff_mean"] == pytest.approx(step.mean()) and got["frame_diff_std"] == pytest.approx(step.std())
    second = np.abs(y[2:] - 2 * y[1:-1] + y[:-2]).mean((1, 2))
    assert got["second_order_ratio"] == pytest.approx(second.mean() / step.mean(), rel=1e-6)
    assert got["duplicate_frame_rate"] == 0
    small = y[:, ::8, ::8].reshape(len(y), -1)
    small = small - small.mean(1, keepdims=True)
    pairs = [(j - i, small[i] @ small[j] / np.linalg.norm(small[i]) / np.linalg.norm(small[j])) for i in range(len(y)) for j in range(i + 2, len(y))]
    gap, like = np.array(pairs).T
    assert got["selfsim_offdiag_mean"] == pytest.approx(like.mean(), rel=1e-6)
    assert got["selfsim_decay_slope"] == pytest.approx(np.polyfit(gap, like, 1)[0] * len(y), rel=1e-5, abs=1e-9)
    p = np.histogram(like, 16, (-1, 1))[0] / len(like)
    assert got["selfsim_entropy"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum() / 4)


def test_visual_spatial_features():
    f = clip(4, 41, 1)
    got, y = visual.features(f), luma(f)
    pad = np.pad(y, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    lap = np.abs(pad[:, 2:, 1:-1] + pad[:, :-2, 1:-1] + pad[:, 1:-1, 2:] + pad[:, 1:-1, :-2] - 4 * y).mean((1, 2))
    assert got["hf_energy_mean"] == pytest.approx(lap.mean() / y.mean(), rel=1e-5)
    assert got["hf_energy_std"] == pytest.approx(lap.std() / y.mean(), rel=1e-4)
    m = y.mean(0)
    dv, dh = np.abs(np.diff(m, axis=0)), np.abs(np.diff(m, axis=1))
    on = dv[[7, 15, 23, 31, 39]].mean() + dh[:, [7, 15, 23, 31, 39]].mean()
    off = np.delete(dv, [7, 15, 23, 31, 39], 0).mean() + np.delete(dh, [7, 15, 23, 31, 39], 1).mean()
    assert got["blockiness"] == pytest.approx(on / off - 1, rel=1e-6, abs=1e-9)
    var = np.empty_like(m)
    big = np.pad(m, 4, mode="symmetric")
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            var[i, j] = big[i : i + 9, j : j + 9].var()
    assert got["local_var_mean"] == pytest.approx(var.mean(), rel=1e-6)
    assert got["local_var_dispersion"] == pytest.approx(var.std() / var.mean(), rel=1e-6)
    power = (np.abs(np.fft.rfft2(y - y.mean((1, 2), keepdims=True))) ** 2).mean(0)
    r = np.hypot(np.fft.fftfreq(41)[:, None], np.fft.rfftfreq(41)[None])
    assert got["hf_ratio"] == pytest.approx(power[r > 0.5 * r.max()].sum() / power.sum(), rel=1e-6)
    gray = np.repeat(f[..., :1], 3, axis=3)
    assert visual.features(gray)["color_residual_corr"] == pytest.approx(1)
    assert set(visual.features(np.full((3, 16, 16, 3), 7, np.uint8)).values()) <= set(np.nan_to_num(list(visual.features(np.full((3, 16, 16, 3), 7, np.uint8)).values())))


def test_audio_phase_features():
    rate = 16000
    x = np.sin(2 * np.pi * 500 * np.arange(rate) / rate) * 0.5
    noise = np.random.default_rng(0).normal(0, 0.1, rate)
    tone, rough = audio.features(x.astype(np.float32), rate), audio.features(noise.astype(np.float32), rate)
    # Each bin's advance over a hop, less that of its own frequency, weighted by magnitude.
    from attestra.kernels.dsp import stft

    spec = stft(noise.astype(np.float32).astype(float), 400, 160)
    wrapped = np.angle(spec[1:] / spec[:-1] * np.exp(-2j * np.pi * np.arange(spec.shape[1]) * 160 / 400))
    weight = np.abs(spec[1:]) / np.abs(spec[1:]).sum()
    assert rough["phase_advance_incoherence"] == pytest.approx(1 - np.abs((weight * np.exp(1j * wrapped)).sum()), abs=2e-3)
    assert 0 <= tone["phase_advance_incoherence"] <= 1
    voice = sum(np.sin(2 * np.pi * 150 * k * np.arange(rate) / rate) / k for k in range(1, 12)) * 0.1
    assert audio.features(voice.astype(np.float32), rate)["harmonic_energy_ratio"] > 0.9


@pytest.mark.parametrize("shift", [0.0, 200.0, -240.0, 320.0])
def test_av_features_recover_the_offset(shift):
    f, x = av.talking_clip(3, shift)
    got, intervals, reason = av.features(f, 25.0, x, 16000)
    assert reason is None and list(got) == list(av.NAMES)
    assert got["global_peak_lag_ms"] == pytest.approx(shift, abs=45)
    assert got["frac_windows_desynced"] > 0.5 if abs(shift) > 100 else got["frac_windows_desynced"] < 0.5
    v, a = av.visual_curve(f)[0], av.audio_curve(x, 16000, 25.0, len(f))
    assert got["envelope_corr"] == pytest.approx(np.corrcoef(v, a)[0, 1], rel=1e-6)
    assert 0 <= got["suspicious_fraction"] <= 1 and all(a < b for a, b, *_ in intervals)


def test_av_features_say_why_there_are_none():
    f, x = av.talking_clip(1)
    for frames, fps, sound in ((f, 25.0, x[:100]), (f, 25.0, None), (f[:5], 25.0, x), (f, 0, x), (np.repeat(f[:1], 20, 0), 25.0, x), (f, 25.0, x * 0)):
        got, intervals, reason = av.features(frames, fps, sound, 16000)
        assert got is None and not intervals and reason


def test_quick_sound():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    got = av.quick_sound(x, 16000)
    assert got["a_rms"] == pytest.approx(np.sqrt(0.5), rel=1e-3) and got["a_crest"] == pytest.approx(np.sqrt(2), rel=1e-3)
    assert got["a_hf_ratio"] < 0.01 and got["a_zcr"] == pytest.approx(2000 / 16000, rel=0.2)
    assert set(av.quick_sound(x[:100], 16000).values()) == {0.0} and set(av.quick_sound(None, 16000).values()) == {0.0}


@pytest.mark.parametrize("op", ["blend_seam", "resample_blur", "face_denoise", "temporal_flicker", "warp_jitter", "checkerboard", "frame_dup_drop"])
def test_visual_manipulations(op):
    from attestra.kernels import manipulate

    f, _ = av.talking_clip(5, side=48)
    got = manipulate.manipulate_frames(f, [op], 1)
    assert got.shape == f.shape and got.dtype == np.uint8 and not np.array_equal(got, f)
    assert np.array_equal(got, manipulate.manipulate_frames(f, [op], 1))
    if op != "frame_dup_drop":
        # Only the active box changes.
        rows, cols = manipulate.face_box(f)
        inside = np.zeros(f.shape[1:3], bool)
        inside[rows, cols] = True
        assert np.array_equal(got[:, ~inside], f[:, ~inside])
    a, b = visual.features(f[:48]), visual.features(got[:48])
    trace = {"resample_blur": b["hf_energy_mean"] < a["hf_energy_mean"], "face_denoise": b["noise_residual_std"] < a["noise_residual_std"], "checkerboard": b["hf_energy_mean"] > a["hf_energy_mean"], "frame_dup_drop": b["duplicate_frame_rate"] > a["duplicate_frame_rate"]}
    assert trace.get(op, True)
    with pytest.raises(ValueError):
        manipulate.manipulate_frames(f, ["nope"], 1)


def test_audio_manipulations():
    from attestra.kernels import manipulate

    rate = 16000
    t = np.arange(rate) / rate
    x = (np.sin(2 * np.pi * 400 * t) * (t > 0.5) * 0.4 + 0.05 * np.sin(2 * np.pi * 7000 * t) + 0.001).astype(np.float32)
    again = manipulate.overlap_add(manipulate.stft(x.astype(float), 400, 160), 400, 160, rate)
    assert np.abs(again - x)[400:-400].max() < 1e-3
    band = manipulate.manipulate_audio(x, rate, ["band_limit"], 0)
    high = lambda y: np.abs(np.fft.rfft(y))[6500:].sum()
    assert high(band) < 0.1 * high(x) and len(band) == rate
    assert (manipulate.manipulate_audio((x * (t > 0.5)).astype(np.float32), rate, ["silence_floor"], 0)[:7000] == 0).all()
    for op in ("spectral_oversmooth", "mel_phase_preserve", "mel_griffinlim"):
        y = manipulate.manipulate_audio(x, rate, [op], 0)
        assert len(y) == rate and np.isfinite(y).all() and not np.allclose(y, x)
    coherent = audio.features(manipulate.manipulate_audio(x, rate, ["mel_phase_preserve"], 0), rate)["phase_advance_incoherence"]
    assert np.isfinite(coherent)
    assert manipulate.shift(x, 100)[:100].tolist() == [0] * 100 and np.array_equal(manipulate.shift(x, -100)[:-100], x[100:])
    w = manipulate.warp(x, 0.2, 3)
    assert w[0] == x[0] and w[-1] == x[-1] and not np.allclose(w, x) and np.array_equal(manipulate.warp(x, 0.0, 3), x)
