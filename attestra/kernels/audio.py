"""71 audio features: 31 scalars and the means and deviations of 20 linear-frequency cepstra."""

from __future__ import annotations

import numpy as np

from attestra.kernels.dsp import band, dct_matrix, entropy, frames, ratio, safe, stft, triangles

#: Feature names in order.
SCALARS = (
    "spectral_centroid_mean spectral_centroid_std spectral_flatness_mean spectral_rolloff95_mean spectral_slope highband_ratio_6k highband_ratio_7k band_cliff_score band_cliff_freq spectral_entropy "
    "phase_advance_incoherence phase_bin_coherence group_delay_std group_delay_abs_mean f0_mean f0_std jitter_local shimmer_local hnr_db voiced_fraction silence_floor_db near_zero_sample_fraction "
    "silence_flatness modulation_4_8hz modulation_peak_freq energy_entropy zcr_mean zcr_std spectral_flux_mean spectral_flux_std harmonic_energy_ratio"
).split()
NAMES = [*SCALARS, *(f"lfcc_mean_{i:02d}" for i in range(20)), *(f"lfcc_std_{i:02d}" for i in range(20))]
LEAST_SECONDS = 0.2


def pitch(x: np.ndarray, rate: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """f0 (0 where unvoiced) and periodicity of 40 ms frames: low-passed, biased autocorrelation, 60 to 400 Hz."""
    size = int(0.04 * rate)
    fr = frames(band(x, rate, None, 900.0), size, hop)
    fr = fr - fr.mean(1, keepdims=True)
    spec = np.fft.rfft(fr, 2 * size, axis=1)
    ac = np.fft.irfft(np.abs(spec) ** 2, axis=1)[:, :size]
    ac /= ac[:, :1] + 1e-12
    low, high = int(rate / 400), min(int(rate / 60), size - 2)
    at = ac[:, low : high + 1].argmax(1) + low
    row = np.arange(len(ac))
    a, b, c = ac[row, at - 1], ac[row, at], ac[row, at + 1]
    curve = a - 2 * b + c
    shift = np.where(np.abs(curve) > 1e-12, 0.5 * (a - c) / np.where(np.abs(curve) > 1e-12, curve, 1), 0).clip(-0.5, 0.5)
    return np.where(b > 0.35, rate / (at + shift), 0.0), b


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flag.astype(int), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(x: np.ndarray, rate: int = 16000) -> dict[str, float] | None:
    """None for less than 0.2 s."""
    if len(x) < LEAST_SECONDS * rate:
        return None
    x = x.astype(float)
    size, hop = int(0.025 * rate), int(0.010 * rate)
    s = stft(x, size, hop)
    mag = np.abs(s)
    power = mag**2 + 1e-12
    freq = np.linspace(0, rate / 2, power.shape[1])
    total = power.sum(1)
    f = dict.fromkeys(NAMES, 0.0)

    centre = (power * freq).sum(1) / total
    f["spectral_centroid_mean"], f["spectral_centroid_std"] = centre.mean(), centre.std()
    flat = np.exp(np.log(power).mean(1)) / power.mean(1)
    f["spectral_flatness_mean"] = flat.mean()
    f["spectral_rolloff95_mean"] = freq[(np.cumsum(power, 1) >= 0.95 * total[:, None]).argmax(1)].mean()
    mean = power.mean(0)
    db = 10 * np.log10(mean)
    use = freq > 50
    octave = np.log2(freq[use] / 50)
    f["spectral_slope"] = np.polyfit(octave, db[use], 1)[0]
    f["highband_ratio_6k"], f["highband_ratio_7k"] = (ratio(mean[freq > c].sum(), mean.sum()) for c in (6000, 7000))
    high = freq > 3000  # cut first, then smoothed: what lies below doesn't leak in
    if high.sum() > 10:
        drop = np.diff(np.convolve(db[high], np.full(5, 0.2), "same"))
        f["band_cliff_score"], f["band_cliff_freq"] = -drop.min(), freq[high][drop.argmin()]
    p = mean / mean.sum()
    f["spectral_entropy"] = entropy(p) / np.log2(max((p > 0).sum(), 2))

    # Deviation of each bin's phase from the advance of a steady tone over one hop, weighted by magnitude.
    f["phase_advance_incoherence"] = f["phase_bin_coherence"] = 0.0
    if len(s) > 2:
        advance = np.angle(s[1:]) - np.angle(s[:-1]) - 2 * np.pi * np.arange(s.shape[1]) * hop / size
        f["phase_advance_incoherence"] = 1 - ratio(np.abs((mag[1:] * np.exp(1j * advance)).sum()), mag[1:].sum())
        between = np.angle(s[:, 1:]) - np.angle(s[:, :-1])
        f["phase_bin_coherence"] = ratio(np.abs((mag[:, 1:] * np.exp(1j * between)).sum()), mag[:, 1:].sum())
    nth = stft(x * np.arange(len(x)), size, hop)
    delay = np.real(nth * np.conj(s)) / (mag**2 + 1e-6)
    delay = np.sign(delay) * np.log1p(np.abs(delay))
    f["group_delay_std"], f["group_delay_abs_mean"] = delay.std(), np.abs(delay).mean()

    f0, periodic = pitch(x, rate, hop)
    voiced = f0 > 0
    f["voiced_fraction"] = voiced.mean()
    if voiced.sum() > 4:
        f["f0_mean"], f["f0_std"] = f0[voiced].mean(), f0[voiced].std()
        fr = frames(x, size, hop)
        amp = np.sqrt((fr**2).mean(1))[: len(f0)]
        jit, shim = [], []
        for a, z in _runs(voiced[: len(amp)]):
            if z - a >= 3:
                period = 1 / f0[a:z]
                jit.append(ratio(np.abs(np.diff(period)).mean(), period.mean()))
                shim.append(ratio(np.abs(np.diff(amp[a:z])).mean(), amp[a:z].mean()))
        f["jitter_local"], f["shimmer_local"] = (np.mean(v) if v else 0.0 for v in (jit, shim))
        q = periodic[voiced].clip(1e-6, 1 - 1e-6)
        f["hnr_db"] = 10 * np.log10((q / (1 - q)).mean())
        # Share of the long-term spectrum within a bin of the harmonics of the mean pitch.
        last = len(mean) - 1
        place = np.round(np.arange(1, int(rate / 2 / f["f0_mean"]) + 1) * f["f0_mean"] / (rate / 2) * last).astype(int)
        near = np.unique(np.clip(place[:, None] + [-1, 0, 1], 0, last))
        f["harmonic_energy_ratio"] = ratio(mean[near].sum(), mean.sum())

    level = 10 * np.log10(total / power.shape[1] + 1e-12)
    f["silence_floor_db"] = np.percentile(level, 5)
    f["near_zero_sample_fraction"] = (np.abs(x) < 1e-4).mean()
    quiet = level <= np.percentile(level, 15)
    if quiet.sum() > 2:
        f["silence_flatness"] = (np.exp(np.log(mag[quiet] + 1e-10).mean(1)) / (mag[quiet].mean(1) + 1e-12)).mean()
    env = np.sqrt(total)
    if len(env) > 16:
        m = np.abs(np.fft.rfft((env - env.mean()) * np.hanning(len(env))))
        mf = np.fft.rfftfreq(len(env), hop / rate)
        slow = (mf > 0.5) & (mf < 20)
        if slow.any():
            f["modulation_4_8hz"] = ratio(m[(mf >= 4) & (mf <= 8)].sum(), m[slow].sum())
            f["modulation_peak_freq"] = mf[slow][m[slow].argmax()]
    f["energy_entropy"] = entropy(total / total.sum()) / np.log2(max(len(total), 2))
    fr = frames(x, size, hop)
    zcr = (np.diff(np.sign(fr), axis=1) != 0).mean(1)
    f["zcr_mean"], f["zcr_std"] = zcr.mean(), zcr.std()
    unit = mag / (mag.sum(1, keepdims=True) + 1e-12)
    flux = np.linalg.norm(np.diff(unit, axis=0), axis=1)
    if len(flux):
        f["spectral_flux_mean"], f["spectral_flux_std"] = flux.mean(), flux.std()
    bank = np.log(power @ triangles(24, power.shape[1], 0, rate / 2, rate).T + 1e-10)
    cep = bank @ dct_matrix(24).T[:, :20]
    for i in range(20):
        f[f"lfcc_mean_{i:02d}"], f[f"lfcc_std_{i:02d}"] = cep[:, i].mean(), cep[:, i].std()
    return {k: safe(f[k]) for k in NAMES}


def log_mel(x: np.ndarray, rate: int = 16000, mels: int = 64) -> np.ndarray:
    p = np.abs(stft(x.astype(float), int(0.025 * rate), int(0.010 * rate))) ** 2
    return np.log(p @ triangles(mels, p.shape[1], 0, rate / 2, rate, mel=True).T + 1e-10)
