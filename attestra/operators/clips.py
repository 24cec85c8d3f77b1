"""Kernels over tables of decoded clips.

A clip is a row: clip_id, frames BINARY with shape ARRAY<INT> (time, height, width, 3), fps,
audio BINARY (float32) and sample_rate. Kernels run in Arrow batches; what a clip lacks gives
available = false and a reason, never a negative finding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.kernels import audio, av, manipulate, phash, visual

CLIP = "clip_id long, frames binary, shape array<int>, fps double, audio binary, sample_rate int"
FEATURES = "clip_id long, available boolean, reason string, features array<double>"


def frames_of(row) -> np.ndarray | None:
    if row.frames is None or row.shape is None:
        return None
    return np.frombuffer(row.frames, np.uint8).reshape(row.shape)


def audio_of(row) -> np.ndarray | None:
    return None if row.audio is None else np.frombuffer(row.audio, np.float32)


def generate(spark: SparkSession, n: int, partitions: int = 8, shift_ms: float = 0.0) -> DataFrame:
    """n seeded talking clips, made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                f, x = av.talking_clip(int(i), shift_ms)
                yield pd.DataFrame({"clip_id": [i], "frames": [f.tobytes()], "shape": [list(f.shape)], "fps": [25.0], "audio": [x.tobytes()], "sample_rate": [16000]})

    return spark.range(0, n, 1, min(partitions, max(n, 1))).mapInPandas(run, CLIP)


def from_texts(rows: DataFrame, key: str, text: str, shift_ms: float = 0.0) -> DataFrame:
    """A talking clip for each row, whose voice and mouth follow the bytes of its text; null texts have no tracks.
    A stand-in for media where a table has none: what the kernels see comes from the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content in zip(b["clip_id"], b["content"], strict=True):
                if content is None:
                    yield pd.DataFrame({"clip_id": [i], "frames": [None], "shape": [None], "fps": [25.0], "audio": [None], "sample_rate": [16000]})
                    continue
                f, x = av.talking_clip(zlib.crc32(content), shift_ms, content=content)
                yield pd.DataFrame({"clip_id": [i], "frames": [f.tobytes()], "shape": [list(f.shape)], "fps": [25.0], "audio": [x.tobytes()], "sample_rate": [16000]})

    return rows.select(F.col(key).cast("long").alias("clip_id"), F.col(text).cast("binary").alias("content")).mapInPandas(run, CLIP)


def manipulated(clips: DataFrame) -> DataFrame:
    """clips with video_ops, audio_ops (arrays of names), desync_ms and seed: the clips as manipulated, and ``error``
    where an operation failed; such a clip keeps its tracks as they were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                frames, sound, error = r.frames, r.audio, None
                try:
                    if r.frames is not None and len(r.video_ops):
                        frames = manipulate.manipulate_frames(frames_of(r), list(r.video_ops), int(r.seed)).tobytes()
                    if r.audio is not None:
                        x = manipulate.manipulate_audio(audio_of(r), int(r.sample_rate), list(r.audio_ops), int(r.seed)) if len(r.audio_ops) else audio_of(r)
                        sound = manipulate.shift(x, round(r.desync_ms / 1000 * r.sample_rate)).tobytes()
                except Exception as e:  # kept as a row
                    frames, sound, error = r.frames, r.audio, f"{type(e).__name__}: {e}"[:200]
                out.append((r.clip_id, frames, r.shape, r.fps, sound, r.sample_rate, error))
            yield pd.DataFrame(out, columns=["clip_id", "frames", "shape", "fps", "audio", "sample_rate", "error"])

    return clips.mapInPandas(run, f"{CLIP}, error string")


def _kernel(clips: DataFrame, kernel: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples():
                values, reason = kernel(row)
                out.append((row.clip_id, values is not None, reason, None if values is None else [float(v) for v in values]))
            yield pd.DataFrame(out, columns=["clip_id", "available", "reason", "features"])

    return clips.mapInPandas(run, FEATURES)


def visual_features(clips: DataFrame, regions: bool = False) -> DataFrame:
    def kernel(row):
        f = frames_of(row)
        if f is None or not len(f) or min(f.shape[1:3]) < (4 if regions else 2):
            return None, "no usable frames"
        return (visual.region_features if regions else visual.features)(f).values(), None

    return _kernel(clips, kernel)


def audio_features(clips: DataFrame) -> DataFrame:
    def kernel(row):
        x = audio_of(row)
        found = None if x is None else audio.features(x, int(row.sample_rate))
        return (None, "no audio" if x is None else "audio under 0.2 s") if found is None else (found.values(), None)

    return _kernel(clips, kernel)


def av_features(clips: DataFrame) -> DataFrame:
    """The 15 synchrony features of each clip."""

    def kernel(row):
        f = frames_of(row)
        if f is None:
            return None, "no usable frames"
        found, _, reason = av.features(f, row.fps or 0, audio_of(row), int(row.sample_rate or 0))
        return (None, reason) if found is None else (found.values(), None)

    return _kernel(clips, kernel)


def tier0_features(clips: DataFrame) -> DataFrame:
    """The 19 features of the first tier: motion from the column ``motion`` (13 numbers of the decoder; zeros where
    there is none, which the gate then knows from has_motion) and sound."""
    has = "motion" in clips.columns

    def kernel(row):
        motion = list(row.motion) if has and row.motion is not None else [0.0] * len(av.MOTION)
        return [*motion, *av.quick_sound(audio_of(row), int(row.sample_rate or 1)).values()], None

    return _kernel(clips, kernel)


def log_mel(clips: DataFrame, mels: int = 64) -> DataFrame:
    """The mean log-mel spectrum of each clip's sound."""

    def kernel(row):
        x = audio_of(row)
        return (None, "no audio") if x is None or len(x) < 400 else (audio.log_mel(x, int(row.sample_rate), mels).mean(0), None)

    return _kernel(clips, kernel)


def activity_curves(clips: DataFrame) -> DataFrame:
    """clip_id, t, a (mouth), b (voice): long form for the synchrony operators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                f, x = frames_of(row), audio_of(row)
                if f is None or x is None or len(f) < 8 or not row.fps > 0 or len(x) < 1000:
                    continue
                v, a = av.visual_curve(f)[0], av.audio_curve(x, int(row.sample_rate), row.fps, len(f))
                yield pd.DataFrame({"clip_id": row.clip_id, "t": np.arange(len(f), dtype=np.int64), "a": v, "b": a})

    return clips.mapInPandas(run, "clip_id long, t long, a double, b double")


def hashes(clips: DataFrame) -> DataFrame:
    """clip_id, video_phash and audio_phash as arrays of 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.clip_id, phash.video_hashes(f) if (f := frames_of(r)) is not None else [], phash.audio_hashes(x) if (x := audio_of(r)) is not None else []) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["clip_id", "video_phash", "audio_phash"])

    return clips.mapInPandas(run, "clip_id long, video_phash array<long>, audio_phash array<long>")


def commitments(clips: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Leaf hashes of each track's chunks: clip_id, track, leaves. A missing track has no leaves; its root is seal.NO_TRACK."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf = lambda head, data: hashlib.sha256(b"\0" + head.encode() + data).hexdigest()
        for b in batches:
            out = []
            for r in b.itertuples():
                f, x = frames_of(r), audio_of(r)
                step = max(1, round(seconds * (r.fps or 1)))
                out.append((r.clip_id, "video", [leaf(f"video|{f.dtype}|{f[i:i + step].shape}|{i}|{min(i + step, len(f))}", f[i : i + step].tobytes()) for i in range(0, len(f), step)] if f is not None else []))
                step = max(1, int(seconds * r.sample_rate))
                out.append((r.clip_id, "audio", [leaf(f"audio|{x.dtype}|{x[i:i + step].shape}|{i}|{min(i + step, len(x))}", x[i : i + step].tobytes()) for i in range(0, len(x), step)] if x is not None else []))
            yield pd.DataFrame(out, columns=["clip_id", "track", "leaves"])

    return clips.mapInPandas(run, "clip_id long, track string, leaves array<string>")


def feature_map(names: list[str]):
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("features"))
