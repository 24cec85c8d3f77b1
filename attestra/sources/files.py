"""File sources: byte scans, JSON, configuration overlays, archives, media in open formats.

Media here are WAV (PCM) and NumPy arrays of frames: their headers are the probe, and their
decoding needs no codec. Other formats are reported as unavailable, never as findings.
"""

from __future__ import annotations

import io
import json
import wave
import zipfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000

#: Defaults of the engine's configuration, by section.
DEFAULTS: dict[str, Any] = {
    "device_tier": "consumer",
    "canonical": {"sample_rate": RATE, "mono": True},
    "triage": {"threshold": 0.10, "top": 5, "short_circuit": False},
    "detection": {"visual_frames": 48, "tier2_enabled": True, "av_hop_s": 0.25},
    "fusion": {"vacuity_penalty": 3.0},
}
#: Frames sampled, second tier, hop of synchrony windows, by device tier.
TIERS = {"cloud": (96, True, 0.125), "consumer": (48, True, 0.25), "edge": (16, False, 0.5)}


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content and sha256 of each file under a folder; Spark's scan passes over files of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON; a file that can't be parsed gives a row of nulls."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", "true").json(path)


def overlay(values: dict[str, Any], base: dict[str, Any] | None = None) -> dict[str, Any]:
    """A configuration with some values replaced; an unknown key is a KeyError, in sections as well."""
    base = DEFAULTS if base is None else base
    out = dict(base)
    for k, v in values.items():
        if k not in base:
            raise KeyError(f"unknown configuration key: {k!r}")
        out[k] = overlay(v, base[k]) if isinstance(base[k], dict) and isinstance(v, dict) else v
    return out


def load_config(spark: SparkSession, path: str | None = None) -> dict[str, Any]:
    """Defaults, overlaid by a JSON or YAML file that Spark's readers can open."""
    if path is None:
        return overlay({})
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return overlay(yaml.safe_load(text) or {})
    return overlay(json.loads(text))


def apply_tier(config: dict[str, Any], tier: str) -> dict[str, Any]:
    if tier not in TIERS:
        raise ValueError(f"unknown device tier: {tier!r}")
    frames, second, hop = TIERS[tier]
    return overlay({"device_tier": tier, "detection": {"visual_frames": frames, "tier2_enabled": second, "av_hop_s": hop}}, config)


# Media


def probe_bytes(data: bytes) -> dict[str, Any]:
    """The probe of a WAV or NumPy file, in the shape of a container probe; ValueError for others."""
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            seconds = w.getnframes() / max(1, w.getframerate())
            stream = {"codec_type": "audio", "codec_name": f"pcm_s{8 * w.getsampwidth()}le", "sample_rate": str(w.getframerate()), "channels": str(w.getnchannels())}
        return {"format": {"format_name": "wav", "duration": str(seconds), "size": str(len(data)), "tags": {}}, "streams": [stream]}
    if data[:6] == b"\x93NUMPY":
        shape = np.load(io.BytesIO(data), allow_pickle=False).shape
        if len(shape) != 4 or shape[3] != 3:
            raise ValueError(f"not frames: {shape}")
        stream = {"codec_type": "video", "codec_name": "rawvideo", "width": str(shape[2]), "height": str(shape[1]), "nb_frames": str(shape[0]), "avg_frame_rate": "25/1"}
        return {"format": {"format_name": "npy", "duration": str(shape[0] / 25), "size": str(len(data)), "tags": {}}, "streams": [stream]}
    raise ValueError("no reader for this format")


def audio_of(data: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 samples at ``rate``, by linear interpolation."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bit samples")
    x = x.reshape(-1, channels).mean(1)
    n = int(round(len(x) * rate / own)) if own else 0
    return x.astype(np.float32) if own == rate or not len(x) else np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)


def wav_of(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(samples.astype(np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def canonical(data: bytes) -> tuple[bytes, list[str]]:
    """The canonical form and what was done: WAV as 16-bit mono at RATE without other chunks, frames as 8-bit arrays."""
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            own, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        done = ["strip_metadata", *(["resample"] if own != RATE else []), *(["downmix"] if channels > 1 else []), *(["requantise"] if width != 2 else [])]
        return wav_of(audio_of(data)), done
    probe_bytes(data)
    out = io.BytesIO()
    frames = np.load(io.BytesIO(data), allow_pickle=False)
    np.save(out, frames.astype(np.uint8))
    return out.getvalue(), ["strip_metadata", *(["requantise"] if frames.dtype != np.uint8 else [])]


INGESTED = "path string, source_sha256 string, probe string, canonical_sha256 string, transforms array<string>, frames binary, shape array<int>, fps double, audio binary, sample_rate int, error string"


def ingest(files: DataFrame) -> DataFrame:
    """files: path, content, sha256 (see scan). Probe before the metadata goes, canonical form, its hash and the
    decoded tracks; a file without a readable stream stays as a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out = []
            for r in b.itertuples():
                row: dict[str, Any] = {"path": r.path, "source_sha256": r.sha256}
                try:
                    data = bytes(r.content)
                    row["probe"] = json.dumps(probe_bytes(data))
                    plain, row["transforms"] = canonical(data)
                    row["canonical_sha256"] = hashlib.sha256(plain).hexdigest()
                    if plain[:4] == b"RIFF":
                        row |= {"audio": audio_of(plain).tobytes(), "sample_rate": RATE}
                    else:
                        f = np.load(io.BytesIO(plain), allow_pickle=False)
                        row |= {"frames": f.tobytes(), "shape": list(f.shape), "fps": 25.0}
                except Exception as e:  # kept as a row
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                out.append(row)
            names = [c.split()[0] for c in INGESTED.split(", ")]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    return files.select("path", "content", "sha256").mapInPandas(run, INGESTED)


def extract(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """archives: archive, content (ZIP bytes). wanted: archive, member. The members' bytes; a member that is
    missing or damaged, or an archive that can't be opened, stays as a row with ``error``."""
    jobs = wanted.groupBy("archive").agg(F.sort_array(F.collect_set("member")).alias("members")).join(archives.select("archive", "content"), "archive", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                try:
                    z = zipfile.ZipFile(io.BytesIO(r.content))
                except Exception as e:  # kept as rows
                    yield pd.DataFrame([(r.archive, m, None, f"{type(e).__name__}: {e}"[:120]) for m in r.members], columns=["archive", "member", "data", "error"])
                    continue
                for m in r.members:
                    try:
                        row = (r.archive, m, z.read(m), None)
                    except Exception as e:  # kept as a row
                        row = (r.archive, m, None, f"{type(e).__name__}: {e}"[:120])
                    yield pd.DataFrame([row], columns=["archive", "member", "data", "error"])

    return jobs.mapInPandas(run, "archive string, member string, data binary, error string")


def transfer_stats(extracted: DataFrame) -> DataFrame:
    """Per archive: members read, failed, bytes."""
    return extracted.groupBy("archive").agg(F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes"))


def sink(extracted: DataFrame, each) -> DataFrame:
    """Calls each(archive, member, data) where the data are; returns archive, member and what it returned, as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.archive, r.member, str(each(r.archive, r.member, bytes(r.data)))) for r in b.itertuples()], columns=["archive", "member", "result"])

    return extracted.where("error IS NULL").select("archive", "member", "data").mapInPandas(run, "archive string, member string, result string")
