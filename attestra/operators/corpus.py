"""Corpus construction: variants, desynchrony, operation lists, splits, file filters, error rows.

Every draw is a hash of a row's key, so a corpus repeats exactly on any number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.acquisition import unit

#: Variant, pitch factor, speech-rate factor, noise factor, weights of quality low / medium / high.
VARIANTS = [("A", 1.0, 1.0, 1.0, 0.30, 0.40, 0.30), ("B", 1.18, 0.85, 1.5, 0.15, 0.35, 0.50)]
#: Probability of desynchrony by number of manipulated tracks.
DESYNC = (0.0, 0.70, 0.50)
#: Pools of operations by quality.
AUDIO_LOW = ["mel_griffinlim", "band_limit", "spectral_oversmooth", "silence_floor"]
AUDIO_MEDIUM = ["band_limit", "spectral_oversmooth", "silence_floor"]
VIDEO_LOW = ["blend_seam", "resample_blur", "face_denoise", "temporal_flicker", "warp_jitter", "checkerboard"]
VIDEO_MEDIUM = ["blend_seam", "resample_blur", "face_denoise", "temporal_flicker", "warp_jitter"]
VIDEO_HIGH = ["resample_blur", "face_denoise", "blend_seam"]
#: Picture types of video frames by code.
PICTURES = {0: "NONE", 1: "I", 2: "P", 3: "B", 4: "S", 5: "SI", 6: "SP", 7: "BI"}
MEDIA = ["mp4", "avi", "mov", "mkv", "webm"]


def draw(key: str, what: str) -> Column:
    """A uniform number in [0, 1) for one purpose of a row."""
    return unit(F.md5(F.concat_ws("|", F.lit(what), F.col(key).cast("string"))))


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "variant string, f0_factor double, rate_factor double, noise_factor double, w_low double, w_medium double, w_high double")


def perturb(rows: DataFrame) -> DataFrame:
    """rows: variant, f0_base, speech_rate, noise_sigma. Each is scaled as its variant says; other variants drop out."""
    j = rows.join(F.broadcast(variants(rows.sparkSession)), "variant")  # two rows
    scaled = {"f0_base": "f0_factor", "speech_rate": "rate_factor", "noise_sigma": "noise_factor"}
    return j.withColumns({c: F.col(c) * F.col(f) for c, f in scaled.items()}).drop(*scaled.values(), "w_low", "w_medium", "w_high")


def desynchronised(video_fake: Column, audio_fake: Column, u: Column) -> Column:
    """Whether a clip ends up out of step: never if genuine, by DESYNC otherwise."""
    share = F.when(video_fake & audio_fake, F.lit(DESYNC[2])).when(video_fake | audio_fake, F.lit(DESYNC[1])).otherwise(F.lit(DESYNC[0]))
    return u < share


def quality(u: Column, low: Column | float = 0.30, medium: Column | float = 0.40) -> Column:
    low = F.lit(low) if isinstance(low, float) else low
    medium = F.lit(medium) if isinstance(medium, float) else medium
    return F.when(u < low, "low").when(u < low + medium, "medium").otherwise("high")


def some_of(pool: list[str], key: str, what: str, n: Column | int) -> Column:
    """n of the pool without repeats, in the order of their hashes with the row's key."""
    ranked = F.transform(F.array(*[F.lit(x) for x in pool]), lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(what), F.col(key).cast("string"), x)).alias("h"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(ranked), lambda s: s["x"]), 1, n)


def audio_operations(level: Column, key: str) -> Column:
    """Artefacts of a synthetic voice of a quality; a low one always has the crude vocoder."""
    crude = some_of(AUDIO_LOW, key, "audio", F.when(draw(key, "audio-n") < 0.5, 3).otherwise(4))
    low = F.when(F.array_contains(crude, "mel_griffinlim"), crude).otherwise(F.concat(F.array(F.lit("mel_griffinlim")), F.slice(crude, 2, F.size(crude))))
    base = F.when(draw(key, "audio-base") < 0.5, "mel_griffinlim").otherwise("mel_phase_preserve")
    medium = F.concat(F.array(base), some_of(AUDIO_MEDIUM, key, "audio", 1))
    high = F.when(draw(key, "audio-high") < 0.35, F.array(F.lit("mel_phase_preserve"), F.lit("spectral_oversmooth"))).otherwise(F.array(F.lit("mel_phase_preserve")))
    return F.when(level == "low", low).when(level == "medium", medium).otherwise(high)


def video_operations(level: Column, key: str) -> Column:
    """Manipulations of a picture of a quality; any may also repeat and drop frames."""
    low = some_of(VIDEO_LOW, key, "video", F.when(draw(key, "video-n") < 0.5, 3).otherwise(4))
    chosen = F.when(level == "low", low).when(level == "medium", some_of(VIDEO_MEDIUM, key, "video", 2)).otherwise(some_of(VIDEO_HIGH, key, "video", 1))
    return F.when(draw(key, "video-drop") < 0.15, F.array_append(chosen, F.lit("frame_dup_drop"))).otherwise(chosen)


def in_split(rows: DataFrame, split: str, most: int | None = None, order: str = "clip_id") -> DataFrame:
    """Rows of one split; the first ``most`` in order where a limit is asked for."""
    found = rows.where(F.col("split") == split)
    return found if most is None else found.orderBy(order).limit(most)


def usable_file(name: Column, size: Column, most_bytes: int, extensions: list[str] | None = None) -> Column:
    """By extension (any case) and size."""
    return F.lower(name).rlike(r"\.(" + "|".join(extensions or MEDIA) + ")$") & (size <= F.lit(most_bytes))


def picture_type(x: Column) -> Column:
    """The letter of a frame's type, given as a code or as a (dotted) name."""
    table = F.create_map(*[F.lit(v) for kv in PICTURES.items() for v in kv])
    code = x.try_cast("int")
    return F.when(x.isNull(), "NONE").when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit("NONE"))).otherwise(F.upper(F.element_at(F.split(x.cast("string"), r"\."), -1)))


def build(plan: DataFrame, make: Callable[[dict], dict], schema: str) -> DataFrame:
    """make(row) for each row of a plan, in parallel; a row that fails stays, with its message in ``error``."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out.append({**dict.fromkeys(names), **make(row), "error": None})
                except Exception as e:  # kept as a row, as one clip must not end the corpus
                    out.append({**dict.fromkeys(names), **{k: v for k, v in row.items() if k in names}, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out, columns=[*names, "error"])

    return plan.mapInPandas(run, f"{schema}, error string")


def with_features(manifest: DataFrame, features: DataFrame, key: str = "clip_id") -> DataFrame:
    """The feature cache met with its manifest; cached rows without a manifest row drop out."""
    return features.join(manifest, key)
