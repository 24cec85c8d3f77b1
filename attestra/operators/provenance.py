"""Provenance: manifest and watermark claims, their contradictions and what follows from them.

Absent evidence is never negative evidence: tri-state claims stay null, and a missing
sidecar or detector is UNAVAILABLE, not a negative finding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status words.
DETECTED, NOT_DETECTED, UNAVAILABLE, ERROR = "detected", "not_detected", "unavailable", "error"
PRESENT, ABSENT, INVALID = "present", "absent", "invalid"


def with_sidecars(clips: DataFrame, manifests: DataFrame, watermarks: DataFrame, key: str) -> DataFrame:
    """Left joins of both sidecars: claims_ai (tri-state), manifest_status and watermark_status."""
    m = manifests.select(key, "claims_ai", "valid", F.lit(True).alias("has_manifest"))
    w = watermarks.select(key, "found", F.lit(True).alias("has_mark"))
    joined = clips.join(m, key, "left").join(w, key, "left")
    manifest = F.when(F.col("has_manifest").isNull(), ABSENT).when(~F.coalesce("valid", F.lit(False)), INVALID).otherwise(PRESENT)
    mark = F.when(F.col("has_mark").isNull() | F.col("found").isNull(), UNAVAILABLE).when(F.col("found"), DETECTED).otherwise(NOT_DETECTED)
    return joined.withColumn("manifest_status", manifest).withColumn("watermark_status", mark).drop("has_manifest", "has_mark")


def integrity_clash(claims_ai: Column, status: Column) -> Column:
    """A claim and a watermark that contradict each other; false where either is unknown."""
    return F.coalesce((~claims_ai & (status == DETECTED)) | (claims_ai & (status == NOT_DETECTED)), F.lit(False))


def escalation_reasons(clash: Column, manifest_status: Column, claims_ai: Column, status: Column) -> Column:
    """Reasons joined by '; ', empty where there is none."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(clash, "manifest and watermark contradict"),
                F.when(manifest_status == INVALID, "manifest invalid"),
                F.when(claims_ai, "manifest claims AI generation"),
                F.when(status == DETECTED, "watermark detected"),
            )
        ),
        "; ",
    )


#: Source types that claim generation, and the one that claims capture.
AI_TYPES = "trainedAlgorithmicMedia|compositeWithTrainedAlgorithmicMedia|algorithmicMedia"
CAPTURE = "digitalCapture"


def ai_claim(actions: Column) -> Column:
    """The first action whose source type decides: true for AI types, false for capture, else null."""
    kind = F.transform(actions, lambda a: F.when(a["digitalSourceType"].rlike(f"({AI_TYPES})$"), True).when(a["digitalSourceType"].rlike(f"{CAPTURE}$"), False))
    return F.get(F.filter(kind, lambda x: x.isNotNull()), F.lit(0))


def detector_status(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """One row a clip and requested detector; one that isn't registered is reported as unavailable."""
    asked = requested.select("*", F.explode("detectors").alias("detector")).drop("detectors")
    status = F.when(F.col("known").isNull(), UNAVAILABLE).when(~F.col("available"), UNAVAILABLE).otherwise("ready")
    reason = F.when(F.col("known").isNull(), "not registered").otherwise(F.col("reason"))
    return asked.join(registry.withColumn("known", F.lit(True)), "detector", "left").withColumn("status", status).withColumn("reason", reason).drop("known", "available")


def observed_metadata(tags: Column) -> Column:
    """Embedded keys that name a manifest, whatever their case."""
    return F.map_filter(tags, lambda k, v: F.lower(k).rlike("c2pa|jumbf"))


MANIFEST = "claims_ai_generated boolean, claim_generator string, _simulated boolean"


def parsed_sidecars(clips: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """sidecars: key, content (JSON text of a manifest). Adds claims_ai, claim_generator, manifest_status and detail;
    a file that can't be parsed keeps what the clip had (column ``fallback_status``) and appends its fault."""
    read = F.from_json("content", MANIFEST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    joined = clips.join(sidecars.select(key, "content", read.alias("m")), key, "left")
    broken = F.col("content").isNotNull() & (F.col("m").isNull() | F.col("m._bad").isNotNull())
    status = F.when(F.col("content").isNull() | broken, F.col("fallback_status")).otherwise(PRESENT)
    detail = F.when(F.col("content").isNull(), "no sidecar").when(broken, F.concat(F.lit("sidecar could not be parsed: "), F.substring("content", 1, 40))).when(F.col("m._simulated"), "simulated manifest").otherwise("manifest read")
    claims = {"claims_ai": "claims_ai_generated", "claim_generator": "claim_generator"}
    return joined.withColumns({**{c: F.when(~broken, F.col(f"m.{f}")) for c, f in claims.items()}, "manifest_status": status, "detail": detail}).drop("content", "m")


def embedded_manifest(metadata: Column, reader: bool = False) -> Column:
    """Status of a manifest embedded in the file: without a reader of signed manifests it is unavailable, and the
    observed keys say only that something is there."""
    seen = F.size(F.map_keys(observed_metadata(metadata)))
    status = F.lit(PRESENT) if reader else F.lit(UNAVAILABLE)
    return F.struct(F.when(seen > 0, status).otherwise(ABSENT).alias("status"), F.when(seen > 0, F.lit("read" if reader else "no reader of signed manifests here")).otherwise("no embedded keys").alias("detail"))


def run_detectors(clips: DataFrame, detectors: dict[str, Callable], requested: list[str], key: str, batched: tuple[str, ...] = ()) -> DataFrame:
    """Plug-ins over each clip: key, detector, status, confidence, detail. A detector gets a row (a dict) and gives found
    and confidence; those in ``batched`` get a batch (a pandas frame) and give a frame of found, confidence and detail in
    its order. One that isn't registered is unavailable. One that fails on a row gives a row of its own with status
    ERROR; a batch that fails is tried again row by row, so that the others keep their results."""

    def rows_of(name: str, b: pd.DataFrame) -> pd.DataFrame:
        found = detectors[name](b).reset_index(drop=True)
        if len(found) != len(b):
            raise ValueError(f"{len(found)} results for {len(b)} rows")
        none = found["found"].isna()
        return pd.DataFrame({
            key: b[key].to_numpy(), "detector": name, "status": np.where(none, ERROR, np.where(found["found"].fillna(False).astype(bool), DETECTED, NOT_DETECTED)),
            "confidence": found["confidence"].astype(float).fillna(0.0).where(~none) if "confidence" in found else pd.Series(0.0, found.index).where(~none), "detail": found["detail"].fillna("") if "detail" in found else "",
        })

    def one(name: str, b: pd.DataFrame) -> list[tuple]:
        out = []
        for i, row in enumerate(b.to_dict("records")):
            try:
                if name in batched:
                    out.append(tuple(rows_of(name, b.iloc[i : i + 1]).iloc[0]))
                    continue
                found = detectors[name](row)
                out.append((row[key], name, DETECTED if found["found"] else NOT_DETECTED, float(found.get("confidence", 0.0)), found.get("detail", "")))
            except Exception as e:  # a row, as one plug-in must not end the analysis
                out.append((row[key], name, ERROR, None, f"{type(e).__name__}: {e}"[:200]))
        return out

    columns = [key, "detector", "status", "confidence", "detail"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in requested:
                if name not in detectors:
                    yield pd.DataFrame({key: b[key], "detector": name, "status": UNAVAILABLE, "confidence": np.nan, "detail": "not registered"})
                    continue
                if name in batched and len(b):
                    try:
                        yield rows_of(name, b)
                        continue
                    except Exception:  # found out row by row below
                        pass
                yield pd.DataFrame(one(name, b), columns=columns)

    kind = clips.schema[key].dataType.simpleString()
    ran = clips.mapInPandas(run, f"{key} {kind}, detector string, status string, confidence double, detail string")
    return ran.withColumn("confidence", F.nanvl("confidence", F.lit(None)))
