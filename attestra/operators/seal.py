"""Sealing: context hash, custody record, environment, timestamps, bundle descriptors, release gate."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import custody

#: Digest that stands for a track that isn't there; it has no chunks.
NO_TRACK = hashlib.sha256(b"no-track").hexdigest()
AUTHORITY = "local_nonqualified"
#: What a local clock attests and what it doesn't.
CLOCK_NOTE = "Local clock: orders entries of this ledger only. Not an RFC 3161 or eIDAS qualified time stamp; no third party attests the time."


def canonical_json(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


def digest(x: Any) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def track_root(root: Column) -> Column:
    """A track's root, or the sentinel where there is no track."""
    return F.coalesce(root, F.lit(NO_TRACK))


def context_hash(config: Column, models: Column, schema: Column, verdict: Column) -> Column:
    """SHA-256 of the four in canonical JSON; ``models`` is JSON already. The time isn't part of it."""
    quoted = lambda c: F.substring(F.to_json(F.array(F.coalesce(c, F.lit("")))), 2, 1 << 20)
    text = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    return F.sha2(F.concat(F.lit('{"config":'), text(config), F.lit(',"models":'), models, F.lit(',"schema":'), text(schema), F.lit(',"verdict":'), text(verdict), F.lit("}")), 256)


def timestamp(at: Column) -> Column:
    """The stamp of the local, non-qualified authority (at: a timestamp)."""
    return F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("utc_iso"), F.lit(AUTHORITY).alias("authority"), F.lit(False).alias("is_qualified"), F.lit(CLOCK_NOTE).alias("detail"))


def seal(rows: DataFrame, at: Column) -> DataFrame:
    """rows: record_id, clip_id, canonical_sha256, video_root, audio_root (null: no track), config_digest,
    models (JSON), feature_schema, verdict. Adds context_hash, combined_root, timestamp and the ledger's payload.
    The same inputs give the same root at any time."""
    c = rows.withColumn("context_hash", context_hash(F.col("config_digest"), F.col("models"), F.col("feature_schema"), F.col("verdict")))
    c = c.withColumn("combined_root", custody.combined_root(track_root(F.col("video_root")), track_root(F.col("audio_root")), F.col("context_hash"))).withColumn("timestamp", timestamp(at))
    return c.withColumn("payload", F.to_json(F.struct("record_id", "clip_id", "canonical_sha256", "combined_root", "verdict", "timestamp")))


def environment(spark: SparkSession) -> DataFrame:
    """One row: versions that a result depends on; "not installed" for what is missing."""
    import importlib
    import platform

    found = {"python": platform.python_version(), "platform": platform.platform(), "machine": platform.machine(), "spark": spark.version}
    for name in ("numpy", "pandas", "pyarrow", "scipy", "av", "torch"):
        try:
            found[name] = str(getattr(importlib.import_module(name), "__version__", "unknown"))
        except ImportError:
            found[name] = "not installed"
    return spark.createDataFrame([(found,)], "environment map<string,string>")


def device(spark: SparkSession) -> DataFrame:
    """One row: the driver's machine and the tier it would get."""
    import os
    import platform

    from attestra.operators import tier0

    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30 if hasattr(os, "sysconf") else 0.0
    one = spark.createDataFrame([(platform.system(), platform.machine(), os.cpu_count() or 1, float(memory), False)], "system string, machine string, cores int, memory_gb double, gpu boolean")
    return one.withColumn("tier", tier0.tier_of(F.col("memory_gb"), F.col("cores"), F.col("gpu")))


def bundle_descriptor(models: DataFrame) -> DataFrame:
    """models: branch, schema, version, n_train. One row: identity of the bundle as canonical JSON and its digest."""
    entry = F.struct("branch", "n_train", "schema", "version")
    listed = F.to_json(F.array_sort(F.collect_list(entry)))
    return models.agg(listed.alias("bundle")).withColumn("digest", F.sha2("bundle", 256))


#: What a claim may say before release, and the claims that must stay unevaluated.
OPEN_STATES = ["CONDITIONAL", "UNEVALUATED"]


def release_gate(claims: DataFrame, unevaluated: list[str], least: int = 10) -> DataFrame:
    """claims: claim_id, status. One row of checks. Consistency may pass; the release itself never does."""
    checks = claims.agg(
        ((F.count("*") >= least) & F.coalesce(F.bool_and(F.col("status").isin(OPEN_STATES)), F.lit(False))).alias("ledger_schema"),
        *[(F.count_if((F.col("claim_id") == c) & (F.col("status") == "UNEVALUATED")) == 1).alias(f"open_{i}") for i, c in enumerate(unevaluated)],
    )
    every = F.lit(True)
    for c in checks.columns:
        every = every & F.col(c)
    return checks.withColumn("internal_consistency", F.when(every, "PASS").otherwise("FAIL")).withColumn("status", F.lit("NOT_RELEASE_READY"))


def result(rows: DataFrame) -> DataFrame:
    """rows: clip_id, verdict, top_p, vacuity, deferred, caveats (array). Adds a one-line summary; the base caveat comes first."""
    caveats = F.concat(F.array(F.lit("Scores are calibrated on the training corpus only.")), F.coalesce("caveats", F.array().cast("array<string>")))
    line = F.format_string("%s: %s (p=%.3f, vacuity=%.3f)%s", F.col("clip_id").cast("string"), "verdict", "top_p", "vacuity", F.when(F.col("deferred"), " deferred").otherwise(""))
    return rows.withColumn("caveats", caveats).withColumn("summary", line)


def chunk_leaves(df: DataFrame, key: str, content: str, track: str, size: int) -> DataFrame:
    """key, i, leaf: the leaf hash of each chunk of ``size`` bytes of a track, over its kind, place and length as well.
    Null and empty contents have no chunks."""
    body = F.col(content).cast("binary")
    n = F.octet_length(body)
    pieces = df.select(key, body.alias("body_"), n.alias("n_")).where("n_ > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_") - 1) / size).cast("int"))))
    head = F.concat_ws("|", F.lit(track), F.lit(str(size)), F.col("i").cast("string"), F.least(F.lit(size), F.col("n_") - F.col("i") * size).cast("string"))
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), head.cast("binary"), F.expr(f"substring(body_, i * {size} + 1, {size})")), 256)
    return pieces.select(key, F.col("i").cast("long").alias("i"), leaf.alias("leaf"))
