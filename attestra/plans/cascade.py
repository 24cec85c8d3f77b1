"""The cascade over clips as one plan: triage, gate, fusion; exits are filtered and united.

Each stage is a DataFrame transform. A stage's heavy work stands behind a filter, not inside
a CASE (which would run it for every row), and its result is united with the early exits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import fusion, tier0, triage

RESULT = ["seq", "route", "verdict", "top", "margin"]


def cascade(clips: DataFrame, registry: DataFrame, branches: DataFrame, table: list[float], schema: str, digest: str, threshold: float = 0.06) -> DataFrame:
    """clips: seq, sha, tier0_p, tier0_vacuity, forced, has_motion. registry: sha, feature_schema,
    config_digest, verdict. branches: seq, video, audio, sync.

    Fresh exact hits take the registry's verdict, clean clips leave at tier 0, the rest is fused."""
    known = registry.select("sha", F.col("verdict").alias("known_verdict"))
    looked = triage.stale_triage(clips, registry, schema, digest).join(known, "sha", "left")
    hits = looked.where("short_circuit").select("seq", F.lit("short_circuit").alias("route"), fusion.cached(F.col("known_verdict")).alias("verdict"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("margin"))
    fresh = looked.where("NOT short_circuit").withColumn("gate", tier0.gate(F.col("tier0_p"), F.col("tier0_vacuity"), F.lit(True), F.col("forced"), F.col("has_motion"), threshold))
    early = fusion.early_exit(fresh.where("gate = 'early_exit_clean'"), "tier0_p").withColumn("route", F.lit("early_exit")).select(*RESULT)
    full = fusion.fuse(fresh.where("gate <> 'early_exit_clean'").select("seq").join(branches, "seq"), table).withColumn("route", F.lit("full")).select(*RESULT)
    return hits.unionByName(early).unionByName(full)
