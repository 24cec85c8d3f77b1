"""Provenance over events: props k gives the claim, value the watermark signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import boxes
from attestra.operators import provenance as P
from attestra.queries.base import query
from attestra.session import table

#: k % 3: null, true, false; k % 7 = 0: invalid; every 4th event has no manifest, every 5th no watermark.
BASE = """k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
 j AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CASE k % 3 WHEN 1 THEN true WHEN 2 THEN false END END AS claims_ai,
  CASE WHEN event_id % 4 = 0 THEN 'absent' WHEN k % 7 = 0 THEN 'invalid' ELSE 'present' END AS manifest_status,
  CASE WHEN event_id % 5 = 0 THEN 'unavailable' WHEN value > 50 THEN 'detected' ELSE 'not_detected' END AS watermark_status FROM k),
 c AS (SELECT *, coalesce((NOT claims_ai AND watermark_status = 'detected') OR (claims_ai AND watermark_status = 'not_detected'), false) AS clash FROM j)"""


def _joined(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    claims = F.when(F.col("k") % 3 == 1, True).when(F.col("k") % 3 == 2, False)
    manifests = e.where("event_id % 4 <> 0").select("event_id", claims.alias("claims_ai"), (F.col("k") % 7 != 0).alias("valid"))
    marks = e.where("event_id % 5 <> 0").select("event_id", (F.col("value") > 50).alias("found"))
    j = P.with_sidecars(e.select("event_id"), manifests, marks, "event_id")
    return j.withColumn("clash", P.integrity_clash(F.col("claims_ai"), F.col("watermark_status")))


@query("sidecar_left_join", f"WITH {BASE} SELECT event_id, CAST(claims_ai AS VARCHAR) AS claims_ai, manifest_status, watermark_status FROM j")
def _(spark, d):
    return _joined(spark, d).select("event_id", F.col("claims_ai").cast("string").alias("claims_ai"), "manifest_status", "watermark_status")


@query("integrity_clash", f"WITH {BASE} SELECT clash, CAST(claims_ai AS VARCHAR) AS claims_ai, watermark_status, count(*) AS n FROM c GROUP BY ALL")
def _(spark, d):
    return _joined(spark, d).groupBy("clash", F.col("claims_ai").cast("string").alias("claims_ai"), "watermark_status").agg(F.count("*").alias("n"))


@query("escalation_reasons", f"""WITH {BASE} SELECT event_id, concat_ws('; ', CASE WHEN clash THEN 'manifest and watermark contradict' END, CASE WHEN manifest_status = 'invalid' THEN 'manifest invalid' END,
  CASE WHEN claims_ai THEN 'manifest claims AI generation' END, CASE WHEN watermark_status = 'detected' THEN 'watermark detected' END) AS reasons FROM c""")
def _(spark, d):
    r = P.escalation_reasons(F.col("clash"), F.col("manifest_status"), F.col("claims_ai"), F.col("watermark_status"))
    return _joined(spark, d).select("event_id", r.alias("reasons"))


@query("provenance_notes", f"""WITH {BASE} SELECT manifest_status, watermark_status, CASE WHEN manifest_status = 'absent' AND watermark_status = 'unavailable' THEN 'no provenance: neither for nor against'
  WHEN watermark_status <> 'unavailable' THEN 'watermark evidence is simulated' ELSE '' END AS note, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, d):
    note = F.when((F.col("manifest_status") == P.ABSENT) & (F.col("watermark_status") == P.UNAVAILABLE), "no provenance: neither for nor against").when(F.col("watermark_status") != P.UNAVAILABLE, "watermark evidence is simulated").otherwise("")
    return _joined(spark, d).groupBy("manifest_status", "watermark_status", note.alias("note")).agg(F.count("*").alias("n"))


@query("ai_claim_extract", """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
 SELECT event_id, CASE WHEN k % 4 = 0 THEN 'true' WHEN k % 4 = 1 THEN 'false' WHEN k % 4 = 2 AND event_type = 'click' THEN 'true' END AS claims_ai FROM k""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    kind = F.when(F.col("k") % 4 == 0, "http://cv/trainedAlgorithmicMedia").when(F.col("k") % 4 == 1, "http://cv/digitalCapture").otherwise("http://cv/other")
    second = F.when(F.col("event_type") == "click", "http://cv/compositeWithTrainedAlgorithmicMedia").otherwise("http://cv/none")
    act = lambda a, t: F.struct(F.lit(a).alias("action"), t.alias("digitalSourceType"))
    actions = F.array(act("created", kind), act("edited", F.when(F.col("k") % 4 == 2, second).otherwise(F.lit("x"))))
    return e.select("event_id", P.ai_claim(actions).cast("string").alias("claims_ai"))


@query("detector_registry_status", """WITH r AS (SELECT * FROM (VALUES ('sidecar_simulated', true, CAST(NULL AS VARCHAR)), ('vendor_a', false, 'library missing')) t(detector, available, reason)),
 q AS (SELECT DISTINCT event_type, unnest(['sidecar_simulated', 'vendor_a', 'detector_' || event_type]) AS detector FROM events)
 SELECT event_type, q.detector, CASE WHEN r.detector IS NULL OR NOT available THEN 'unavailable' ELSE 'ready' END AS status, CASE WHEN r.detector IS NULL THEN 'not registered' ELSE reason END AS reason FROM q LEFT JOIN r ON q.detector = r.detector""")
def _(spark, d):
    registry = spark.sql("SELECT * FROM VALUES ('sidecar_simulated', true, CAST(NULL AS STRING)), ('vendor_a', false, 'library missing') AS t(detector, available, reason)")
    asked = table(spark, d, "events").select("event_type").distinct().withColumn("detectors", F.array(F.lit("sidecar_simulated"), F.lit("vendor_a"), F.concat(F.lit("detector_"), F.col("event_type"))))
    return P.detector_status(asked, registry).select("event_type", "detector", "status", "reason")


@query("metadata_keys", """SELECT page_id, regexp_matches(lower(html), '<meta') AS has_meta, (page_id % 2 = 0) AS has_manifest FROM pages""")
def _(spark, d):
    tags = F.create_map(F.lit("Title"), F.col("url"), F.when(F.col("page_id") % 2 == 0, "org.C2PA.manifest").otherwise("comment"), F.lit("x"))
    return table(spark, d, "pages").select("page_id", F.lower("html").contains("<meta").alias("has_meta"), (F.size(P.observed_metadata(tags)) > 0).alias("has_manifest"))


# Embedded manifests


def _box(kind, *parts):
    body = F.concat(*parts)
    return F.concat(F.unhex(F.lpad(F.hex((F.length(body) + 8).cast("long")), 8, "0")), F.lit(kind).cast("binary"), body)


def _holder(label, *parts):
    about = F.concat(F.unhex(F.lit("00" * 16 + "03")), F.lit(label).cast("binary") if isinstance(label, str) else label.cast("binary"), F.unhex(F.lit("00")))
    return _box("jumb", _box("jumd", about), *parts)


@query("manifest_contents", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'absent' WHEN page_id % 5 = 0 THEN 'invalid' ELSE 'present' END AS status, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN NULL ELSE 1 + page_id % 2 END AS manifests,
 CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN NULL ELSE url END AS title, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN NULL ELSE 2 END AS n_assertions,
 CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN NULL WHEN page_id % 4 = 0 THEN true WHEN page_id % 4 = 1 THEN false END AS claims_ai FROM pages""")
def _(spark, d):
    """Boxes made of the pages: every other one has an older manifest as well, a fifth is cut off, a seventh holds none."""
    i = F.col("page_id")
    json_ = lambda *c: _box("json", F.to_json(F.struct(*c)).cast("binary"))
    source = F.when(i % 4 == 0, "http://cv/trainedAlgorithmicMedia").when(i % 4 == 1, "http://cv/digitalCapture").otherwise("http://cv/other")

    def manifest(name, title, kind):
        actions = _holder(boxes.ACTIONS, json_(F.array(F.struct(F.lit("created").alias("action"), kind.alias("digitalSourceType"))).alias("actions")))
        claim = _holder(boxes.CLAIM, json_(F.lit("made here").alias("claim_generator"), title.alias("title")))
        return _holder(name, _holder(boxes.ASSERTIONS, _holder("thumbnail", _box("bidb", F.col("html").cast("binary"))), actions), claim)

    older = F.when(i % 2 == 1, manifest("older", F.lit("an older title"), F.lit("http://cv/algorithmicMedia"))).otherwise(F.lit(b""))
    store = _holder(boxes.STORE, older, manifest("active", F.col("url"), source))
    content = F.when(i % 7 == 0, F.lit(b"")).when(i % 5 == 0, F.expr("substring(store, 1, length(store) - 7)")).otherwise(F.col("store"))
    pages = table(spark, d, "pages").withColumn("store", store).select("page_id", content.alias("content"))
    return boxes.read_manifests(pages, "page_id", "content").select("page_id", "status", "manifests", "title", F.col("n_assertions").cast("int").alias("n_assertions"), "claims_ai")
