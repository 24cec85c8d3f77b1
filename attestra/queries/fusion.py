"""Fusion over documents and labels: scores from characters stand for branch predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import fusion as U
from attestra.queries.base import query
from attestra.session import table

TABLE = [0.02, 0.76, 0.64, 0.58]

BASE = """b AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0 AS pv, (doc_id * 53 % 103) / 102.0 AS pa, (n_chars % 97) / 96.0 AS ps, (doc_id % 11) / 20.0 AS vac,
  doc_id % 13 <> 0 AS va, doc_id % 17 <> 0 AS aa, doc_id % 19 = 0 AS ood FROM documents),
 n AS (SELECT doc_id, va, aa, ood, CASE WHEN va THEN CAST(pv AS DOUBLE) ELSE 0.5 END AS pv, CASE WHEN va THEN CAST(vac AS DOUBLE) ELSE 1.0 END AS vv,
  CASE WHEN aa THEN CAST(pa AS DOUBLE) ELSE 0.5 END AS pa, CASE WHEN aa THEN CAST(vac AS DOUBLE) ELSE 1.0 END AS av, CAST(ps AS DOUBLE) AS ps, CAST(vac AS DOUBLE) AS sv FROM b),"""


def _fused(pen: str = "3.0", decide: str = "0.55", avac: str = "av") -> str:
    t = lambda p, v: f"greatest(1e-6, least(1 - 1e-6, 0.5 + ({p} - 0.5) / (1.0 + {pen} * {v})))"
    return f""" t AS (SELECT *, {t("pv", "vv")} AS tv, {t("pa", avac)} AS ta, {t("ps", "sv")} AS ts, ln(greatest(1e-6, least(1 - 1e-6, pv)) / (1 - greatest(1e-6, least(1 - 1e-6, pv)))) AS lv, ln(greatest(1e-6, least(1 - 1e-6, pa)) / (1 - greatest(1e-6, least(1 - 1e-6, pa)))) AS la FROM n),
 w AS (SELECT *, (1 - tv) * (1 - ta) * (ts * 0.02 + (1 - ts) * 0.98) AS w0, tv * (1 - ta) * (ts * 0.76 + (1 - ts) * 0.24) AS w1, (1 - tv) * ta * (ts * 0.64 + (1 - ts) * 0.36) AS w2, tv * ta * (ts * 0.58 + (1 - ts) * 0.42) AS w3 FROM t),
 p AS (SELECT *, w0 / (w0 + w1 + w2 + w3) AS p0, w1 / (w0 + w1 + w2 + w3) AS p1, w2 / (w0 + w1 + w2 + w3) AS p2, w3 / (w0 + w1 + w2 + w3) AS p3 FROM w),
 m AS (SELECT *, p1 + p3 AS p_video, p2 + p3 AS p_audio, greatest(p0, p1, p2, p3) AS top, (vv + {avac} + sv) / 3 AS joint_vacuity, list_sort([p0, p1, p2, p3])[3] AS second FROM p),
 c AS (SELECT *, va AND abs(lv) >= 1.6 AND vv <= 0.30 AND (lv > 0) <> (p_video > 0.5) AS video_conflict, aa AND abs(la) >= 1.6 AND {avac} <= 0.30 AND (la > 0) <> (p_audio > 0.5) AS audio_conflict FROM m),
 x AS (SELECT *, CASE WHEN video_conflict OR NOT va THEN 'UNKNOWN' WHEN p_video >= 0.65 THEN 'FAKE' WHEN p_video <= 0.35 THEN 'REAL' ELSE 'UNKNOWN' END AS video_verdict,
   CASE WHEN audio_conflict OR NOT aa THEN 'UNKNOWN' WHEN p_audio >= 0.65 THEN 'FAKE' WHEN p_audio <= 0.35 THEN 'REAL' ELSE 'UNKNOWN' END AS audio_verdict FROM c),
 f AS (SELECT *, CASE WHEN video_verdict = 'UNKNOWN' OR audio_verdict = 'UNKNOWN' OR top < {decide} THEN 'UNKNOWN' WHEN p0 = top THEN 'REAL' WHEN p1 = top THEN 'VIDEO_FAKE' WHEN p2 = top THEN 'AUDIO_FAKE' ELSE 'BOTH_FAKE' END AS verdict FROM x)"""


FUSED = f"WITH {BASE}{_fused()}"


def branches(spark, d):
    i, vac = F.col("doc_id"), (F.col("doc_id") % 11) / F.lit(20.0)
    return table(spark, d, "documents").select(
        "doc_id",
        U.branch((i * 37 % 101) / F.lit(100.0), vac, i % 13 != 0, i % 19 == 0).alias("video"),
        U.branch((i * 53 % 103) / F.lit(102.0), vac, i % 17 != 0).alias("audio"),
        U.branch((F.col("n_chars") % 97) / F.lit(96.0), vac).alias("sync"),
    )


def fused(spark, d, **kw):
    return U.fuse(branches(spark, d), TABLE, **kw)


@query("coupling_table", """WITH l AS (SELECT quality = 0 AS v, toxic = 1 AS a, n_chars % 3 = 0 AS ds FROM labels JOIN documents USING (doc_id)), g AS (SELECT CASE WHEN v AND a THEN 'FF' WHEN v THEN 'FR' WHEN a THEN 'RF' ELSE 'RR' END AS cell, count(*) AS n, count(*) FILTER (WHERE ds) AS k FROM l GROUP BY 1)
 SELECT c.cell, coalesce(n, 0) AS n, coalesce(k, 0) AS k, round((coalesce(k, 0) + 2) / (coalesce(n, 0) + 4.0), 6) AS p_desync FROM (VALUES ('RR'), ('FR'), ('RF'), ('FF')) c(cell) LEFT JOIN g USING (cell)""")
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 0).alias("v"), (F.col("toxic") == 1).alias("a"), (F.col("n_chars") % 3 == 0).alias("ds"))
    return U.coupling(rows, "v", "a", "ds").select("cell", "n", "k", F.round("p_desync", 6).alias("p_desync"))


@query("posterior_cells", f"{FUSED} SELECT doc_id, round(p0, 6) AS rr, round(p1, 6) AS fr, round(p2, 6) AS rf, round(p3, 6) AS ff FROM f")
def _(spark, d):
    return fused(spark, d).select("doc_id", *[F.round(F.col("post")[i], 6).alias(c.lower()) for i, c in enumerate(U.CELLS)])


@query("marginals", f"{FUSED} SELECT doc_id, round(p_video, 6) AS p_video, round(p_audio, 6) AS p_audio, round(top, 6) AS top, round(top - second, 6) AS margin, round(joint_vacuity, 6) AS joint_vacuity FROM f")
def _(spark, d):
    return fused(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_video", "p_audio", "top", "margin", "joint_vacuity")])


@query("five_way_verdict", f"{FUSED} SELECT doc_id, video_verdict, audio_verdict, verdict, round(top, 6) AS top FROM f")
def _(spark, d):
    return fused(spark, d).select("doc_id", "video_verdict", "audio_verdict", "verdict", F.round("top", 6).alias("top"))


FLAGS = """array_to_string(list_sort(list_filter([CASE WHEN video_conflict THEN 'video_conflict' END, CASE WHEN audio_conflict THEN 'audio_conflict' END, CASE WHEN NOT va THEN 'video_unavailable' END,
  CASE WHEN va AND ood THEN 'video_ood' END, CASE WHEN NOT aa THEN 'audio_unavailable' END], lambda q: q IS NOT NULL)), ',')"""


@query("conflict_flags", f"{FUSED} SELECT doc_id, {FLAGS} AS flags FROM f")
def _(spark, d):
    return fused(spark, d).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("missing_modality", f"{FUSED} SELECT va, aa, video_verdict, audio_verdict, count(*) AS n FROM f WHERE NOT va OR NOT aa GROUP BY ALL")
def _(spark, d):
    f = fused(spark, d).select(F.col("video.available").alias("va"), F.col("audio.available").alias("aa"), "video_verdict", "audio_verdict")
    return f.where("NOT va OR NOT aa").groupBy("va", "aa", "video_verdict", "audio_verdict").agg(F.count("*").alias("n"))


GRID = [("full", {}, {}), ("no_uncertainty", {"penalty": 0.0}, {"pen": "0.0"}), ("margin_70", {"decide": 0.7}, {"decide": "0.7"})]


@query("ablation_grid", " UNION ALL ".join(f"SELECT * FROM (WITH {BASE}{_fused(**s)} SELECT '{n}' AS variant, verdict, count(*) AS n FROM f GROUP BY verdict)" for n, _, s in GRID))
def _(spark, d):
    out = None
    for name, kw, _ in GRID:
        one = fused(spark, d, **kw).groupBy("verdict").agg(F.count("*").alias("n")).select(F.lit(name).alias("variant"), "verdict", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("tier2_trigger", f"{FUSED} SELECT doc_id, top < 0.55 OR joint_vacuity > 0.25 OR doc_id % 23 = 0 OR video_conflict OR audio_conflict AS tier2 FROM f")
def _(spark, d):
    return fused(spark, d).select("doc_id", U.tier2_trigger(F.col("doc_id") % 23 == 0).alias("tier2"))


@query("edge_defer", """SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'deferred' WHEN n_chars < 200 THEN 'early_exit' ELSE 'full' END AS route,
  CASE WHEN n_chars > 2000 THEN 0.25 WHEN n_chars < 200 THEN round(1 - n_chars / 10000.0, 6) END AS top,
  CASE WHEN n_chars > 2000 THEN 0.0 WHEN n_chars < 200 THEN round(1 - 4 * (n_chars / 10000.0) / 3, 6) END AS margin FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") / F.lit(10000.0)).alias("p"))
    keep = ["doc_id", "route", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin")]
    late = U.deferred(docs.where("n_chars > 2000")).withColumn("route", F.lit("deferred")).select(*keep)
    early = U.early_exit(docs.where("n_chars < 200"), "p").withColumn("route", F.lit("early_exit")).select(*keep)
    full = docs.where("n_chars BETWEEN 200 AND 2000").select("doc_id", F.lit("full").alias("route"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("margin"))
    return late.unionByName(early).unionByName(full)


@query("cached_verdicts", "SELECT event_type, CASE WHEN event_type = 'view' THEN 'REAL' ELSE 'UNKNOWN' END AS verdict, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    word = F.when(F.col("event_type") == "view", "REAL").otherwise(F.upper("event_type"))
    return table(spark, d, "events").groupBy("event_type", U.cached(word).alias("verdict")).agg(F.count("*").alias("n"))


CASCADE = f"""{FUSED}, r AS (SELECT sha256(text) AS sha, CASE WHEN min(doc_id) % 5 = 0 THEN 'v1' ELSE 'v2' END AS fs, min(doc_id) AS clip FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
 q AS (SELECT d.doc_id AS seq, n_chars, r.clip, coalesce(r.fs = 'v2', false) AS hit FROM documents d LEFT JOIN r ON sha256(d.text) = r.sha),
 g AS (SELECT *, (n_chars % 100) / 100.0 AS p, NOT hit AND n_chars > 0 AND seq % 5 <> 0 AND (n_chars % 100) / 100.0 <= 0.2 AND (seq % 10) / 10.0 <= 0.5 AS clean FROM q)
 SELECT seq, CASE WHEN hit THEN 'short_circuit' WHEN clean THEN 'early_exit' ELSE 'full' END AS route, CASE WHEN hit THEN CASE WHEN clip % 3 = 0 THEN 'REAL' ELSE 'UNKNOWN' END WHEN clean THEN 'REAL' ELSE verdict END AS verdict,
 CASE WHEN hit THEN NULL WHEN clean THEN round(1 - p, 6)::DOUBLE ELSE round(top, 6) END AS top FROM g JOIN f ON f.doc_id = g.seq"""


@query("cascade_verdicts", CASCADE)
def _(spark, d):
    from attestra.plans.cascade import cascade

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("sha"), "n_chars")
    first = docs.where("seq % 2 = 0").groupBy("sha").agg(F.min("seq").alias("clip"))
    registry = first.select("sha", F.when(F.col("clip") % 5 == 0, "v1").otherwise("v2").alias("feature_schema"), F.lit("c").alias("config_digest"), F.when(F.col("clip") % 3 == 0, "REAL").otherwise("odd").alias("verdict"))
    clips = docs.select("seq", "sha", ((F.col("n_chars") % 100) / F.lit(100.0)).alias("tier0_p"), ((F.col("seq") % 10) / F.lit(10.0)).alias("tier0_vacuity"), (F.col("seq") % 5 == 0).alias("forced"), (F.col("n_chars") > 0).alias("has_motion"))
    out = cascade(clips, registry, branches(spark, d).withColumnRenamed("doc_id", "seq"), TABLE, "v2", "c", 0.2)
    return out.select("seq", "route", "verdict", F.round("top", 6).alias("top"))
