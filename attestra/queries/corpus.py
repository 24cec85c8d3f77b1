"""Corpus construction, sealing and helpers over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators import acquisition, corpus, models, seal, triage
from attestra.operators import audit as A
from attestra.queries import audit as audit_queries
from attestra.queries import fusion as fusion_queries
from attestra.queries.base import query
from attestra.queries.identity import _hash_sql, _hashes
from attestra.session import table


def U(what: str, key: str = "doc_id") -> str:
    """SQL of corpus.draw."""
    return f"CAST('0x' || substr(md5('{what}|' || {key}), 1, 8) AS UBIGINT) / 4294967296.0"


def POOL(pool: list[str], what: str, key: str = "doc_id") -> str:
    """SQL of a pool in the order of its hashes."""
    return f"list_transform(list_sort(list_transform([{', '.join(repr(x) for x in pool)}], lambda x: md5('{what}|' || {key} || '|' || x) || x)), lambda x: substr(x, 33))"


@query("desync_states", f"SELECT doc_id, {U('sync')} < CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN 0.7 ELSE 0 END AS desynced FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", corpus.desynchronised(i % 2 == 1, i % 3 == 0, corpus.draw("doc_id", "sync")).alias("desynced"))


@query("variant_perturbation", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, round(n_chars * CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 1.18::DOUBLE END, 6) AS f0_base,
 round(4.0::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END, 6) AS speech_rate, round(2.0::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END, 6) AS noise_sigma FROM documents""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("variant"), F.col("n_chars").cast("double").alias("f0_base"), F.lit(4.0).alias("speech_rate"), F.lit(2.0).alias("noise_sigma"))
    return corpus.perturb(rows).select("doc_id", "variant", *[F.round(c, 6).alias(c) for c in ("f0_base", "speech_rate", "noise_sigma")])


LEVEL = f"CASE WHEN {U('quality')} < 0.3 THEN 'low' WHEN {U('quality')} < 0.7 THEN 'medium' ELSE 'high' END"


@query("fake_audio_ops", f"""WITH q AS (SELECT doc_id, {LEVEL} AS level, {POOL(corpus.AUDIO_LOW, 'audio')}[1:CASE WHEN {U('audio-n')} < 0.5 THEN 3 ELSE 4 END] AS low, {POOL(corpus.AUDIO_MEDIUM, 'audio')}[1:1] AS med FROM documents)
 SELECT doc_id, level, array_to_string(CASE level WHEN 'low' THEN CASE WHEN list_contains(low, 'mel_griffinlim') THEN low ELSE list_concat(['mel_griffinlim'], low[2:]) END
 WHEN 'medium' THEN list_concat([CASE WHEN {U('audio-base')} < 0.5 THEN 'mel_griffinlim' ELSE 'mel_phase_preserve' END], med) ELSE CASE WHEN {U('audio-high')} < 0.35 THEN ['mel_phase_preserve', 'spectral_oversmooth'] ELSE ['mel_phase_preserve'] END END, ',') AS ops FROM q""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", corpus.quality(corpus.draw("doc_id", "quality")).alias("level"))
    return rows.select("doc_id", "level", F.array_join(corpus.audio_operations(F.col("level"), "doc_id"), ",").alias("ops"))


@query("fake_video_ops", f"""WITH q AS (SELECT doc_id, {LEVEL} AS level, {POOL(corpus.VIDEO_LOW, 'video')}[1:CASE WHEN {U('video-n')} < 0.5 THEN 3 ELSE 4 END] AS low, {POOL(corpus.VIDEO_MEDIUM, 'video')}[1:2] AS med, {POOL(corpus.VIDEO_HIGH, 'video')}[1:1] AS high FROM documents),
 r AS (SELECT doc_id, level, CASE level WHEN 'low' THEN low WHEN 'medium' THEN med ELSE high END AS ops FROM q) SELECT doc_id, level, array_to_string(CASE WHEN {U('video-drop')} < 0.15 THEN list_append(ops, 'frame_dup_drop') ELSE ops END, ',') AS ops FROM r""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", corpus.quality(corpus.draw("doc_id", "quality")).alias("level"))
    return rows.select("doc_id", "level", F.array_join(corpus.video_operations(F.col("level"), "doc_id"), ",").alias("ops"))


SPLITS = "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('|' || doc_id)) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT doc_id, lang, CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.75::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k)"


def splits(spark, d):
    return acquisition.assign_splits(table(spark, d, "documents").select("doc_id", "lang"), "lang", acquisition.hash_key("doc_id"), [("train", 0.60), ("val", 0.15), ("test", 0.25)])


@query("split_filter", f"{SPLITS} SELECT doc_id, lang FROM s WHERE split = 'test'")
def _(spark, d):
    return corpus.in_split(splits(spark, d), "test").select("doc_id", "lang")


@query("feature_cache_join", f"{SPLITS} SELECT e.vec_id AS clip_id, split, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings e JOIN s ON s.doc_id = e.vec_id")
def _(spark, d):
    features = table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("total"))
    return corpus.with_features(splits(spark, d).select(F.col("doc_id").alias("clip_id"), "split"), features).select("clip_id", "split", "label", F.round("total", 5).alias("total"))


@query("usable_files", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1) AND n_chars <= 2000")
def _(spark, d):
    name = F.concat(F.lit("clip"), F.col("doc_id"), F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".webm", ".txt", ".mp4.part")]), (F.col("doc_id") % 4 + 1).cast("int")))
    return table(spark, d, "documents").where(corpus.usable_file(name, F.col("n_chars"), 2000)).select("doc_id")


@query("picture_types", "SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN 'B' ELSE ['NONE', 'I', 'P', 'B', 'S', 'SI', 'SP', 'BI', 'NONE', 'NONE'][CAST(doc_id % 11 + 1 AS INTEGER)] END AS picture FROM documents")
def _(spark, d):
    code = F.col("doc_id") % 11
    return table(spark, d, "documents").select("doc_id", corpus.picture_type(F.when(code == 10, "PictureType.b").otherwise(code.cast("string"))).alias("picture"))


@query("half_even_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, round_even(l_quantity / 8, 2) AS eighth FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.half_even(q / 2).alias("half"), X.half_even(q / 8, 2).alias("eighth"))


@query("utc_stamps", "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') AS utc FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.expr("unix_micros(to_utc_timestamp(cast(ts as timestamp), current_timezone()))")
    return e.select("event_id", X.utc_text(us).alias("utc"))


@query("luma_cells", "SELECT vec_id, round(0.299::DOUBLE * embedding[1] + 0.587::DOUBLE * embedding[2] + 0.114::DOUBLE * embedding[3], 6) AS luma FROM embeddings")
def _(spark, d):
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, d, "embeddings").select("vec_id", F.round(X.luma(*v), 6).alias("luma"))


# Sealing

SEALED = """c AS (SELECT doc_id, sha256(text) AS v, CASE WHEN doc_id % 4 = 0 THEN sha256('no-track') ELSE sha256(lang) END AS a, sha256('{"config":"' || lang || '","models":{"m":1},"schema":"s1","verdict":"' || CASE WHEN doc_id % 2 = 0 THEN 'REAL' ELSE 'UNKNOWN' END || '"}') AS ctx FROM documents WHERE text IS NOT NULL)"""


@query("seal_roots", f"WITH {SEALED} SELECT doc_id, ctx AS context_hash, sha256('custody-root|' || v || '|' || a || '|' || ctx) AS combined_root FROM c")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(
        i, i.cast("string").alias("record_id"), i.alias("clip_id"), F.sha2("text", 256).alias("canonical_sha256"), F.sha2("text", 256).alias("video_root"), F.when(i % 4 != 0, F.sha2("lang", 256)).alias("audio_root"),
        F.col("lang").alias("config_digest"), F.lit('{"m":1}').alias("models"), F.lit("s1").alias("feature_schema"), F.when(i % 2 == 0, "REAL").otherwise("UNKNOWN").alias("verdict"),
    )
    return seal.seal(rows, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("doc_id", "context_hash", "combined_root")


@query("bundle_descriptor", "WITH b AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), j AS (SELECT '[' || string_agg('{\"branch\":\"' || lang || '\",\"n_train\":' || n || ',\"schema\":\"s1\",\"version\":1}', ',' ORDER BY lang) || ']' AS bundle FROM b) SELECT bundle, sha256(bundle) AS digest FROM j")
def _(spark, d):
    m = table(spark, d, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("branch")).agg(F.count("*").alias("n_train")).select("branch", "n_train", F.lit("s1").alias("schema"), F.lit(1).alias("version"))
    return seal.bundle_descriptor(m)


@query("release_gate", """WITH c AS (SELECT 'C' || item_id AS claim_id, CASE WHEN item_id % 3 = 0 THEN 'UNEVALUATED' ELSE 'CONDITIONAL' END AS status FROM benchmark) SELECT count(*) >= 10 AND bool_and(status IN ('CONDITIONAL', 'UNEVALUATED')) AS ledger_schema,
 count(*) FILTER (WHERE claim_id = 'C0' AND status = 'UNEVALUATED') = 1 AS open_0, count(*) FILTER (WHERE claim_id = 'C1' AND status = 'UNEVALUATED') = 1 AS open_1,
 CASE WHEN count(*) >= 10 AND bool_and(status IN ('CONDITIONAL', 'UNEVALUATED')) AND count(*) FILTER (WHERE claim_id = 'C0' AND status = 'UNEVALUATED') = 1 AND count(*) FILTER (WHERE claim_id = 'C1' AND status = 'UNEVALUATED') = 1 THEN 'PASS' ELSE 'FAIL' END AS internal_consistency, 'NOT_RELEASE_READY' AS status FROM c""")
def _(spark, d):
    i = F.col("item_id")
    claims = table(spark, d, "benchmark").select(F.concat(F.lit("C"), i).alias("claim_id"), F.when(i % 3 == 0, "UNEVALUATED").otherwise("CONDITIONAL").alias("status"))
    return seal.release_gate(claims, ["C0", "C1"])


@query("result_summaries", """SELECT doc_id, doc_id || ': ' || CASE WHEN doc_id % 2 = 0 THEN 'REAL' ELSE 'UNKNOWN' END || ' (p=' || printf('%.3f', (doc_id % 8) / 8.0::DOUBLE) || ', vacuity=' || printf('%.3f', (doc_id % 4) / 4.0::DOUBLE) || ')' || CASE WHEN doc_id % 5 = 0 THEN ' deferred' ELSE '' END AS summary, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n_caveats FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("clip_id"), F.when(i % 2 == 0, "REAL").otherwise("UNKNOWN").alias("verdict"), ((i % 8) / F.lit(8.0)).alias("top_p"), ((i % 4) / F.lit(4.0)).alias("vacuity"), (i % 5 == 0).alias("deferred"), F.when(i % 3 == 0, F.array(F.lit("short clip"))).alias("caveats"))
    return seal.result(rows).select(F.col("clip_id").alias("doc_id"), "summary", F.size("caveats").alias("n_caveats"))


# Lookup by sequences, prediction of a branch, audited tuple

GROUPS = f"""WITH {_hash_sql('o', 'CAST(x AS DOUBLE)')}, {_hash_sql('c', 'round(CAST(x AS DOUBLE), 2)')},
 q AS (SELECT vec_id // 4 AS id, list(CAST(u AS UBIGINT) ORDER BY vec_id) AS v, list(CAST(u AS UBIGINT) ORDER BY vec_id DESC)[1:vec_id_n] AS a FROM (SELECT *, CAST((vec_id // 4) % 3 AS INTEGER) AS vec_id_n FROM c) GROUP BY vec_id // 4, vec_id_n),
 r AS (SELECT vec_id // 4 AS other, list(CAST(u AS UBIGINT) ORDER BY vec_id) AS v, list(CAST(u AS UBIGINT) ORDER BY vec_id DESC)[1:2] AS a FROM o GROUP BY vec_id // 4)"""


def DISTANCE(side: str) -> str:
    """SQL of expressions.sequence_distance over pairs p with arrays s (shorter) and l, as id, other, dist."""
    return f"""{side}_p AS (SELECT id, other, CASE WHEN len(q.{side}) <= len(r.{side}) THEN q.{side} ELSE r.{side} END AS s, CASE WHEN len(q.{side}) <= len(r.{side}) THEN r.{side} ELSE q.{side} END AS l FROM q, r),
 {side}_x AS (SELECT id, other, s, l, unnest(range(0, len(s))) AS i FROM {side}_p WHERE len(s) > 0), {side}_y AS (SELECT id, other, len(s) AS n, s[i + 1] AS h, l, CASE WHEN len(s) > 1 THEN CAST(floor(i * (len(l) - 1) / greatest(1, len(s) - 1)) AS BIGINT) ELSE 0 END AS c, greatest(1, len(l) // len(s)) AS w FROM {side}_x),
 {side}_z AS (SELECT id, other, n, list_min(list_transform(l[greatest(0, c - w) + 1:least(len(l), c + w + 1)], lambda q: bit_count(xor(q, h)))) AS m FROM {side}_y), {side}_d AS (SELECT id, other, sum(m) / max(n) / 64.0 AS dist FROM {side}_z GROUP BY id, other)"""


@query("sequence_candidates", f"""{GROUPS}, {DISTANCE('v')}, {DISTANCE('a')}, n AS (SELECT v_d.id, v_d.other, v_d.dist AS vd, coalesce(a_d.dist, 1.0) AS ad FROM v_d LEFT JOIN a_d USING (id, other) WHERE v_d.dist <= 0.10 + 1e-12)
 SELECT * FROM (SELECT id, other, round(vd, 6) AS video_distance, round(ad, 6) AS audio_distance, CAST(row_number() OVER (PARTITION BY id ORDER BY round(vd, 9), other) AS INTEGER) AS rank FROM n) WHERE rank <= 5""")
def _(spark, d):
    """Clips of four hashes, re-encoded to two places, against the registry of originals; a third of the queries have no audio."""

    def clips(digits, name, n):
        h = _hashes(spark, d, digits).select("vec_id", X.pack_bits("b").alias("h"))
        every = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda x: x["h"])
        g = h.groupBy(F.floor(F.col("vec_id") / 4).alias(name)).agg(every.alias("video"))
        return g.select(name, "video", F.slice(F.reverse("video"), 1, n).alias("audio"))

    found = triage.sequence_candidates(clips(2, "id", (F.col("id") % 3).cast("int")), clips(None, "other", 2))
    return found.select("id", "other", F.round("video_distance", 6).alias("video_distance"), F.round("audio_distance", 6).alias("audio_distance"), "rank")


@query("branch_predict", """WITH m AS (SELECT vec_id, vec_id % 7 <> 0 AS ok, CAST(95 + vec_id % 6 AS DOUBLE) AS pct, list_concat(list_transform(embedding[1:15], lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE) * 3))), CASE WHEN vec_id % 2 = 0 THEN [0.5::DOUBLE, 0.25::DOUBLE] ELSE [] END) AS p FROM embeddings),
 s AS (SELECT *, list_avg(p) AS mean, greatest(list_avg(list_transform(p, lambda x: x * x)) - list_avg(p) * list_avg(p), 1e-9) AS v FROM m), e AS (SELECT *, 2 / (least(60, greatest(0, mean * (1 - mean) / v - 1)) + 2) AS vac FROM s)
 SELECT vec_id, round(CASE WHEN ok THEN 1 / (1 + exp(-(1.7 * ln(least(greatest(mean, 1e-6), 1 - 1e-6) / (1 - least(greatest(mean, 1e-6), 1 - 1e-6))) - 0.3))) ELSE 0.5 END, 6) AS p_fake, round(CASE WHEN NOT ok THEN 1 WHEN pct >= 99 THEN least(1, greatest(vac, 0.5 + 0.5 * (pct - 99))) ELSE vac END, 6) AS vacuity, ok AND pct >= 99 AS ood_flag, CASE WHEN NOT ok THEN 'no track' END AS reason_unavailable FROM e""")
def _(spark, d):
    i = F.col("vec_id")
    members = F.transform(F.slice("embedding", 1, 15), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double") * 3)))
    rows = table(spark, d, "embeddings").select("vec_id", members.alias("members"), F.when(i % 2 == 0, F.array(F.lit(0.5), F.lit(0.25))).alias("extra"), (i % 6 + 95).cast("double").alias("pct"), (i % 7 != 0).alias("ok"), F.lit("no track").alias("why"))
    p = models.predict(rows, "members", "extra", "pct", "ok", "why", (1.7, -0.3))
    return p.select("vec_id", F.round("p_fake", 6).alias("p_fake"), F.round("vacuity", 6).alias("vacuity"), "ood_flag", "reason_unavailable")


RESAMPLED = f"""u AS (SELECT b, score, label, CAST('0x' || substr(md5('1337|' || b || '|' || id), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM s, (SELECT unnest(range(1, 1001)) AS b) k), w AS (SELECT b, score, label, {' + '.join(f'CAST(u > {e!r}::DOUBLE AS BIGINT)' for e in A.POISSON)} AS w FROM u),
 g AS (SELECT b, score, sum(w) AS n, sum(CASE WHEN label THEN w ELSE 0 END) AS pos FROM w WHERE w > 0 GROUP BY b, score), rk AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY score) - (n - 1) / 2.0 AS rank FROM g),
 ra AS (SELECT b, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n - pos) AS DOUBLE) AS q, CAST(sum(rank * pos) AS DOUBLE) AS r FROM rk GROUP BY b), ba AS (SELECT (r - p * (p + 1) / 2) / (p * q) AS auc FROM ra WHERE p > 0 AND q > 0),
 ci AS (SELECT count(*) AS replicates, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM ba)"""
POINT = "pr AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s), pa AS (SELECT CAST(count(*) FILTER (WHERE label) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT label) AS DOUBLE) AS q, CAST(sum(rk) FILTER (WHERE label) AS DOUBLE) AS r FROM pr), pt AS (SELECT (r - p * (p + 1) / 2) / (p * q) AS auc FROM pa)"


@query("bootstrap_ci", f"WITH {audit_queries.S}, {RESAMPLED}, {POINT} SELECT replicates, round(low, 6) AS low, round(high, 6) AS high, round(auc, 6) AS auc FROM ci, pt")
def _(spark, d):
    return A.bootstrap_auc(audit_queries.scores(spark, d)).select("replicates", *[F.round(c, 6).alias(c) for c in ("low", "high", "auc")])


@query("bootstrap_ci_grouped")
def _(spark, d):
    """Draws of a generator that SQL doesn't have; held against the interval of bootstrap_ci."""
    return A.bootstrap_auc_grouped(audit_queries.scores(spark, d)).select("replicates", *[F.round(c, 6).alias(c) for c in ("low", "high", "auc")])


@query("audited_tuple", f"""WITH {audit_queries.S}, {RESAMPLED}, {POINT}, th AS (SELECT quantile_cont(CAST(score AS DOUBLE), 0.999) AS t FROM s WHERE NOT label), re AS (SELECT avg(CAST(CAST(score AS DOUBLE) > t AS INTEGER)) AS recall FROM s, th WHERE label),
 eb AS (SELECT greatest(ceil(CAST(score AS DOUBLE) * 10), 1) AS bin, count(*) AS n, avg(CAST(score AS DOUBLE)) AS c, avg(CAST(label AS INTEGER)) AS a FROM s GROUP BY 1), ec AS (SELECT sum(n * abs(a - c)) / sum(n) AS ece FROM eb), ac AS (SELECT count(*) AS n, avg(CAST((score >= 0.5) = label AS INTEGER)) AS accuracy FROM s)
 SELECT 'surface' AS method, 'quality' AS task, n, round(auc, 6) AS auc, round(low, 6) AS low, round(high, 6) AS high, round(auc - 0.6, 6) AS margin, round(recall, 6) AS recall_at_fpr, round(ece, 6) AS ece, round(accuracy, 6) AS accuracy FROM ci, pt, re, ec, ac""")
def _(spark, d):
    t = A.audited_tuple(audit_queries.scores(spark, d), "surface", "quality", 0.6)
    return t.select("method", "task", "n", *[F.round(c, 6).alias(c) for c in ("auc", "low", "high", "margin", "recall_at_fpr", "ece", "accuracy")])


# Provenance, evidence and ablation


@query("parsed_sidecars", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN false END AS claims_ai, CASE WHEN doc_id % 4 < 2 THEN 'present' WHEN doc_id % 4 = 2 THEN 'invalid' ELSE 'absent' END AS manifest_status,
 CASE WHEN doc_id % 4 < 2 THEN 'simulated manifest' WHEN doc_id % 4 = 2 THEN 'sidecar could not be parsed: {claims' ELSE 'no sidecar' END AS detail FROM documents""")
def _(spark, d):
    from attestra.operators import provenance as P

    i = F.col("doc_id")
    clips = table(spark, d, "documents").select("doc_id", F.when(i % 4 == 2, P.INVALID).otherwise(P.ABSENT).alias("fallback_status"))
    content = F.when(i % 4 == 0, '{"claims_ai_generated": true, "_simulated": true}').when(i % 4 == 1, '{"claims_ai_generated": false, "_simulated": true}').otherwise("{claims")
    sidecars = table(spark, d, "documents").where(i % 4 < 3).select("doc_id", content.alias("content"))
    return P.parsed_sidecars(clips, sidecars, "doc_id").select("doc_id", "claims_ai", "manifest_status", "detail")


@query("embedded_manifest", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unavailable' ELSE 'absent' END AS status FROM documents")
def _(spark, d):
    from attestra.operators import provenance as P

    tags = F.create_map(F.when(F.col("doc_id") % 3 == 0, "C2PA.manifest").otherwise("title"), F.lit("x"))
    return table(spark, d, "documents").select("doc_id", P.embedded_manifest(tags)["status"].alias("status"))


@query("detector_runs", """SELECT doc_id, 'length' AS detector, CASE WHEN n_chars IS NULL THEN 'error' WHEN n_chars > 1000 THEN 'detected' ELSE 'not_detected' END AS status FROM documents UNION ALL SELECT doc_id, 'vendor', 'unavailable' FROM documents
 UNION ALL SELECT doc_id, 'odd', CASE WHEN doc_id % 2 = 1 THEN 'error' ELSE 'detected' END FROM documents""")
def _(spark, d):
    from attestra.operators import provenance as P

    def length(batch):
        known = batch["n_chars"].notna()
        return pd.DataFrame({"found": (batch["n_chars"] > 1000).astype(object).where(known, None), "confidence": 1.0})

    def odd(row):
        if row["doc_id"] % 2:
            raise ValueError("odd clip")
        return {"found": True}

    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return P.run_detectors(docs, {"length": length, "odd": odd}, ["length", "vendor", "odd"], "doc_id", ("length",)).select("doc_id", "detector", "status")


@query("report_notes", """SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 3 = 0 THEN ['audio branch produced no findings: no track'] ELSE [] END, CASE WHEN doc_id % 5 = 0 THEN ['visual branch findings are discounted: outside the training distribution (percentile 99)'] ELSE [] END), '; ') AS notes,
 CASE WHEN doc_id % 2 = 0 THEN 'visual hf_ratio manipulated' ELSE '' END AS findings FROM documents""")
def _(spark, d):
    from attestra.operators import evidence as V

    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    audio = docs.select("doc_id", F.lit("audio branch").alias("branch"), (i % 3 != 0).alias("available"), F.lit("no track").alias("reason"), F.lit(False).alias("ood_flag"), F.lit(0.0).alias("ood_score"))
    visual = docs.select("doc_id", F.lit("visual branch").alias("branch"), F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), (i % 5 == 0).alias("ood_flag"), F.lit(99.0).alias("ood_score"))
    found = docs.where(i % 2 == 0).select("doc_id", F.lit("visual").alias("branch"), F.lit(1).alias("rank"), F.lit("hf_ratio").alias("feature"), F.lit("manipulated").alias("direction"))
    r = V.report(audio.unionByName(visual), found, "doc_id")
    return r.select("doc_id", F.array_join("notes", "; ").alias("notes"), F.array_join("findings", "; ").alias("findings"))


NO_AUDIO = fusion_queries.FUSED.replace("doc_id % 17 <> 0 AS aa", "false AS aa")


@query("ablation_without_audio", f"{NO_AUDIO} SELECT doc_id, round(p_video, 6) AS p_video, round(p_audio, 6) AS p_audio, round(joint_vacuity, 6) AS joint_vacuity, verdict FROM f")
def _(spark, d):
    from attestra.operators import fusion as fuse

    f = fuse.fuse(fuse.without_branch(fusion_queries.branches(spark, d), "audio"), fusion_queries.TABLE)
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_video", "p_audio", "joint_vacuity")], "verdict")


@query("c2_baselines")
def _(spark, d):
    """Content-blind baselines of documents (length, place, source) against their quality, by the matched readout."""
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.length(F.coalesce("source", F.lit(""))).alias("source_size")).join(labels, "doc_id")
    return A.baseline_leakage(rows, {"length": ["n_chars"], "place": ["doc_id"], "both": ["n_chars", "source_size"]})


@query("curve_zscores", "WITH s AS (SELECT user_id AS clip, event_id AS t, round(value, 6) AS x FROM events), m AS (SELECT clip, avg(x) AS m, stddev_pop(x) AS sd FROM s GROUP BY clip) SELECT clip, t, round((x - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS z FROM s JOIN m USING (clip)")
def _(spark, d):
    from attestra.operators import sequences

    s = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("t"), F.round("value", 6).alias("x"))
    return sequences.zscore(s, "clip", "x", "z").select("clip", "t", F.round("z", 6).alias("z"))


@query("circular_resultant", "SELECT user_id AS clip, round(CASE WHEN sum(value) = 0 THEN 0 ELSE sqrt(pow(sum(value * cos(event_id % 7)), 2) + pow(sum(value * sin(event_id % 7)), 2)) / sum(value) END, 6) AS resultant FROM events GROUP BY user_id")
def _(spark, d):
    from attestra.operators import sequences

    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), (F.col("event_id") % 7).cast("double").alias("angle"), "value")
    return sequences.resultant(e, "clip", "angle", "value").select("clip", F.round("resultant", 6).alias("resultant"))


@query("safe_values", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0 ELSE round(value, 6) END AS safe FROM events")
def _(spark, d):
    i = F.col("event_id") % 5
    odd = F.when(i == 0, F.lit(float("nan"))).when(i == 1, F.lit(float("inf"))).when(i == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", F.round(X.finite(odd), 6).alias("safe"))


@query("threshold_override", "SELECT doc_id, CASE WHEN doc_id % 10 <= CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 1 END THEN 'early_exit_clean' ELSE 'escalate' END AS action FROM documents")
def _(spark, d):
    """A threshold of its own for every third clip."""
    from attestra.operators import tier0

    i = F.col("doc_id")
    least = F.when(i % 3 == 0, 0.5).otherwise(0.1)
    return table(spark, d, "documents").select("doc_id", tier0.gate((i % 10) / F.lit(10.0), F.lit(0.2), F.lit(True), F.lit(False), F.lit(True), least).alias("action"))


MEAN_SQL = RESAMPLED.split(" g AS (")[0].rstrip().rstrip(",")


@query("bootstrap_callback", f"WITH {audit_queries.S}, {MEAN_SQL}, m AS (SELECT b, sum(w * CAST(score AS DOUBLE)) / sum(w) AS v FROM w WHERE w > 0 GROUP BY b) SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM m")
def _(spark, d):
    """A statistic of the caller's own: the mean score."""
    mean = lambda drawn: drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("value"))
    found = A.bootstrap(audit_queries.scores(spark, d), mean)
    return found.select("replicates", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("split_features", f"{SPLITS} SELECT split, count(*) AS n, round(avg(embedding[1]), 6) AS first FROM embeddings e JOIN s ON s.doc_id = e.vec_id GROUP BY split")
def _(spark, d):
    """Statistics of the feature cache by split."""
    features = table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding")[0].cast("double").alias("x"))
    j = corpus.with_features(splits(spark, d).select(F.col("doc_id").alias("clip_id"), "split"), features)
    return j.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("first"))
