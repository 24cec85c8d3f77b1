"""Acquisition over orders, customers, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import acquisition as Q
from attestra.queries.base import query
from attestra.session import table
from attestra.sources import text as S


@query("protocol_parse", """WITH l AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'garbage line' ELSE '  spk' || c_nationkey || '  utt_' || c_custkey || ' - ' || c_mktsegment || '   ' || CASE WHEN c_acctbal > 0 THEN 'bonafide' ELSE 'spoof' END || ' ' END AS v, c_custkey FROM customer)
 SELECT 'spk' || c.c_nationkey AS speaker, 'utt_' || c.c_custkey AS utt_id, c.c_mktsegment AS attack, CASE WHEN c.c_acctbal > 0 THEN 'bonafide' ELSE 'spoof' END AS label FROM l JOIN customer c USING (c_custkey) WHERE len(regexp_split_to_array(trim(v), '\\s+')) >= 5""")
def _(spark, d):
    label = F.when(F.col("c_acctbal") > 0, "bonafide").otherwise("spoof")
    line = F.when(F.col("c_custkey") % 10 == 0, "garbage line").otherwise(F.concat(F.lit("  spk"), "c_nationkey", F.lit("  utt_"), "c_custkey", F.lit(" - "), "c_mktsegment", F.lit("   "), label, F.lit(" ")))
    return S.parse_protocol(table(spark, d, "customer").select(line.alias("value")))


@query("stratified_pick", "SELECT c_custkey, c_mktsegment, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('|' || c_custkey)) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 33")
def _(spark, d):
    return Q.stratified_pick(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", Q.hash_key("c_custkey"), 33)


@query("quota_pick", "SELECT p_partkey, p_brand, CAST(place AS INTEGER) AS place FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('|' || p_partkey)) AS place FROM part WHERE p_size <= 40) WHERE place <= 7")
def _(spark, d):
    return Q.quota(table(spark, d, "part").where("p_size <= 40").select("p_partkey", "p_brand"), "p_brand", Q.hash_key("p_partkey"), 7)


@query("match_first_select", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 0 ELSE 1 END AS priority FROM orders")
def _(spark, d):
    picked = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return Q.match_first(table(spark, d, "orders").select("o_orderkey", "o_custkey"), picked, "o_custkey").select("o_orderkey", "o_custkey", "priority")


@query("checkpoint_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return Q.remaining(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("budget_running_total", "SELECT user_id, event_id, round(sum(value) OVER w, 4) AS total, round(sum(value) OVER w, 4) > 1000 AS over_budget FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    b = Q.budget(table(spark, d, "events").select("user_id", "event_id", "value"), "event_id", "value", 1000, "user_id")
    return b.select("user_id", "event_id", F.round("total", 4).alias("total"), (F.round("total", 4) > 1000).alias("over_budget"))


@query("transfer_stats", "SELECT o_orderstatus, count(*) AS requests, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("requests"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("split_assignment", "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('|' || doc_id)) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.75::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k")
def _(spark, d):
    return Q.assign_splits(table(spark, d, "documents").select("doc_id", "lang"), "lang", Q.hash_key("doc_id"), [("train", 0.60), ("val", 0.15), ("test", 0.25)])


@query("provenance_scenarios", "WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('|' || doc_id), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.6 THEN 'none' WHEN u < 0.72 THEN 'consistent_real' WHEN u < 0.84 THEN 'consistent_ai' WHEN u < 0.92 THEN 'clash_manifest' ELSE 'clash_watermark' END AS scenario FROM u")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.scenario(Q.unit(Q.hash_key("doc_id"))).alias("scenario"))


@query("corpus_plan", """WITH r AS (SELECT c, label, doc_id, 'base_' || label || '_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS clip_id FROM documents, (VALUES (0, 'RR'), (1, 'FR'), (2, 'RF'), (3, 'FF')) t(c, label)),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('|' || clip_id)) AS p, count(*) OVER (PARTITION BY label) AS n FROM r)
 SELECT clip_id, label, CAST(7 * 1000003 + doc_id * 4 + c AS BIGINT) AS seed, CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.75::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def _(spark, d):
    return Q.plan_clips(table(spark, d, "documents"), "doc_id", 7)


@query("path_labels", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'FakeVideo-RealAudio' ELSE 'RealVideo-FakeAudio' END AS condition, 'id' || page_id AS subject, CASE WHEN page_id % 2 = 0 THEN 'fake' ELSE 'real' END AS label_video, CASE WHEN page_id % 2 = 0 THEN 'real' ELSE 'fake' END AS label_audio FROM pages")
def _(spark, d):
    path = F.concat(F.lit("root/"), F.when(F.col("page_id") % 2 == 0, "FakeVideo-RealAudio").otherwise("RealVideo-FakeAudio"), F.lit("/Group/id"), "page_id", F.lit("/0001.mp4"))
    return table(spark, d, "pages").select("page_id", S.path_labels(path).alias("l")).select("page_id", "l.condition", "l.subject", "l.label_video", "l.label_audio")


@query("probe_projection", """SELECT page_id, 'matroska' AS container, CASE WHEN page_id % 3 <> 0 THEN 3.0::DOUBLE END AS duration_s, CAST(page_id AS INTEGER) AS width, round(CASE WHEN page_id % 5 = 0 THEN NULL ELSE 30000 / 1001.0 END, 6)::DOUBLE AS avg_frame_rate, page_id % 2 = 0 AS has_audio FROM pages""")
def _(spark, d):
    i = F.col("page_id")
    video = F.concat(F.lit('{"codec_type":"video","width":"'), i, F.lit('","avg_frame_rate":"'), F.when(i % 5 == 0, "0/0").otherwise("30000/1001"), F.lit('"}'))
    audio = F.when(i % 2 == 0, ',{"codec_type":"audio","sample_rate":"16000"}').otherwise("")
    probe = F.concat(F.lit('{"format":{"format_name":"matroska","duration":"'), F.when(i % 3 == 0, "N/A").otherwise("3.0"), F.lit('"},"streams":['), video, audio, F.lit("]}"))
    p = table(spark, d, "pages").select("page_id", *S.probe_summary(probe))
    return p.select("page_id", "container", "duration_s", "width", "avg_frame_rate", "has_audio")


@query("gated_sources", """SELECT source, count(*) AS members, CASE WHEN max(toxic) = 1 THEN 'skip' ELSE 'fetch' END AS status, CASE WHEN max(toxic) = 1 THEN 'needs a signed agreement' END AS reason
 FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""")
def _(spark, d):
    """Sources with toxic members are behind an agreement."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    gates = toxic.select("source", F.lit("needs a signed agreement").alias("reason")).distinct()
    return Q.gate(docs.groupBy("source").agg(F.count("*").alias("members")), gates, "source").select("source", "members", "status", "reason")


@query("manifest_ops_json", "SELECT doc_id, 2 AS n_ops, 'denoise' AS first_op FROM documents")
def _(spark, d):
    ops = F.to_json(F.array(F.lit("denoise"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", F.size(S.json_list(ops)).alias("n_ops"), S.json_list(ops)[0].alias("first_op"))
