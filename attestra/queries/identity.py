"""Identity and triage over documents (as clips) and embeddings (as perceptual hashes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators import triage
from attestra.operators.quantiles import median
from attestra.operators.registry import StoredRegistry
from attestra.queries.base import query
from attestra.session import cut, scratch, table
from attestra.streaming import registry_stream


def _clips(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("sha"), "lang", "source", "n_chars")


@query("sha256_identity", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("sha256_distinct_uniformity", "SELECT lang, count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct FROM documents GROUP BY lang")
def _(spark, d):
    return _clips(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("sha").alias("n_distinct"))


@query("exact_triage", """SELECT doc_id AS seq, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_seq,
  CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'miss' ELSE 'exact_hit' END AS action FROM documents""")
def _(spark, d):
    return triage.exact_triage(_clips(spark, d)).select("seq", "sha", "first_seq", "action")


REGISTRY_SQL = """registry AS (SELECT sha256(text) AS sha, CASE WHEN min(doc_id) % 5 = 0 THEN 'v1' ELSE 'v2' END AS feature_schema,
  arg_min(lang, doc_id) AS config_digest, min(doc_id) AS clip FROM documents WHERE doc_id % 2 = 0 GROUP BY sha256(text))"""


def _registry(spark, d):
    first = _clips(spark, d).where("seq % 2 = 0").groupBy("sha").agg(F.min("seq").alias("clip"), F.min_by("lang", "seq").alias("config_digest"))
    return first.withColumn("feature_schema", F.when(F.col("clip") % 5 == 0, "v1").otherwise("v2"))


@query("stale_cache_triage", f"""WITH {REGISTRY_SQL} SELECT d.doc_id AS seq,
  CASE WHEN r.sha IS NULL THEN 'miss' WHEN r.feature_schema <> 'v2' OR r.config_digest <> 'en' THEN 'stale' ELSE 'exact_hit' END AS action,
  (r.sha IS NOT NULL AND r.feature_schema = 'v2' AND r.config_digest = 'en') AS short_circuit
  FROM documents d LEFT JOIN registry r ON sha256(d.text) = r.sha""")
def _(spark, d):
    return triage.stale_triage(_clips(spark, d), _registry(spark, d), "v2", "en").select("seq", "action", "short_circuit")


@query("triage_summary", f"""WITH {REGISTRY_SQL}, t AS (SELECT
  CASE WHEN r.sha IS NULL THEN 'miss' WHEN r.feature_schema <> 'v2' OR r.config_digest <> 'en' THEN 'stale' ELSE 'exact_hit' END AS action, n_chars
  FROM documents d LEFT JOIN registry r ON sha256(d.text) = r.sha)
  SELECT action, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars FROM t GROUP BY action""")
def _(spark, d):
    t = triage.stale_triage(_clips(spark, d), _registry(spark, d), "v2", "en")
    return t.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).join(median(t, "n_chars", ["action"], "median_chars"), "action")


@query("registry_count", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def _(spark, d):
    return triage.upsert_latest(_clips(spark, d), "sha", "seq").agg(F.count("*").alias("n"))


@query("registry_upsert_latest", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    return triage.upsert_latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("registry_stored_upserts", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    """The latest event of each user, by upserts of thirds of the table into a stored registry, one of them twice."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    store = StoredRegistry(spark, scratch(spark, "registry"), e.schema, "user_id", "event_id", 16)
    for third in (2, 0, 2, 1):
        store.upsert(e.where(F.col("event_id") % 3 == third))
    return store.read()


@query("streaming_triage", """SELECT doc_id AS seq, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_seq,
  CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'miss' ELSE 'exact_hit' END AS action FROM documents""")
def _(spark, d):
    """Documents arrive four times, in order of doc_id; the stream ends after each and goes on from its checkpoint.
    Texts are hashed once, where they are read; an arrival is written by many tasks and taken as one batch."""
    clips = cut(_clips(spark, d).select("sha", "seq"), "clips")
    cuts = clips.stat.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01)
    home = scratch(spark, "triage-stream")
    part = sum(((F.col("seq") > c).cast("int") for c in cuts), F.lit(0))
    for i in range(4):
        clips.where(part == i).write.mode("append").parquet(f"{home}/in")
        registry_stream.run_available(registry_stream.triage_stream(registry_stream.stream_of(spark, f"{home}/in", "sha string, seq long", None)), f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema(registry_stream.OUT).parquet(f"{home}/out").select("seq", "sha", "first_seq", "action")


def _hashes(spark, d, digits=None):
    v = F.transform("embedding", lambda x: x.cast("double") if digits is None else F.round(x.cast("double"), digits))
    return table(spark, d, "embeddings").select("vec_id", "label", v.alias("v")).select("vec_id", "label", X.threshold_bits("v").alias("b"))


def _hash_sql(name: str, value: str) -> str:
    return f"""{name}_v AS (SELECT vec_id, label, list_transform(embedding, lambda x: {value}) AS v FROM embeddings),
  {name}_b AS (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN x > list_sort(v[2:])[(len(v) - 1 + 1) // 2] THEN 1 ELSE 0 END) AS b FROM {name}_v),
  {name} AS (SELECT vec_id, label, b, CAST(list_sum(list_transform(b, lambda x, i: CAST(x AS HUGEINT) * CAST(pow(2, 64 - i) AS HUGEINT))) AS HUGEINT) AS u FROM {name}_b)"""


ORIGINAL = _hash_sql("o", "CAST(x AS DOUBLE)")
CODED = _hash_sql("c", "round(CAST(x AS DOUBLE), 1)")
PAIRS_SQL = f"""WITH {ORIGINAL}, {CODED}, p AS (SELECT c.vec_id AS id, o.vec_id AS other, c.label AS la, o.label AS lb,
  CAST(bit_count(xor(CAST(c.u AS UBIGINT), CAST(o.u AS UBIGINT))) AS BIGINT) AS bits FROM c, o), n AS (SELECT * FROM p WHERE bits <= 6)"""


@query("phash_bits", f"""WITH {ORIGINAL} SELECT vec_id, array_to_string(b, '') AS bits,
  CAST(CASE WHEN u >= CAST(pow(2, 63) AS HUGEINT) THEN u - 2 * CAST(pow(2, 63) AS HUGEINT) ELSE u END AS BIGINT) AS h, lpad(lower(to_hex(CAST(u AS UBIGINT))), 16, '0') AS hex FROM o""")
def _(spark, d):
    h = _hashes(spark, d).withColumn("h", X.pack_bits("b"))
    return h.select("vec_id", F.array_join(F.transform("b", lambda x: x.cast("string")), "").alias("bits"), "h", X.hash_hex("h").alias("hex"))


@query("hash_hex_roundtrip", f"WITH {ORIGINAL} SELECT vec_id, true AS same FROM o")
def _(spark, d):
    h = _hashes(spark, d).withColumn("h", X.pack_bits("b"))
    return h.select("vec_id", (X.hex_hash(X.hash_hex("h")) == F.col("h")).alias("same"))


def _pairs(spark, d):
    """Re-encoded hashes (vectors of one digit) against the registry of originals."""
    coded = _hashes(spark, d, 1).select(F.col("vec_id").alias("id"), X.pack_bits("b").alias("h"))
    known = _hashes(spark, d).select(F.col("vec_id").alias("other"), X.pack_bits("b").alias("h"))
    return triage.hamming_join(coded, known, 6)


@query("hamming_pairs", f"{PAIRS_SQL} SELECT id, other, bits FROM n")
def _(spark, d):
    return _pairs(spark, d)


@query("hamming_groups", f"""WITH {CODED}, g AS (SELECT u, min(vec_id) AS rep, count(*) AS members FROM c GROUP BY u),
  p AS (SELECT a.rep AS low, b.rep AS high, CAST(bit_count(xor(CAST(a.u AS UBIGINT), CAST(b.u AS UBIGINT))) AS BIGINT) AS bits FROM g a JOIN g b ON a.rep < b.rep)
  SELECT c.vec_id AS id, g.rep AS representative, g.members, (SELECT count(*) FROM p WHERE bits <= 6 AND (low = g.rep OR high = g.rep)) AS links FROM c JOIN g USING (u)""")
def _(spark, d):
    """Re-encoded hashes among themselves: each one's class of equal hashes, and the links of its representative."""
    h = _hashes(spark, d, 1).select(F.col("vec_id").alias("id"), X.pack_bits("b").alias("h"))
    membership, pairs = triage.hamming_groups(h, 6)
    ends = pairs.select(F.explode(F.array("low", "high")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    return membership.join(ends, "representative", "left").select("id", "representative", "members", F.coalesce("links", F.lit(0)).alias("links"))


@query("similarity_candidates_top5", f"""{PAIRS_SQL} SELECT id, other, bits, rank FROM (SELECT id, other, bits,
  CAST(row_number() OVER (PARTITION BY id ORDER BY bits, other) AS INTEGER) AS rank FROM n) WHERE rank <= 5""")
def _(spark, d):
    return triage.top_candidates(_pairs(spark, d), "id", "other")


@query("perceptual_shortcircuit_policy", f"""{PAIRS_SQL} SELECT id, other, round(bits / 64.0, 6) AS distance, bits / 64.0 <= 0.02 AND la = lb AS allowed, false AS by_default FROM n""")
def _(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    p = _pairs(spark, d).join(labels.withColumnsRenamed({"vec_id": "id", "label": "la"}), "id").join(labels.withColumnsRenamed({"vec_id": "other", "label": "lb"}), "other")
    p = triage.shortcircuit_policy(p, True, 0.02, F.col("la") == F.col("lb")).withColumnRenamed("short_circuit", "allowed")
    p = triage.shortcircuit_policy(p, False, 0.02, F.col("la") == F.col("lb"))
    return p.select("id", "other", F.round("distance", 6).alias("distance"), "allowed", F.col("short_circuit").alias("by_default"))


@query("sequence_distance_docs", """WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).{1,100}'), lambda c: CAST('0x' || substr(md5(c), 1, 16) AS UBIGINT)) AS h FROM documents),
  p AS (SELECT a.doc_id, CASE WHEN len(a.h) <= len(b.h) THEN a.h ELSE b.h END AS s, CASE WHEN len(a.h) <= len(b.h) THEN b.h ELSE a.h END AS l FROM s a JOIN s b ON b.doc_id = a.doc_id + 1),
  x AS (SELECT doc_id, s, l, unnest(range(0, len(s))) AS i FROM p WHERE len(s) > 0),
  y AS (SELECT doc_id, i, len(s) AS n, s[i + 1] AS h, l, CASE WHEN len(s) > 1 THEN CAST(floor(i * (len(l) - 1) / greatest(1, len(s) - 1)) AS BIGINT) ELSE 0 END AS c, greatest(1, len(l) // len(s)) AS w FROM x),
  z AS (SELECT doc_id, n, list_min(list_transform(l[greatest(0, c - w) + 1:least(len(l), c + w + 1)], lambda q: bit_count(xor(q, h)))) AS m FROM y),
  t AS (SELECT doc_id, sum(m) / max(n) / 64.0 AS dist FROM z GROUP BY doc_id)
  SELECT p.doc_id, round(coalesce(dist, 1.0), 6) AS distance FROM p LEFT JOIN t USING (doc_id)""")
def _(spark, d):
    """Hashes of a text's pieces of 100 characters (the last may be shorter) against those of the next document."""
    h = F.expr("transform(regexp_extract_all(text, '(?s).{1,100}', 0), c -> cast(conv(substr(md5(c), 1, 16), 16, -10) as bigint))")
    s = table(spark, d, "documents").select("doc_id", h.alias("h"))
    p = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g")), "doc_id")
    return p.select("doc_id", F.round(X.sequence_distance("h", "g"), 6).alias("distance"))
