"""Custody over conversations (a chain and a track a conversation) and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import custody as C
from attestra.operators import merkle
from attestra.operators.ledger import StoredLedger
from attestra.queries.base import query
from attestra.session import scratch, table

LEAVES = "leaf AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS i, sha256('\\x00'::BLOB || encode(coalesce(text, ''))) AS h FROM conversations)"
TREE = f"""WITH RECURSIVE {LEAVES}, t AS (SELECT conv_id, 0 AS lvl, i, h, count(*) OVER (PARTITION BY conv_id) AS n FROM leaf
 UNION ALL SELECT conv_id, lvl + 1, i // 2, sha256('\\x01'::BLOB || unhex(h) || unhex(coalesce(nx, h))), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY conv_id, lvl ORDER BY i) AS nx FROM t WHERE n > 1) WHERE i % 2 = 0)"""


def leaves(spark, d):
    c = table(spark, d, "conversations")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select("conv_id", i.cast("long").alias("i"), C.leaf_hash(F.coalesce("text", F.lit(""))).alias("h"))


@query("merkle_roots", f"{TREE} SELECT conv_id, (SELECT count(*) FROM leaf l WHERE l.conv_id = t.conv_id) AS n_leaves, h AS root FROM t WHERE n = 1")
def _(spark, d):
    return merkle.roots(leaves(spark, d), "conv_id", "i", "h")


def proofs(spark, d):
    return merkle.proofs(leaves(spark, d), "conv_id", "i", "h")


@query("merkle_proofs", f"""{TREE}, u AS (SELECT conv_id, lvl, i, h, n FROM t),
 s AS (SELECT l.conv_id, l.i, u.lvl, CASE WHEN ((l.i >> u.lvl) % 2) = 0 THEN 'right' ELSE 'left' END AS side, coalesce(v.h, u.h) AS h FROM leaf l JOIN u ON u.conv_id = l.conv_id AND u.i = (l.i >> u.lvl) AND u.n > 1
  LEFT JOIN u v ON v.conv_id = l.conv_id AND v.lvl = u.lvl AND v.i = xor(l.i >> u.lvl, 1))
 SELECT l.conv_id, CAST(l.i AS INTEGER) AS i, coalesce(string_agg(side || ':' || s.h, ',' ORDER BY lvl), '') AS path FROM leaf l LEFT JOIN s ON s.conv_id = l.conv_id AND s.i = l.i GROUP BY l.conv_id, l.i""")
def _(spark, d):
    return proofs(spark, d).select("conv_id", F.col("i").cast("int").alias("i"), F.array_join(F.transform("path", lambda s: F.concat_ws(":", s["side"], s["hash"])), ",").alias("path"))


@query("proof_verify", "SELECT conv_id, count(*) AS proofs, true AS all_valid, false AS altered_valid FROM conversations GROUP BY conv_id")
def _(spark, d):
    """Every proof leads to the root; with another leaf none does."""
    p = proofs(spark, d).withColumns({"ok": C.proof_root("leaf", "path") == F.col("root"), "other": F.sha2("leaf", 256)})
    p = p.withColumn("bad", C.proof_root("other", "path") == F.col("root"))
    return p.groupBy("conv_id").agg(F.count("*").alias("proofs"), F.bool_and("ok").alias("all_valid"), F.bool_or("bad").alias("altered_valid"))


@query("combined_root", "SELECT doc_id, sha256('custody-root|' || sha256(text) || '|' || sha256(lang) || '|' || sha256(source)) AS root FROM documents")
def _(spark, d):
    s = lambda c: F.sha2(F.col(c), 256)
    return table(spark, d, "documents").select("doc_id", C.combined_root(s("text"), s("lang"), s("source")).alias("root"))


CHAIN = """WITH RECURSIVE r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS i, coalesce(role, '') || ':' || coalesce(text, '') AS b FROM conversations),
 l AS (SELECT conv_id, i, repeat('0', 64) AS prev_hash, b, sha256(concat_ws('|', CAST(i AS VARCHAR), repeat('0', 64), b)) AS h FROM r WHERE i = 0
  UNION ALL SELECT r.conv_id, r.i, l.h, r.b, sha256(concat_ws('|', CAST(r.i AS VARCHAR), l.h, r.b)) FROM l JOIN r ON r.conv_id = l.conv_id AND r.i = l.i + 1)"""


def ledger(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat_ws(":", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return C.build_chain(c.select("conv_id", "turn", body.alias("body")), "conv_id", "turn", "body").withColumn("pos", F.col("index"))


@query("ledger_chain", f"{CHAIN} SELECT conv_id, i AS index, prev_hash, h AS entry_hash FROM l")
def _(spark, d):
    return ledger(spark, d).select("conv_id", "index", "prev_hash", "entry_hash")


@query("ledger_appends", f"{CHAIN} SELECT conv_id, i AS index, prev_hash, h AS entry_hash FROM l")
def _(spark, d):
    """The same chains in a store, by four appends, each from the heads of the one before."""
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.concat_ws(":", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("body"))
    store = StoredLedger(spark, scratch(spark, "ledger"), "conv_id")
    for part in ("turn < 2", "turn = 2", "turn > 2 AND turn < 5", "turn >= 5"):
        store.append(rows.where(part), "turn", "body")
    return store.read().select("conv_id", "index", "prev_hash", "entry_hash")


@query("ledger_head", f"{CHAIN} SELECT conv_id, arg_max(h, i) AS head FROM l GROUP BY conv_id")
def _(spark, d):
    return ledger(spark, d).groupBy("conv_id").agg(F.max_by("entry_hash", "index").alias("head"))


@query("ledger_verify", "SELECT conv_id, count(*) AS entries, true AS valid FROM conversations GROUP BY conv_id")
def _(spark, d):
    return C.check_chain(ledger(spark, d), "conv_id").select("conv_id", "entries", "valid")


@query("ledger_tamper_matrix", """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
 SELECT 'modify' AS attack, count(*) FILTER (WHERE n >= 2) AS caught, count(*) FILTER (WHERE n < 2) AS untouched, coalesce(min(CASE WHEN n >= 2 THEN 1 END), -1) AS first_place FROM n
 UNION ALL SELECT 'delete', count(*) FILTER (WHERE n >= 3), count(*) FILTER (WHERE n < 3), coalesce(min(CASE WHEN n >= 3 THEN 1 END), -1) FROM n
 UNION ALL SELECT 'reorder', count(*) FILTER (WHERE n >= 3), count(*) FILTER (WHERE n < 3), coalesce(min(CASE WHEN n >= 3 THEN 1 END), -1) FROM n""")
def _(spark, d):
    """A deletion of the last entry leaves a valid, shorter chain (its head tells); the counts show it."""
    whole, out = ledger(spark, d), None
    for kind in ("modify", "delete", "reorder"):
        c = C.check_chain(C.tampered(whole, kind), "conv_id").agg(F.count_if(~F.col("valid")).alias("caught"), F.count_if("valid").alias("untouched"), F.coalesce(F.min("broken_at"), F.lit(-1)).alias("first_place"))
        c = c.select(F.lit(kind).alias("attack"), "caught", "untouched", "first_place")
        out = c if out is None else out.unionByName(c)
    return out


@query("tamper_localise", "SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM conversations WHERE (conv_id + turn) % 7 = 0")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    edited = c.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    leaf = lambda x: x.select("conv_id", "turn", C.leaf_hash(F.col("text")).alias("leaf"))
    return C.changed_leaves(leaf(c), leaf(edited), ["conv_id", "turn"])


@query("event_log", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq, round(epoch(ts - min(ts) OVER (PARTITION BY user_id)), 3) AS elapsed FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", "event_id", micros.alias("us"))
    return e.select("user_id", "event_id", (F.row_number().over(w.orderBy("us", "event_id")) - 1).alias("seq"), F.round((F.col("us") - F.min("us").over(w)) / F.lit(1e6), 3).alias("elapsed"))


#: Requirement and whether this engine meets it.
CHECKLIST = [
    ("original bytes hashed before any processing", True), ("processing steps recorded", True), ("per-track commitments", True), ("inclusion proofs per chunk", True),
    ("append-only hash chain", True), ("tamper localised to a chunk", True), ("configuration digest sealed", True), ("model identity sealed", True), ("verdict sealed", True),
    ("unavailable evidence stated", True), ("uncertainty stated", True), ("reproducible root", True), ("independent verification", True),
    ("qualified timestamp", False), ("certified signing key", False),
]


#: Requirements that the tables themselves show, by their place in the list.
SHOWN = {
    1: "SELECT count(text) FROM documents", 3: "SELECT count(DISTINCT conv_id) FROM conversations", 4: "SELECT count(*) FROM conversations",
    5: "SELECT count(DISTINCT conv_id) FROM conversations", 6: "SELECT count(*) FROM conversations WHERE (conv_id + turn) % 7 = 0",
}


@query("compliance_checklist", "SELECT item, requirement, satisfied, evidence FROM (VALUES " + ", ".join(f"({i + 1}, '{t}', {str(ok).lower()}, ({SHOWN.get(i + 1, 'SELECT 0')}))" for i, (t, ok) in enumerate(CHECKLIST)) + ") c(item, requirement, satisfied, evidence)")
def _(spark, d):
    """What can be shown is: hashes, commitments, proofs, chains and the places of changes are made and verified over the
    tables, and ``evidence`` counts what held. The rest is stated."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    edited = c.withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    leaf = lambda x: x.select("conv_id", "turn", C.leaf_hash(F.col("text")).alias("leaf"))
    p = proofs(spark, d)
    shown = {
        1: table(spark, d, "documents").select((F.length(F.sha2("text", 256)) == 64).alias("ok")).where("ok IS NOT NULL"),
        3: merkle.roots(leaves(spark, d), "conv_id", "i", "h").select(F.col("root").isNotNull().alias("ok")),
        4: p.select((C.proof_root("leaf", "path") == F.col("root")).alias("ok")),
        5: C.check_chain(ledger(spark, d), "conv_id").select(F.col("valid").alias("ok")),
        6: C.changed_leaves(leaf(c), leaf(edited), ["conv_id", "turn"]).select(((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("ok")),
    }
    found = None
    for item, rows in shown.items():
        one = rows.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("held"), F.count_if("ok").alias("evidence")).select(F.lit(item).alias("item"), "held", "evidence")
        found = one if found is None else found.unionByName(one)
    listed = spark.createDataFrame([(i + 1, t, ok) for i, (t, ok) in enumerate(CHECKLIST)], "item int, requirement string, stated boolean")
    return listed.join(F.broadcast(found), "item", "left").select("item", "requirement", (F.col("stated") & F.coalesce("held", F.lit(True))).alias("satisfied"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
