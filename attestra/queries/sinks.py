"""Sinks written and read again: what comes back must equal the tables they were given."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra import sinks
from attestra.operators import custody, seal
from attestra.queries.base import query
from attestra.session import scratch, table
from attestra.sources import files, text
from attestra.sources.packed import Packed
from attestra.sources.remote_zip import register


@query("model_round_trip", "SELECT label AS branch, round(avg(embedding[1]), 6) AS first, count(*) AS n_train FROM embeddings GROUP BY label")
def _(spark, d):
    """A model's coefficients as a table: no pickles."""
    model = table(spark, d, "embeddings").groupBy(F.col("label").alias("branch")).agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("coef"), F.count("*").alias("n_train"))
    path = scratch(spark, "model")
    sinks.save_model(model, path)
    return sinks.load_model(spark, path).select("branch", F.round(F.col("coef")[0], 6).alias("first"), "n_train")


@query("json_round_trip", "SELECT doc_id, lang, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def _(spark, d):
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), scratch(spark, "json")
    sinks.write_json(docs, path)
    back = spark.read.schema("doc_id long, lang string, n_chars long, text string").json(path)
    return back.select("doc_id", "lang", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("manifest_round_trip", "SELECT 'clip' || doc_id AS clip_id, lang AS label, 'denoise,' || coalesce(lang, '') AS ops FROM documents")
def _(spark, d):
    """A CSV manifest whose lists are JSON."""
    path, i = scratch(spark, "manifest"), F.col("doc_id")
    text.write_manifest(table(spark, d, "documents").select(F.concat(F.lit("clip"), i).alias("clip_id"), F.col("lang").alias("label"), F.array(F.lit("denoise"), F.coalesce("lang", F.lit(""))).alias("video_ops")), path)
    back = text.read_manifest(spark, path, "clip_id string, label string, video_ops string")
    return back.select("clip_id", "label", F.array_join(text.json_list(F.col("video_ops")), ",").alias("ops"))


@query("custody_records", "SELECT 'r' || item_id AS record_id, sha256(text) AS canonical_sha256 FROM benchmark")
def _(spark, d):
    """One pretty JSON record a folder."""
    path = scratch(spark, "records")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("r"), "item_id").alias("record_id"), F.sha2("text", 256).alias("canonical_sha256"))
    sinks.write_records(rows, path)
    back = spark.read.text(path, wholetext=True)
    return back.select("id", F.from_json("value", "record_id string, canonical_sha256 string").alias("r")).select("r.record_id", "r.canonical_sha256")


@query("custody_archives", "SELECT 'r' || item_id AS record_id, sha256(text) AS canonical_sha256 FROM benchmark")
def _(spark, d):
    """The same records, packed into an archive a task and committed as a whole."""
    path = scratch(spark, "archives")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("r"), "item_id").alias("record_id"), F.sha2("text", 256).alias("canonical_sha256"))
    register(spark, Packed)
    sinks.pack_records(rows, path)
    back = spark.read.format("packed").load(path)
    return back.select(F.from_json(F.col("content").cast("string"), "record_id string, canonical_sha256 string").alias("r")).select("r.record_id", "r.canonical_sha256")


@query("table_cells_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN abs(c_acctbal) < 1000 THEN printf('%.4f', c_acctbal) ELSE printf('%.1f', round(c_acctbal, 1)) END AS c_acctbal FROM customer")
def _(spark, d):
    path = scratch(spark, "table")
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.abs("c_acctbal") < 1000, F.col("c_acctbal")).otherwise(F.round("c_acctbal", 1)).alias("c_acctbal"))
    sinks.write_table(rows, path)
    return spark.read.csv(path, header=True)


@query("ledger_round_trip", "SELECT item_id AS index, sha256(text) AS payload FROM benchmark")
def _(spark, d):
    """A JSONL ledger, written as one chain and read in its order."""
    path = scratch(spark, "ledger")
    body = F.concat_ws("|", "item_id", F.coalesce(F.sha2("text", 256), F.lit("")))
    chain = custody.build_chain(table(spark, d, "benchmark").select(F.lit(0).alias("chain"), "item_id", body.alias("body")), "chain", "item_id", "body")
    text.write_ledger(chain.select("index", "prev_hash", "payload", "entry_hash"), path)
    back = text.read_ledger(spark, path).select(F.split("payload", r"\|").alias("p"))
    return back.select(F.col("p")[0].cast("long").alias("index"), F.nullif(F.col("p")[1], F.lit("")).alias("payload"))


@query("byte_scan", "SELECT item_id, sha256(text) AS sha256, strlen(text) AS length FROM benchmark WHERE text IS NOT NULL AND strlen(text) > 0")
def _(spark, d):
    """Each item as a file of its own, found again by a byte scan."""
    path = scratch(spark, "bytes")
    items = table(spark, d, "benchmark").where("text IS NOT NULL AND length(text) > 0")
    items.select(F.col("text").alias("value"), F.col("item_id").alias("item")).write.option("lineSep", "\u0000").partitionBy("item").text(path)
    found = files.scan(spark, path, "part-*")
    content = F.expr("substring(content, 1, length(content) - 1)")  # without the separator at the end
    return found.select(F.regexp_extract("path", r"item=(\d+)", 1).cast("long").alias("item_id"), F.sha2(content, 256).alias("sha256"), (F.col("length") - 1).alias("length"))


@query("environment_rows", "SELECT lang, name, count(*) AS sealed FROM documents, (VALUES ('python'), ('spark'), ('numpy')) e(name) GROUP BY lang, name")
def _(spark, d):
    """The environment that every slice of the corpus was sealed in."""
    env = seal.environment(spark).select(F.explode("environment").alias("name", "version")).where("name IN ('python', 'spark', 'numpy') AND version <> 'not installed'")
    slices = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("sealed"))
    return slices.crossJoin(F.broadcast(env)).select("lang", "name", "sealed")  # three rows
