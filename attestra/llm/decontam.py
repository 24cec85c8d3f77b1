r"""Benchmark decontamination by winnowing, with Spark expressions only.

Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z. A window is
``window`` neighbouring words of an item (a shorter item is one window). Of each window's
k-word hashes the least is its fingerprint, on both sides, so a document that holds a
window holds its fingerprint. Fingerprints of the documents meet those of the benchmark
in a join; each hit is extended to the words around it, whose windows are compared as
text. So no window is missed and none is taken by a hash alone.

The benchmark is broadcast behind a count (``BROADCAST_ROWS`` fingerprints at most);
beyond it the same fingerprints meet in a shuffled join. Documents are scanned once and
their texts are never shuffled on the first way.

Defined results: a null text has no words; an item without words has no window and never
hits; an item's repeated rows count as one; each row of documents gives one row, also for
repeated rows and ids; other columns are ignored; without a benchmark nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import common

WINDOW, K = 10, 5
BROADCAST_ROWS = 2_000_000
#: Separators: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def _lowered(words: Column, start: Column, n: Column | int) -> Column:
    """A window as text: its words, A-Z lower-cased, with single spaces."""
    return F.translate(F.array_join(F.slice(words, start, n), " "), string.ascii_uppercase, string.ascii_lowercase)


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``. A lambda's variable is evaluated once,
    where a column of a lower projection may be inlined into a lambda and evaluated per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


HASHES = "transform(words, x -> xxhash64(lower(x)))"


def _prints(window: int, k: int) -> Column:
    """Struct of least (the fingerprint of each window of ``words``) and places (where they
    are looked up: at each change, and at least once in as many windows as one fingerprint
    spans). The hash sees fully lower-cased words, so it equates more than the comparison
    that follows."""
    span = window - k + 1
    grams = f"if(size(h) >= {window}, transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(k))})), array())"
    least = f"if(size(g) > 0, transform(sequence(0, size(g) - {span}), i -> least({', '.join(f'g[i + {j}]' for j in range(span))})), array())"
    places = f"if(size(m) > 0, filter(sequence(0, size(m) - 1), i -> i % {span} = 0 OR m[i] <> m[greatest(i - 1, 0)]), array())"
    return F.expr(_let(HASHES, "h", _let(grams, "g", _let(least, "m", f"named_struct('least', m, 'places', {places})"))))


def _runs(n: int) -> Column:
    return F.expr(_let(HASHES, "h", f"if(size(h) >= {n}, transform(sequence(0, size(h) - {n}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(n))})), array())"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, rid, n_words, copies (rows of this id and text), hits (array of start, n words), items (array of item_id as text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    windows = (
        items.select("item_id", "words", F.expr(f"least(size(words), {window})").alias("n"), F.expr(f"explode(sequence(0, greatest(size(words) - {window}, 0)))").alias("at"))
        .select("item_id", "n", _lowered(F.col("words"), F.col("at") + 1, F.col("n")).alias("win"))
        .groupBy("win", "n")
        .agg(F.collect_set("item_id").alias("items"))
    )
    prints = items.select(F.explode(_prints(window, k)["least"]).alias("print")).distinct()
    short = [r.n for r in items.where(f"size(words) < {window}").select(F.size("words").alias("n")).distinct().collect()]
    small = prints.count() <= broadcast_rows and windows.count() <= broadcast_rows
    near = F.broadcast if small else lambda df: df

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.xxhash64("doc_id", text).alias("rid"), _words(F.col("text")).alias("words"))
    span = window - k + 1
    ready = base.select("doc_id", "rid", "words", _prints(window, k).alias("p"))
    context = F.when(F.col("at") >= 0, F.slice(F.col("words"), F.col("at") + 1, window + span - 1))
    out = ["doc_id", "rid", F.size("words").alias("n_words"), "at", context.alias("context")]
    known = prints.withColumn("found", F.lit(True))
    if small:
        # One row more for each document, at -1, keeps those without hits.
        spread = ready.select("doc_id", "rid", "words", "p", F.explode(F.concat(F.array(F.lit(-1)), F.col("p.places"))).alias("at"))
        spread = spread.withColumn("print", F.expr("CASE WHEN at >= 0 THEN p.least[greatest(at, 0)] END"))
        spread = spread.select("doc_id", "rid", "words", "at", "print").join(F.broadcast(known), "print", "left").where("found OR at = -1").select(*out)
    else:
        met = ready.select("rid", "doc_id", "p", F.explode("p.places").alias("at")).select("rid", "doc_id", "at", F.expr("p.least[at]").alias("print")).join(known, "print")
        met = met.groupBy("rid", F.col("doc_id").alias("met_doc")).agg(F.collect_set("at").alias("ats")).withColumnRenamed("rid", "met_rid")
        spread = base.join(met, (F.col("rid") == F.col("met_rid")) & F.col("doc_id").eqNullSafe(F.col("met_doc")), "left").select("doc_id", "rid", "words", F.explode(F.concat(F.array(F.lit(-1)), F.coalesce("ats", F.array().cast("array<int>")))).alias("at")).select(*out)
    tried = spread.select("doc_id", "rid", "n_words", "at", "context", F.expr(f"explode_outer(filter(sequence(0, {span - 1}), j -> size(context) >= j + {window}))").alias("j"))
    tried = tried.select("doc_id", "rid", "n_words", (F.col("at") < 0).alias("own"), (F.col("at") + F.col("j")).alias("start"), F.lit(window).alias("n"), F.when(F.col("j").isNotNull(), _lowered(F.col("context"), F.col("j") + 1, window)).alias("win"))
    for n in short:
        # Items shorter than a window: each run of so many words.
        few = items.where(f"size(words) = {n}").select(F.explode(_runs(n)).alias("print")).distinct()
        runs = base.select("doc_id", "rid", "words", F.posexplode(_runs(n)).alias("start", "print"))
        if small:
            runs = runs.join(F.broadcast(few), "print", "left_semi")
        else:
            met = runs.select(F.col("rid").alias("met_rid"), F.col("doc_id").alias("met_doc"), "print", "start").join(few, "print", "left_semi").select("met_rid", "met_doc", "start").distinct()
            runs = base.join(met, (F.col("rid") == F.col("met_rid")) & F.col("doc_id").eqNullSafe(F.col("met_doc"))).drop("met_rid", "met_doc")
        tried = tried.unionByName(runs.select("doc_id", "rid", F.size("words").alias("n_words"), F.lit(False).alias("own"), "start", F.lit(n).alias("n"), _lowered(F.col("words"), F.col("start") + 1, n).alias("win")))
    found = tried.join(near(windows), ["win", "n"], "left").where("own OR items IS NOT NULL")
    return found.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if("own").alias("copies"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "n"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their columns."""
    rid, own = (common.fresh(n, docs.columns) for n in ("hit_rid", "hit_doc"))
    hit = find_contamination(docs, benchmark, **kw).where("size(hits) > 0").select(F.col("rid").alias(rid), F.col("doc_id").alias(own))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(rid + "_own", F.xxhash64("doc_id", text))
    return keyed.join(hit, (keyed[rid + "_own"] == hit[rid]) & keyed["doc_id"].eqNullSafe(hit[own]), "left_anti").drop(rid + "_own")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    covered = F.expr("size(array_distinct(flatten(transform(hits, x -> sequence(x.start, x.start + x.n - 1)))))")
    return found.withColumn("n_hit", covered.cast("long")).select(
        F.expr("explode(array_repeat(doc_id, CAST(copies AS int)))").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
