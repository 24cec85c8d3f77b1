"""Ranked lexical search: WAND per document shard, shard heaps merged.

1. Documents are cut into shards of neighbouring rows. A shard's index holds, for each term of the
   searched items, the documents with it in order and its frequency there. Indexes are written as a
   table in the shared folder, so that statistics and search read them and not the texts again.
2. N, L and the terms' document frequencies are sums over the shards.
3. A task walks through its shards with one heap an item. Within a shard a term's largest impact
   bounds what it can add to a score. Terms are put in order of these bounds, and the pivot is the
   first at which their sum reaches the heap's threshold: a document without a term from the pivot
   on can't enter the heap and is skipped. Others are looked up in the remaining lists, from the
   largest bound down, and left as soon as their score and the bounds still to come are too low.
   The pivot is selected for all documents of a shard at once, not for one after the other.
4. The tasks' heaps (k rows an item and task) are merged by rank.

Items are searched in blocks of bounded bytes (:data:`BLOCK_BYTES`): only a block's terms and their
weights travel to the tasks, and each block is one pass over the documents.

Terms are told apart by 64-bit hashes. Defined results: a null text has no terms; documents without
terms count in no statistic; repeated rows are documents of their own; a null doc_id comes after all
others of its score; items with equal item_id and text are one, those with equal item_id and other
texts are ranked each on its own; items without terms, or without a match, and empty tables give no
rows. Columns besides doc_id, item_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm import common, words

TOP = 10
#: Documents and bytes of text of one shard, whichever is reached first (a longer text is a shard of its own).
SHARD_DOCS, SHARD_BYTES = 1024, 1 << 21
#: Bytes of the items searched at once.
BLOCK_BYTES = 4 << 20

INDEX = "n_docs long, n_terms long, docs binary, nulls binary, sizes binary, terms array<long>, dfs array<int>, places binary, counts binary"


def _terms(texts: list[bytes]) -> words.Words:
    return words.split(texts, words.NO_LETTERS, lower=True)


def index_shards(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row a shard: its documents with a term (``docs``, ``sizes``: int64; ``nulls``: bool), the terms of
    ``vocabulary`` (sorted hashes) it holds, how many documents have each, and their places in ``docs``
    (int32) and counts there (int32), term after term."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body")).where("body IS NOT NULL")

    def shard(ids: list, texts: list[bytes]) -> list:
        w = _terms(texts)
        sizes = np.diff(w.first)
        kept = np.flatnonzero(sizes)
        place = np.cumsum(sizes > 0) - 1
        at = np.searchsorted(vocabulary, w.hashes)
        known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == w.hashes) if len(vocabulary) else np.zeros(0, np.int64)
        key, tf = np.unique(at[known].astype(np.int64) * len(texts) + place[w.doc[known]], return_counts=True)
        term, at_doc = key // len(texts), key % len(texts)
        terms, dfs = np.unique(term, return_counts=True)
        own = [ids[i] for i in kept]
        return [
            len(kept), int(sizes.sum()), np.array([x or 0 for x in own], np.int64).tobytes(), np.array([x is None for x in own], bool).tobytes(), sizes[kept].astype(np.int64).tobytes(),
            vocabulary[terms].view(np.int64), dfs.astype(np.int32), at_doc.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes(),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        names = [c.split()[0] for c in INDEX.split(", ")]
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("body"), strict=True):
                text = t.as_py()
                if ids and (len(ids) >= SHARD_DOCS or size + len(text) > SHARD_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(shard(ids, texts), kinds, strict=True)], names=names)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(shard(ids, texts), kinds, strict=True)], names=names)
        ids = texts = []
        common.tidy()

    return rows.mapInArrow(run, INDEX)


def weights(n: int, dfs: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))); 0 for a term that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) if d else 0 for d in dfs], np.int64)


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places) that may score ``least`` or more, with their scores. ``lists``: places in order, impacts
    and the largest of them, of each term."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in lists]) if lists else np.zeros(0, np.int64)
    pivot = int(np.searchsorted(bounds, least))
    score = np.zeros(n_docs, np.int64)
    met = np.zeros(n_docs, bool)
    for places, impacts, _ in lists[pivot:]:
        score[places] += impacts
        met[places] = True
    open_ = np.flatnonzero(met)
    for t in range(pivot - 1, -1, -1):
        open_ = open_[score[open_] + bounds[t] >= least]
        if not len(open_):
            break
        places, impacts, _ = lists[t]
        at = np.minimum(np.searchsorted(places, open_), len(places) - 1)
        hit = places[at] == open_
        score[open_[hit]] += impacts[at[hit]]
    open_ = open_[score[open_] >= max(least, 1)]
    return open_, score[open_]


def search_shards(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, weight: np.ndarray, n: int, total: int, k: int = TOP) -> DataFrame:
    """item (place in ``items``), doc_id, score: the k best of each task. An item is its terms (places in
    ``vocabulary``, sorted) and how often it repeats each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A heap's least entry is its worst: lowest score, then a null, then the largest doc_id.
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        slot = np.full(len(vocabulary), -1, np.int64)
        for b in batches:
            for row in b.to_pylist():
                docs, nulls = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nulls"], bool)
                dfs = np.array(row["dfs"], np.int64)
                if not len(dfs):
                    continue
                own = np.searchsorted(vocabulary, np.array(row["terms"], np.int64).view(np.uint64))
                places, tf = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
                length = 100 - 75 + (75 * np.frombuffer(row["sizes"], np.int64) * n) // total
                impacts = np.repeat(weight[own], dfs) * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[places]))
                ends = np.cumsum(dfs)
                starts = ends - dfs
                largest = np.maximum.reduceat(impacts, starts)
                slot[own] = np.arange(len(own))
                for (terms, repeats), heap in zip(items, heaps, strict=True):
                    here = slot[terms]
                    there = np.flatnonzero(here >= 0)
                    chosen = [(places[starts[s] : ends[s]], impacts[starts[s] : ends[s]] * r, int(largest[s]) * r) for s, r in zip(here[there].tolist(), repeats[there].tolist(), strict=True)]
                    least = heap[0][0] if len(heap) == k else 1
                    for p, s in zip(*(x.tolist() for x in wand(chosen, len(docs), least)), strict=True):
                        entry = (s, not nulls[p], -int(docs[p]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                slot[own] = -1
        out = [(i, -d if real else None, s) for i, heap in enumerate(heaps) for s, real, d in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])
        common.tidy()

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """The ranks of one block of items; ``item`` holds (item_id, text)."""
    spark = docs.sparkSession
    rows = block.collect()
    w = _terms([(r.text or "").encode() for r in rows])
    vocabulary = np.unique(w.hashes)
    if not len(vocabulary):
        return None
    items = [np.unique(np.searchsorted(vocabulary, w.hashes[a:z]), return_counts=True) for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
    index = common.written(index_shards(docs, vocabulary), "search-index")
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    if not sums.total:
        return None
    found = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).toArrow()
    dfs = np.zeros(len(vocabulary), np.int64)
    dfs[np.searchsorted(vocabulary, found["terms"].to_numpy().view(np.uint64))] = found["df"].to_numpy()
    best = search_shards(index, items, vocabulary, weights(sums.n, dfs), sums.n, sums.total, k)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    every = [items] if blocks < 2 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks)) == i) for i in range(2 * blocks)]
    ranked = [x for x in (_block(docs, block, k) for block in every) if x is not None]
    if not ranked:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = ranked[0]
    for x in ranked[1:]:
        out = out.unionByName(x)
    return out


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), qt AS (SELECT item_id, term, count(*) AS r FROM q GROUP BY ALL),
sums AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(r * CAST(floor(1000 * ln((2 * n_all + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (term) JOIN dfs USING (term), sums GROUP BY item_id, rid, doc_id
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
