"""Substring dedup: suffix automata of reference texts, matching statistics of the others.

A window is ``window`` consecutive words of one document. A word goes if a window over
it, as a sequence of words, also starts in a document with a smaller doc_id.

Automata of the whole corpus would grow with it and can't be broadcast, and streaming
every document past every shard would be quadratic. So shards are routed by anchors:

1. Winnowing picks the least hash of every (window - k + 1) neighbouring k-word runs, so
   two documents that share a window share an anchor. Anchors of two or more documents
   stay (a shuffle of hashes, not of texts).
2. Anchors of few documents pair these documents; an anchor of many pairs each with the
   smallest of them. Each earlier document of a pair is a reference shard: its automaton is
   built where its partners stream past it (in lots, so that a shard of thousands isn't one
   task's), and spans where the match is as long as a window or longer go.
3. Where an anchor stands in many documents, a window may be in an earlier document that
   isn't the smallest. So windows over such an anchor that step 2 has not covered are looked
   up by hash (two of 64 bits) among all those documents. Copies and common passages are
   covered by then, so these are few, and no pairs of a group are made.

Defined results: a null text has no words; a null doc_id is neither earlier nor later
than any other, so such rows keep all their words; rows with one doc_id are no copies of
each other (none is smaller), each gets its own result; repeated rows stay. Columns
besides doc_id and text pass through the operator; the empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import common, words

WINDOW = 50
#: Words of an anchor; any window holds window - k + 1 of them.
K = 10
#: Anchors of more documents than this pair them with their smallest document, not with each other.
FEW = 8
#: Documents that stream past one automaton in one task.
LOT = 256


class SuffixAutomaton:
    """Of a sequence of word hashes."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            nexts, link, length = self.next, self.link, self.length
            cur, p = len(nexts), last
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def spans(self, symbols: list[int], least: int) -> list[tuple[int, int]]:
        """Spans [start, end) of symbols, one for each run of neighbouring windows of ``least`` that match: every
        window within a span is a match itself, so spans that overlap are not merged."""
        found: list[tuple[int, int]] = []
        nexts, link, length = self.next, self.link, self.length
        v = size = 0
        running = False
        for i, c in enumerate(symbols):
            while v and c not in nexts[v]:
                v = link[v]
                size = length[v]
            if c in nexts[v]:
                v = nexts[v][c]
                size += 1
            if size < least:
                running = False
            elif running:
                found[-1] = (found[-1][0], i + 1)
            else:
                running = True
                found.append((i + 1 - least, i + 1))
        return found


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _anchors(w: words.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word position and hash of the chosen runs, by document and position."""
    runs, span = words.runs(w.hashes, k), window - k + 1
    doc = w.doc
    inside = np.flatnonzero(doc[: len(runs)] == doc[k - 1 :]) if len(runs) else np.zeros(0, np.int64)
    # A window's runs are neighbours in one document.
    n = len(runs) - span + 1
    if n <= 0 or not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    whole = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    least = words.sliding_min(runs, span)[whole]
    # The last place of the least hash in each window.
    last = np.zeros(len(whole), np.int64)
    for j in range(span):
        last = np.where(runs[whole + j] == least, whole + j, last)
    at = np.unique(last)
    return doc[at], at, runs[at]


def _docs(df: DataFrame) -> DataFrame:
    """rid (hash of doc_id and text), own_id and body of rows with a doc_id. Every join with texts is over this very
    plan, so that Spark shuffles them once."""
    text = F.col("text").cast("string").cast("binary")
    id_ = F.col("doc_id").cast("long")
    return df.select(F.xxhash64(id_, text).alias("rid"), id_.alias("own_id"), F.coalesce(text, F.lit(b"")).alias("body")).where("own_id IS NOT NULL")


def copies(docs: DataFrame) -> DataFrame:
    """rid and doc_id of texts that a smaller doc_id has as a whole."""
    keyed = docs.select("rid", "own_id", F.md5("body").alias("key"))
    first = keyed.groupBy("key").agg(F.min("own_id").alias("low"))
    return keyed.join(first, "key").where("own_id > low").select("rid", F.col("own_id").alias("doc_id")).distinct()


def removed_spans(df: DataFrame, window: int = WINDOW, k: int = K, few: int = FEW, leaders: bool = True) -> DataFrame:
    """doc_id and rid (hash of doc_id and text), which together name a row, and spans: array of (start, stop) in words.

    The result is the same with and without ``leaders``. With them (step 2 for anchors of many documents), few
    windows are left to look up, but texts travel once for each leader they have: for tables with few copies. Without
    them all windows over such anchors are looked up: for tables where copies by the thousand have many leaders."""
    docs = _docs(df)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("rid").to_pylist(), strict=True))
            for ids, texts in words.chunks(rows, _bytes(b.column("body"))):
                doc, _, h = _anchors(words.split(texts), window, k)
                if len(h):
                    keep = np.unique(np.rec.fromarrays([doc, h]))
                    doc, h = keep["f0"], keep["f1"]
                    own = np.array(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own[doc, 0]), pa.array(own[doc, 1])], names=["h", "doc_id", "rid"])

    found = docs.select("rid", F.col("own_id").alias("doc_id"), "body").mapInArrow(anchors, "h long, doc_id long, rid long")
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "n")
    if leaders:
        first = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("first"), F.max("doc_id").alias("high")).where("first.doc_id < high")
        shared = first.select("h", "n", F.when(F.col("n") > few, F.col("first")).alias("first"))
    whole = common.written(copies(docs), "substring-copies")
    # The first of equal texts has a smaller doc_id than the others and all of their windows: it stands for them.
    hits = common.written(found.join(shared, "h").join(whole, ["rid", "doc_id"], "left_anti"), "substring-hits")

    groups = hits.where(F.col("n") <= few).groupBy("h").agg(F.collect_set(F.struct("doc_id", "rid")).alias("g"))
    pairs = groups.select(F.explode(F.expr("flatten(transform(g, x -> transform(filter(g, y -> y.doc_id < x.doc_id), y -> named_struct('shard', y.rid, 'shard_id', y.doc_id, 'rid', x.rid, 'doc_id', x.doc_id, 'n', 1L))))")).alias("p")).select("p.*")
    if leaders:
        led = hits.where((F.col("n") > few) & (F.col("doc_id") > F.col("first.doc_id"))).select(F.col("first.rid").alias("shard"), F.col("first.doc_id").alias("shard_id"), "rid", "doc_id", "n")
        pairs = pairs.unionByName(led)
    pairs = pairs.groupBy("shard", "shard_id", "rid", "doc_id").agg(F.max("n").alias("n"))
    pairs = common.cut(pairs.withColumn("lot", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / F.lit(float(LOT))))).drop("n"))
    met = lambda rows: rows.withColumnRenamed("doc_id", "own_id").join(docs, ["rid", "own_id"]).withColumnRenamed("own_id", "doc_id")
    streams = met(pairs).select("shard", "shard_id", "lot", F.lit(1).alias("role"), "rid", "doc_id", "body")
    own = pairs.select(F.col("shard").alias("rid"), F.col("shard_id").alias("doc_id"), "lot").distinct()
    shards = met(own).select(F.col("rid").alias("shard"), F.col("doc_id").alias("shard_id"), "lot", F.lit(0).alias("role"), "rid", "doc_id", "body")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton, reference = None, None, None
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            bodies = _bytes(b.column("body"))
            places = zip(*(b.column(c).to_pylist() for c in ("shard", "shard_id", "lot")), strict=True)
            rows = zip(places, b.column("role").to_pylist(), b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), bodies, strict=True)
            for shard, role, rid, doc_id, text in rows:
                if shard != own:
                    own, automaton, reference = shard, None, None
                if role == 0:
                    reference = text
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton(words.split([reference or b""]).hashes.tolist())
                out += [(rid, doc_id, a, z) for a, z in automaton.spans(words.split([text]).hashes.tolist(), window)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["rid", "doc_id", "start", "stop"])
        automaton = reference = None
        common.tidy()

    spans = "rid long, doc_id long, start int, stop int"
    place = ["shard", "shard_id", "lot"]
    matched = shards.unionByName(streams).repartition(*place).sortWithinPartitions(*place, "role").mapInArrow(match, spans)
    matched = matched.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    # Windows over an anchor of many documents that no automaton has covered.
    many = hits.where(F.col("n") > few).groupBy("rid", "doc_id").agg(F.collect_set("h").alias("hs"))
    if leaders:
        matched = common.cut(matched)
        many = many.join(matched, ["rid", "doc_id"], "left")
    else:
        many = many.withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = _bytes(b.column("body"))
            rows = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "hs", "spans")), strict=True))
            for part, texts in words.chunks(rows, bodies, 1 << 18):
                w = words.split(texts)
                doc, at, h = _anchors(w, window, k)
                n = len(w.hashes) - window + 1
                if n <= 0:
                    continue
                wanted = np.zeros(len(at), bool)
                gone = np.zeros(len(w.hashes) + 1, np.int32)
                for i, (_, _, hs, covered) in enumerate(part):
                    a, z = np.searchsorted(doc, [i, i + 1])
                    wanted[a:z] = np.isin(h[a:z].view(np.int64), np.array(hs, np.int64))
                    for x in covered or ():
                        gone[w.first[i] + x["start"]] += 1
                        gone[w.first[i] + x["stop"] - window + 1] -= 1
                # Windows that hold a wanted anchor: starts from at - (window - k) to at.
                cover = np.zeros(len(w.hashes) + 1, np.int32)
                lo = np.maximum(at[wanted] - (window - k), 0)
                np.add.at(cover, lo, 1)
                np.add.at(cover, at[wanted] + 1, -1)
                owner = w.doc
                # A window that an automaton has matched needs no look; the first document that holds a window has
                # no match of it, so that one stays to be found.
                open_ = np.cumsum(gone)[:n] == 0
                starts = np.flatnonzero((np.cumsum(cover)[:n] > 0) & open_ & (owner[:n] == owner[window - 1 :]))
                if not len(starts):
                    continue
                one = words.long_runs(w.hashes, window)[starts]
                two = words.long_runs(w.hashes, window, words.BASE)[starts]
                own = owner[starts]
                ids = np.array([x[:2] for x in part], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[own, 0]), pa.array(ids[own, 1]), pa.array((starts - w.first[own]).astype(np.int32))],
                    names=["w1", "w2", "doc_id", "rid", "start"],
                )

    rows = met(many).mapInArrow(windows, "w1 long, w2 long, doc_id long, rid long, start int")
    lowest = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w1", "w2", "low")
    rest = rows.join(lowest, ["w1", "w2"]).where("doc_id > low").groupBy("rid", "doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + window).alias("stop"))).alias("spans"))
    every = matched.unionByName(rest).groupBy("rid", "doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    every = every.select("rid", "doc_id", F.array_sort(F.array_distinct("spans")).alias("spans"))
    # Of a copy all windows go: one span over its words, however many (shorter texts have no window).
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop")))
    return every.unionByName(whole.select("rid", "doc_id", all_.alias("spans")))


def _keep(parts: list[bytes], spans: list[dict] | None, window: int = WINDOW) -> list[bytes]:
    if not spans or len(parts) < window:
        return parts
    out, at = [], 0
    for s in spans:
        if s["start"] > at:
            out += parts[at : s["start"]]
        at = max(at, s["stop"])
    return out + parts[at:]


def _cut(text: str, spans: list[dict], window: int) -> str:
    parts = text.encode().split()
    return b" ".join(_keep(parts, spans, window)).decode() if len(parts) >= window else text


def _apply(df: DataFrame, schema, make, **kw) -> DataFrame:
    """make(spans) gives the iterator function; ``spans`` is the name of the column that holds them."""
    text = F.col("text").cast("string").cast("binary")
    rid, own, spans = (common.fresh(n, df.columns) for n in ("rid", "row_doc", "spans"))
    keyed = df.withColumns({rid: F.xxhash64(F.col("doc_id").cast("long"), text), own: F.col("doc_id").cast("long")})
    found = removed_spans(df, **kw).select(F.col("rid").alias(rid), F.col("doc_id").alias(own), F.col("spans").alias(spans))
    return keyed.join(found, [rid, own], "left").mapInArrow(make(spans), schema)


def dedup_substrings(df: DataFrame, **kw) -> DataFrame:
    """The rows of ``df`` with their columns; text keeps the words that stay, joined by single
    spaces, where any word goes, and is unchanged elsewhere. A document of which nothing is
    left keeps its row, with an empty text."""
    schema = df.schema
    names = df.columns
    at = names.index("text")
    window = kw.get("window", WINDOW)

    def make(spans: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = zip(b.column("text").to_pylist(), b.column(spans).to_pylist(), strict=True)
                texts = [_cut(t or "", s, window) if s else t for t, s in pairs]
                columns = [b.column(n) for n in names]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)
            common.tidy()

        return run

    return _apply(df, schema, make, **kw)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(spans: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t, s in zip(_bytes(b.column("body")), b.column(spans).to_pylist(), strict=True):
                    parts = t.split()
                    kept = _keep(parts, s)
                    out.append((len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            common.tidy()

        return run

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    own = _docs(docs)
    found = removed_spans(docs, leaders=False).withColumnRenamed("doc_id", "own_id")
    rows = own.join(found, ["rid", "own_id"], "left").select(F.col("own_id").alias("doc_id"), "body", "spans")
    none = docs.where("doc_id IS NULL").select("doc_id", F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("body"))
    made = make("spans")
    return rows.unionByName(none, allowMissingColumns=True).mapInArrow(made, "doc_id long, n_words long, n_removed long, kept_sha256 string")
