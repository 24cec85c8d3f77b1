"""Quality classifier: document evidence under hierarchical empirical-Bayes priors.

A logistic model over hashed words and word beginnings and the shape of the text (case, punctuation, repetition)
gives each document a probability of being good: quality 1 and not toxic. It is fitted in
numpy on at most ``TRAIN_MOST`` labelled documents, chosen by a hash of their ids.

Sites have two levels: the host (``source``) and the path below it (``source`` and
``lang``). Grouped aggregation over all documents sums the document probabilities by path;
hosts shrink toward the global mean and paths toward their host by empirical-Bayes weights
(method of moments), so a site of few documents says little. The document's likelihood
ratio (its odds over the global odds) times the path's odds is its posterior; documents
under ``KEEP_FROM`` go.

Defined results: null and empty texts are rejected (score 0); null source or lang is a
site of its own; repeated rows stay and count each; labels of one document join to their
worst; without labels of both kinds nothing is known and every text with a word stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import common, words

TRAIN_MOST = 8_000
BITS = 18
KEEP_FROM = 0.5
#: Site tables up to so many rows are broadcast; beyond, they are joined.
SITES_MOST = 500_000
SHAPES = 8
U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature id of each distinct feature: hashed words, then shapes in 16 steps."""
    w = words.split(texts, words.NO_LETTERS, lower=True)
    n = len(texts)
    # Words, and their first four and five bytes, which inflected and compound forms share.
    prefix, hashes = np.zeros(len(w.starts), U), [w.hashes]
    for j in range(5):
        at = w.starts + j
        prefix = (prefix << U(8)) | np.where(at < w.ends, w.buf[np.minimum(at, len(w.buf) - 1)], 0).astype(U)
        if j >= 3:
            hashes.append(words.mix(prefix + U(j)))
    doc = np.tile(w.doc, len(hashes)).astype(U)
    key = np.unique((doc << U(BITS)) | (np.concatenate(hashes) >> U(64 - BITS)))
    owner, feature = (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)
    joined = np.frombuffer(b"".join(texts) or b" ", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.append(0, np.cumsum(size)[:-1]).clip(0, len(joined) - 1)
    some = np.maximum(size, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.where(size > 0, np.add.reduceat(flag.astype(np.int64), first), 0) / some

    count = np.diff(w.first)
    lengths = (w.ends - w.starts).astype(np.float64)
    distinct = np.bincount(owner, minlength=n) / 3
    same = np.bincount(w.doc[1:][(w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    lined = share(joined == 10)
    shapes = np.stack(
        [
            share((joined >= 65) & (joined <= 90)) * 2,
            share(words.NO_LETTERS[joined] & ~words.SPACES[joined]) * 4,
            share(words.SPACES[joined]) * 3,
            share((joined >= 48) & (joined <= 57)) * 4,
            distinct / np.maximum(np.sqrt(np.maximum(count, 1)) * 15, 1),
            same / np.maximum(count, 1) * 2,
            np.bincount(w.doc, lengths, minlength=n) / np.maximum(count, 1) / 16,
            lined * 10,
        ]
    )
    steps = np.minimum((shapes * 16).astype(np.int64), 15) + (1 << BITS) + 16 * np.arange(SHAPES)[:, None]
    owner = np.concatenate([owner, np.tile(np.arange(n), SHAPES)])
    feature = np.concatenate([feature, steps.ravel()])
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


def fit(rows: list[tuple[np.ndarray, int]], rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by full-batch Adam on the logistic loss; over the features that tell the kinds apart."""
    total = (1 << BITS) + 16 * SHAPES
    weights = np.zeros(total + 1)
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return weights
    feature = np.concatenate([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    # Words whose share differs between the kinds by 4 standard errors or more, in 4 texts or more; all shapes.
    n1 = y.sum()
    n0 = len(y) - n1
    seen, good = np.bincount(feature, minlength=total), np.bincount(feature, y[owner], minlength=total)
    p = seen / len(y)
    z = np.abs(good / n1 - (seen - good) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    often = (seen >= 4) & (z >= 4.0)
    often[1 << BITS :] = True
    keep = often[feature]
    feature, owner = feature[keep], owner[keep]
    used, feature = np.unique(feature, return_inverse=True)
    v, m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    v[-1] = math.log(y.mean() / (1 - y.mean()))
    for t in range(1, rounds + 1):
        z = np.bincount(owner, v[feature], minlength=len(y)) + v[-1]
        error = (1 / (1 + np.exp(-z.clip(-40, 40))) - y) / len(y)
        g = np.append(np.bincount(feature, error[owner], minlength=len(used)), error.sum())
        g[:-1] += l2 * v[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    weights[used], weights[-1] = v[:-1], v[-1]
    return weights


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> np.ndarray:
    """Fits on at most ``most`` labelled documents; gathers their feature ids, not their texts."""
    labelled = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    labelled = labelled.where("q IS NOT NULL OR t IS NOT NULL").select("doc_id", (F.coalesce(F.col("q"), F.lit(1)) > 0).alias("fine"), (F.coalesce(F.col("t"), F.lit(0)) > 0).alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", (F.col("fine") & ~F.col("toxic")).cast("int").alias("good"))
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, good = b.column("doc_id").to_pylist(), b.column("good").to_pylist()
            for at, texts in words.chunks(list(range(len(ids))), [x or b"" for x in b.column("body").to_pylist()]):
                owner, feature = features(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                found = [feature[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at]), pa.array([good[i] for i in at], pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "good", "f"])

    got = rows.mapInArrow(extract, "doc_id long, good int, f binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.good, r.f))
    return fit([(np.frombuffer(r.f, np.int32), r.good) for r in got])


def with_evidence(docs: DataFrame, weights: np.ndarray, carry: list[str]) -> DataFrame:
    """The columns ``carry`` plus __p, the document's own probability of being good (null without a word)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    src = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").cast("binary").alias("__body"))
    kinds = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    schema = type(kinds)([*kinds.fields]).add("__p", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            bodies = [x or b"" for x in b.column("__body").to_pylist()]
            p = np.zeros(len(bodies))
            none = np.ones(len(bodies), bool)
            for at, texts in words.chunks(list(range(len(bodies))), bodies):
                owner, feature = features(texts)
                z = np.bincount(owner, w[feature].astype(np.float64), minlength=len(texts)) + float(w[-1])
                p[at] = 1 / (1 + np.exp(-z.clip(-30, 30)))
                none[at] = [not t.strip() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(p, pa.float64(), mask=none)], names=[*carry, "__p"])
        common.tidy()

    return src.mapInArrow(score, schema)


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _path() -> Column:
    return F.concat_ws("/", _host(), F.coalesce(F.col("lang").cast("string"), F.lit("")))


def sampling_variance(mean: float, square: float) -> float:
    """Variance of one document's probability: of the probabilities themselves, which vary less than outcomes do."""
    return max(square - mean * mean, 0.0)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path and site_p: shrunk means of __p, path toward host toward all."""
    paths = scored.where("__p IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") * F.col("__p")).alias("s2"))
    paths = common.cut(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("s2").alias("hs2"))

    def strength(df: DataFrame, n: str, s: str, s2: str) -> tuple[float, float]:
        """Global mean, and the prior's weight in documents: m (1 - m) / variance between sites - 1, within [10, 10000]."""
        total = df.agg(F.sum(n), F.sum(s), F.sum(s2)).first()
        if not total[0]:
            return 0.5, 10.0
        m = min(max(total[1] / total[0], 1e-4), 1 - 1e-4)
        # Variance between sites, without what sampling alone gives.
        r = df.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - F.lit(m), 2)), F.count("*"), F.sum(n), F.sum(F.col(n) * F.col(n))).first()
        denominator = r[2] - r[3] / r[2]
        between = (r[0] - (r[1] - 1) * sampling_variance(m, total[2] / total[0])) / denominator if denominator > 0 else 0.0
        return m, min(max(m * (1 - m) / between - 1, 10.0), 10_000.0) if between > 0 else 10_000.0

    m, k_host = strength(hosts, "hn", "hs", "hs2")
    _, k_path = strength(paths, "n", "s", "s2")
    hosts = hosts.select("host", ((F.col("hs") + F.lit(k_host * m)) / (F.col("hn") + F.lit(k_host))).alias("host_p"))
    shrunk = (F.col("s") + F.lit(k_path) * F.col("host_p")) / (F.col("n") + F.lit(k_path))
    return paths.join(hosts, "host").select("path", "host_p", shrunk.alias("site_p"), F.lit(m).alias("all_p"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (F.lit(1.0) - p))


def judge(docs: DataFrame, labels: DataFrame, carry: list[str], most: int = TRAIN_MOST) -> DataFrame:
    """The columns ``carry`` as c0, c1, ... plus __p (own evidence), __site (the path's prior) and __q (the
    posterior): the user's names can't clash with those of the work."""
    weights = train(docs, labels, most)
    own = [f"c{i}" for i in range(len(carry))]
    placed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, own, strict=True)], F.col("text"), _host().alias("__host"), _path().alias("__path"))
    brief = with_evidence(placed, weights, ["__host", "__path"]).withColumnsRenamed({"__host": "host", "__path": "path"})
    sites = common.cut(site_posteriors(brief))
    if sites.count() <= SITES_MOST:
        sites = F.broadcast(sites)
    scored = with_evidence(placed, weights, [*own, "__path"]).join(sites.withColumnRenamed("path", "__path"), "__path", "left")
    posterior = _logit(F.col("__p")) - _logit(F.col("all_p")) + _logit(F.col("site_p"))
    q = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-posterior)), F.lit(0.0))
    return scored.select(*own, F.col("__p"), F.col("site_p").alias("__site"), q.alias("__q"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    kept = judge(docs, labels, docs.columns).where(F.col("__q") >= KEEP_FROM)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = judge(docs, common.table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select(F.col("c0").alias("doc_id"), F.col("__p").alias("document_p"), F.col("__site").alias("site_p"), F.col("__q").alias("quality_p"), (F.col("__q") >= KEEP_FROM).alias("keep"))
