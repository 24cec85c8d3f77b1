"""Language identification: multinomial naive Bayes over hashed character n-grams.

Two- and three-letter n-grams of the lower-cased text (runs of other ASCII than letters
count as one kind of gap) are hashed to 2^14 buckets. Counts of all training rows are
summed by language and bucket in the cluster; the matrix of log probabilities (languages
x 2^14 floats, whatever the size of the corpus) is broadcast, and numpy scores batches of
texts from their sparse n-gram codes.

The score is the posterior probability of the predicted language. Defined results: a text
that is null or has no letter is ``und`` with score 0; so is every text where nothing was
learned; ties go to the first language by name; repeated rows stay; other columns are
ignored; a null doc_id is no held-out row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm import common, words

BITS = 14
BUCKETS = 1 << BITS
U = np.uint64
LETTER = regex.compile(r"\p{L}")
#: ASCII but letters counts as a gap.
GAP = np.array([not chr(c).isalpha() for c in range(128)])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the two- and three-letter n-grams ending at each character, and where texts start.
    N-grams over a text's edge get the bucket BUCKETS, which weighs nothing."""
    lowered = [t.lower().replace("\0", " ") for t in texts]
    joined = "\0\0" + "\0\0".join(lowered) + "\0\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    edge = c == 0
    small = c < 128
    c[small] = np.where(GAP[c[small].astype(np.int64)], 32, c[small])
    with np.errstate(over="ignore"):
        two = c[:-1] * U(0x9E3779B97F4A7C15) + c[1:] * U(0xC2B2AE3D27D4EB4F)
        two ^= two >> U(29)
        three = two[:-1] * U(0x165667B19E3779F9) + c[2:] * U(0x27D4EB2F165667C5)
        three ^= three >> U(32)
        b2 = (two[1:] * U(0xD6E8FEB86659FD93) >> U(64 - BITS)).astype(np.int32)
        b3 = (three * U(0xA0761D6478BD642F) >> U(64 - BITS)).astype(np.int32)
    b2[edge[1:-1] | edge[2:]] = BUCKETS
    b3[edge[:-2] | edge[1:-1] | edge[2:]] = BUCKETS
    # A text's characters and the two marks before it are one stretch.
    first = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 2 for t in lowered[:-1]], out=first[1:])
    return b2, b3, first


def train(df: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (languages x BUCKETS + 1) and log priors from text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for part, some in words.chunks(langs, texts):
                b2, b3, first = codes(some)
                stretch = np.append(first, len(b2))
                names = sorted(set(part))
                label = np.repeat([names.index(x) for x in part], np.diff(stretch))
                n = np.zeros(len(names) * (BUCKETS + 1), np.int64)
                for codes_ in (b2, b3):
                    n += np.bincount(label * (BUCKETS + 1) + codes_, minlength=len(n))
                for name, row in zip(names, n.reshape(len(names), -1), strict=True):
                    kept = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    kept[:BUCKETS] += row[:BUCKETS]
                    kept[BUCKETS] += part.count(name)
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])

    rows = df.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x 2^14 rows at most
    langs = sorted(set(got["lang"]))
    table = np.zeros((len(langs), BUCKETS + 1))
    table[[langs.index(x) for x in got["lang"]], got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    docs = table[:, BUCKETS].copy()
    logs = np.log((table + 0.5) / (table[:, :BUCKETS].sum(1, keepdims=True) + 0.5 * BUCKETS))
    logs[:, BUCKETS] = 0
    return langs, logs.astype(np.float32), np.log((docs + 1) / (docs.sum() + len(langs))) if len(langs) else docs


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of df plus lang_pred and score (with underscores where kept ones have these names); reads text only."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema["row"]]).add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            there = [i for i, t in enumerate(texts) if t and langs and LETTER.search(t)]
            for at, some in words.chunks(there, [texts[i] for i in there]):
                b2, b3, first = codes(some)
                total = np.stack([np.add.reduceat(row[b2] + row[b3], first, dtype=np.float64) for row in logs]) + prior[:, None]
                best = total.argmax(0)
                p = 1 / np.exp(total - total.max(0)).sum(0)
                for i, k, s in zip(at, best.tolist(), p.tolist(), strict=True):
                    names[i], scores[i] = langs[k], s
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    made = [F.col(c).alias(common.fresh(c, keep)) for c in ("lang_pred", "score")]
    return src.mapInArrow(score, schema).select(*[F.col("row")[c].alias(c) for c in keep], *made)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(common.crc_mod(4) == 2, F.lit(False)))
    model = train(docs.where("NOT held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
