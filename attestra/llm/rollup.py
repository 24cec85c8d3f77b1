"""Token counts as delta-maintained rollups.

A store is a folder with one sub-folder a batch, which holds that batch's signed sums by
source, language and tokenizer version. Inserts add, deletes subtract, revised counts add
their difference. A batch is committed by its id: writing it is atomic (Spark's job commit
leaves _SUCCESS last), a batch that was committed is not written again, and one that broke
off is replaced, so repeats change nothing. Totals are sums over the committed batches alone;
``compact`` writes them as one batch to a new store, beside the ids that went into it, so a
batch that was committed before stays so. One writer at a time.

Tokenizer versions are those of public vocabularies: word-bpe (operator 8's encoder) and
byte-bpe (a byte-level vocabulary). Counts are of ids without special tokens.

Defined results: null source, language and version are groups of their own; a null text has
no tokens; repeated rows count each; groups that fall to no documents and no tokens are left out;
an empty batch changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm import bpe, common, lm

KEYS = ["source", "lang", "version"]
COMPACTED = "compacted"
#: Tokenizer versions.
WORD, BYTE = "word-bpe", "byte-bpe"
SUMS = "source string, lang string, version string, docs long, tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _batches(self) -> list[str]:
        """Folders of committed batches, one a commit since the last compaction."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return [n for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{n}/_SUCCESS")]

    def ids(self) -> list[str]:
        """Ids of all committed batches, compacted ones included."""
        own = [n.removeprefix("batch=") for n in self._batches()]
        if self._exists(f"{self.path}/ids/_SUCCESS"):
            own += [r["id"] for r in self.spark.read.parquet(f"{self.path}/ids").collect()]
        return sorted({x for x in own if x != COMPACTED})

    def committed(self, batch: str) -> bool:
        return batch in self.ids()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: source, lang, version, docs and tokens, signed. False if the batch was there."""
        if not re.fullmatch(r"[\w.-]+", batch) or batch == COMPACTED:
            raise ValueError(f"not an id of a batch: {batch!r}")
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        found = [f"{self.path}/{n}" for n in self._batches()]
        if not found:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).option("recursiveFileLookup", "true").parquet(*found)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self, to: str) -> TokenRollup:
        """A new store with the totals as one batch, and the ids of the batches in them."""
        to = to.rstrip("/")
        self.spark.createDataFrame([(x,) for x in self.ids()], "id string").write.mode("overwrite").parquet(f"{to}/ids")
        self.totals().write.mode("overwrite").parquet(f"{to}/batch={COMPACTED}")
        return TokenRollup(self.spark, to)


def inserted(df: DataFrame, version: str, count: str) -> DataFrame:
    return df.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), F.col(f"`{count}`").cast("long").alias("tokens"))


def deleted(df: DataFrame, version: str, count: str) -> DataFrame:
    return df.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).cast("long").alias("docs"), (-F.col(f"`{count}`")).cast("long").alias("tokens"))


def revised(df: DataFrame, version: str, before: str, now: str) -> DataFrame:
    return df.select("source", "lang", F.lit(version).alias("version"), F.lit(0).cast("long").alias("docs"), (F.col(f"`{now}`") - F.col(f"`{before}`")).cast("long").alias("tokens"))


def token_counts(docs: DataFrame, carry: list[str], word_path: str | None = None, byte_path: str | None = None) -> DataFrame:
    """The columns ``carry`` of docs plus :data:`WORD` and :data:`BYTE`: the number of ids of each whole text in either
    vocabulary (null: none). Where ``carry`` has such a name, the count gets underscores."""
    word_path, byte_path = word_path or bpe.default_path(), byte_path or lm.default_path()
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema["row"]]).add("words", "long").add("bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, bytes_ = piece_sizes(word_path).__getitem__, byte_encoding(byte_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            one = [sum(map(words_, t.encode().split())) for t in texts]
            two = [len(bytes_.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=schema.names)
        common.tidy()

    made = [F.col(c).alias(common.fresh(name, carry)) for c, name in (("words", WORD), ("bytes", BYTE))]
    return src.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in carry], *made)


_SIZES: dict[str, bpe.Generations] = {}


def piece_sizes(path: str) -> bpe.Generations:
    """The number of ids of a piece between ASCII white space, by operator 8's encoder; kept in a bounded cache."""
    if path not in _SIZES:
        encoder = bpe.tokenizer(path)
        _SIZES[path] = bpe.Generations(lambda piece: len(encoder.piece_ids(piece)) // 4, 4 * bpe.CACHE_MOST)
    return _SIZES[path]


_BYTES: dict[str, object] = {}


def byte_encoding(path: str):
    if path not in _BYTES:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in (line.split() for line in f if line.strip())}
        _BYTES[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BYTES[path]


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five commits over all documents: first counts estimated from n_chars, revision to the exact
    ones (committed twice), a second tokenizer version, deletion of toxic documents; then compaction
    into a new store, to which the last batch is offered once more."""
    docs = common.table(spark, sf_dir, "documents")
    guess = docs.withColumn("guess", F.floor(F.coalesce("n_chars", F.lit(0)) / 6))
    counted = common.cut(token_counts(guess, ["doc_id", "source", "lang", "guess"]))
    toxic = common.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi")
    store = TokenRollup(spark, common.shared_path(spark, "token-rollup"))
    store.commit("1-insert", inserted(counted, WORD, "guess"))
    for _ in range(2):
        store.commit("2-revise", revised(counted, WORD, "guess", WORD))
    store.commit("3-insert", inserted(counted, BYTE, BYTE))
    last = deleted(gone, WORD, WORD).unionByName(deleted(gone, BYTE, BYTE))
    store.commit("4-delete", last)
    store = store.compact(common.shared_path(spark, "token-rollup"))
    store.commit("4-delete", last)
    return store.totals()
