"""Hash chains: a linear fold over sorted partitions, and chains in a store that are appended to.

A fold carries the last hash of a chain from row to row and across Arrow batches, so a chain of any
length takes constant memory; chains are independent, one chain is one task (its order demands it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.versions import Conflict, Versions

#: Fixed value: the hash before a chain's first entry.
GENESIS = "0" * 64


class StaleHead(RuntimeError):
    """The chains have grown since the writer saw them."""


def fold(rows: DataFrame, chain: str, seq: str, body: str, heads: DataFrame | None = None) -> DataFrame:
    """chain, index, prev_hash, payload, entry_hash of ``rows`` in order of ``seq`` (then body), going on from
    ``heads`` (chain, length, head). An entry's hash is over index, previous hash and payload, joined by ``|``. Null
    bodies are empty; rows of a null chain are a chain of their own, which heads can't name."""
    kind = rows.schema[chain].dataType.simpleString()
    entries = rows.select(F.col(chain).alias("chain"), F.col(seq).alias("seq"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    if heads is None:
        entries = entries.select("*", F.lit(0).cast("long").alias("length"), F.lit(GENESIS).alias("head"))
    else:
        known = heads.select(F.col(chain).alias("chain"), "length", "head")
        entries = entries.join(known, "chain", "left").withColumns({"length": F.coalesce("length", F.lit(0)).cast("long"), "head": F.coalesce("head", F.lit(GENESIS))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        at, prev = 0, GENESIS
        for b in batches:
            chains, bodies = b.column("chain").to_pylist(), b.column("body").to_pylist()
            lengths, tops = b.column("length"), b.column("head")
            index, before, after = [], [], []
            for i, c in enumerate(chains):
                if (c,) != last:
                    last, at, prev = (c,), lengths[i].as_py(), tops[i].as_py()
                index.append(at)
                before.append(prev)
                prev = hashlib.sha256(f"{at}|{prev}|{bodies[i]}".encode()).hexdigest()
                after.append(prev)
                at += 1
            yield pa.RecordBatch.from_arrays([b.column("chain"), pa.array(index, pa.int64()), pa.array(before, pa.string()), b.column("body"), pa.array(after, pa.string())], names=["chain", "index", "prev_hash", "payload", "entry_hash"])

    ordered = entries.repartition("chain").sortWithinPartitions("chain", "seq", "body").select("chain", "body", "length", "head")
    return ordered.mapInArrow(run, f"chain {kind}, index long, prev_hash string, payload string, entry_hash string").withColumnRenamed("chain", chain)


class StoredLedger:
    """Chains in a folder: entries by version, and a table of heads (chain, length, head) for each version."""

    def __init__(self, spark: SparkSession, path: str, chain: str = "chain", kind: str = "long"):
        self.spark, self.chain, self.kind = spark, chain, kind
        self.store = Versions(spark, path)

    def version(self) -> int:
        return self.store.current()

    def read(self, version: int | None = None) -> DataFrame:
        folders = self.store.manifest(version).get("entries", [])
        schema = f"{self.chain} {self.kind}, index long, prev_hash string, payload string, entry_hash string"
        return self.spark.read.schema(schema).parquet(*[self.store.full(f) for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def heads(self, version: int | None = None) -> DataFrame:
        folder = self.store.manifest(version).get("heads")
        schema = f"{self.chain} {self.kind}, length long, head string"
        return self.spark.read.schema(schema).parquet(self.store.full(folder)) if folder else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, seq: str, body: str, seen: int | None = None) -> int:
        """Appends rows (chain, ``seq``, ``body``) and gives the new version. ``seen`` is the version whose heads the
        writer goes on from (the current one by default): if the chains have grown since, :class:`StaleHead` is
        raised and nothing stays. Rows of a null chain are refused."""
        seen = self.store.current() if seen is None else seen
        if self.store.current() != seen:
            raise StaleHead(f"version {self.store.current()}, not {seen}")
        held = self.store.manifest(seen)
        new, tops = self.store.new(f"entries-v{seen + 1}"), self.store.new(f"heads-v{seen + 1}")
        try:
            checked = rows.withColumn(self.chain, F.when(F.col(self.chain).isNull(), F.raise_error(F.lit("an entry needs a chain")).cast(self.kind)).otherwise(F.col(self.chain)))
            fold(checked, self.chain, seq, body, self.heads(seen)).write.parquet(self.store.full(new))
            added = self.spark.read.parquet(self.store.full(new)).groupBy(self.chain).agg(F.max("index").alias("i"), F.max_by("entry_hash", "index").alias("head"))
            added = added.select(self.chain, (F.col("i") + 1).alias("length"), "head")
            every = self.heads(seen).unionByName(added).groupBy(self.chain).agg(F.max("length").alias("length"), F.max_by("head", "length").alias("head"))
            every.write.parquet(self.store.full(tops))
            self.store.commit(seen + 1, {"entries": [*held.get("entries", []), new], "heads": tops})
        except BaseException as e:
            self.store.drop([new, tops])
            if isinstance(e, Conflict):
                raise StaleHead(str(e)) from e
            raise
        return seen + 1
