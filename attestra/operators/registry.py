"""A stored registry of clips with keyed upsert: hash buckets, of which a write replaces only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestra.sources.versions import Versions


class StoredRegistry:
    """Rows of ``schema`` (or its DDL), one for each ``key``: that of the highest ``seq``.

    A bucket is a folder of Parquet files; the manifest names each bucket's folder. Readers keep the version they
    began with, as folders are never changed. Rows with a null key aren't kept; of equal ``seq`` the stored row
    stays, so that a repeated batch changes nothing; among equal ones of one batch the greatest row counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, seq: str, buckets: int = 64):
        self.spark, self.schema, self.key, self.seq, self.buckets = spark, schema, key, seq, buckets
        self.store = Versions(spark, path)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.store.full(f) for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(sorted(self.store.manifest(version).values()))

    def lookup(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """``rows`` that have the key column, with the registered columns beside theirs (null if unknown)."""
        return rows.join(self.read(version).withColumnRenamed(self.seq, f"known_{self.seq}"), self.key, "left")

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """Merges rows and gives the new version (the old one where nothing is to write). ``base`` is the version the
        writer has seen; if another one was committed since, the write fails and leaves nothing behind."""
        base = self.store.current() if base is None else base
        held = self.store.manifest(base)
        names = [f.name for f in self.read(0).schema]
        rest = F.struct(*names)
        fresh = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(rest, F.struct(F.col(self.seq), rest)).alias("r")).select("r.*")
        folder = self.store.new(f"v{base + 1}")
        draft = f"{folder}-batch"
        fresh.withColumn("bucket", self._bucket()).write.parquet(self.store.full(draft))  # read twice: which buckets, what rows
        try:
            batch = self.spark.read.parquet(self.store.full(draft))
            touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
            if not touched:
                return base
            old = self._load([held[str(b)] for b in touched if str(b) in held])
            both = old.select(*names, F.lit(1).alias("stored")).unionByName(batch.select(*names, F.lit(0).alias("stored")))
            best = both.groupBy(self.key).agg(F.max_by(rest, F.struct(F.col(self.seq), F.col("stored"))).alias("r")).select("r.*")
            best.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.store.full(folder))
            self.store.commit(base + 1, held | {str(b): f"{folder}/bucket={b}" for b in touched})
        except BaseException:
            self.store.drop([folder])
            raise
        finally:
            self.store.drop([draft])
        return base + 1
