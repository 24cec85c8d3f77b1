"""Micro-batch triage: an extension beyond the reference, which has no streams.

Each batch is looked up in the registry (a Parquet folder a batch id, so a repeated batch
replaces itself), then registered. Totals read all batches; the first arrival of a hash wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sha string, seq long, batch long"


def registered(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """First arrivals by hash among batches, those before ``before`` if given."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/*")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("sha").agg(F.min(F.struct("batch", "seq")).alias("m")).select("sha", "m.seq", "m.batch")


def triage_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """For ``writeStream.foreachBatch``: batch has sha and seq."""
    spark = batch.sparkSession
    fresh = batch.groupBy("sha").agg(F.min("seq").alias("seq")).join(registered(spark, path, batch_id).select("sha"), "sha", "left_anti")
    fresh.withColumn("batch", F.lit(batch_id).cast("long")).select("sha", "seq", "batch").write.mode("overwrite").parquet(f"{path}/b{batch_id}")


def start(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.foreachBatch(lambda df, i: triage_batch(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
