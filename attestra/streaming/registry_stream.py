"""Streams of clips against a keyed registry in the state store.

Each hash has its first arrival as value state (RocksDB, checkpointed with the query's offsets), so a
batch reads the states of its own hashes and nothing of earlier batches, a restart goes on from the last
commit, and a time to live bounds the state. The stream of new clips alone keeps less: duplicates are
dropped within a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "sha string, seq long, first_seq long, action string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstArrival(StatefulProcessor):
    """Known hashes hit their first arrival; of new ones the least ``seq`` of the batch is the first.

    Only the sequence numbers of one hash in one batch are held (8 bytes each), for a hash that fills a batch as well."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs = np.concatenate([b["seq"].to_numpy(np.int64) for b in rows])
        known = self.first.get()[0] if self.first.exists() else None
        first = int(seqs.min()) if known is None else int(known)
        if known is None:
            self.first.update((first,))
        fresh = np.zeros(len(seqs), bool)
        if known is None:
            fresh[int(seqs.argmin())] = True
        for a in range(0, len(seqs), 10_000):
            part = slice(a, a + 10_000)
            yield pd.DataFrame({"sha": key[0], "seq": seqs[part], "first_seq": first, "action": np.where(fresh[part], "miss", "exact_hit")})

    def close(self) -> None:
        pass


def triage_stream(clips: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """sha, seq, first_seq and action of a stream of (sha, seq). Rows without a hash are looked up as if they had one in common."""
    spark = clips.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # value state with a time to live needs it
    keyed = clips.select("sha", F.col("seq").cast("long").alias("seq"))
    return keyed.groupBy("sha").transformWithStateInPandas(FirstArrival(ttl_ms), OUT, "Append", "None" if ttl_ms is None else "ProcessingTime")


def new_clips(clips: DataFrame, time: str, delay: str) -> DataFrame:
    """The first row of each hash; a hash is forgotten once the watermark has passed it by ``delay``."""
    return clips.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there to Parquet, batch by batch, and ends. With the same checkpoint it goes on later."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_of(spark: SparkSession, folder: str, schema: str, files: int | None = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a batch, the oldest first; all that are there, if None."""
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)
