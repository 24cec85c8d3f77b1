"""The log of an acquisition that can be broken off: attempts flushed from running tasks, and files adopted from disk.

The log is an index, not the truth: what is on disk counts as done even if its row was lost, and a part of the
log that can't be read loses its own rows only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Attempts of a task between two flushes.
FLUSH = 25


class LogPart:
    """One task's end of the log. ``folder`` is a path or URI that all executors and the driver reach."""

    def __init__(self, folder: str, every: int = FLUSH):
        self.folder, self.every, self.rows = folder, every, []

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        """A file of its own for each flush, under a hidden name until it is whole."""
        if not self.rows:
            return
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        files.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{base}/.{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in self.rows).encode())
        files.move(f"{base}/.{name}", f"{base}/attempts-{name}.json")
        self.rows = []


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all parts that can be read: one for each archive and member, a success before a failure."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)
    good = rows.where("_bad IS NULL AND archive IS NOT NULL AND member IS NOT NULL").drop("_bad")
    w = Window.partitionBy("archive", "member").orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), F.col("sha256"))
    return good.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def on_disk(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Attempt rows of wanted members (archive, member, place) whose file the listing (path, length) has, if it isn't
    empty. ``place`` is the end of the file's path."""
    have = listing.where("length > 0").select(F.col("path").alias("result"), F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("file"))
    met = wanted.withColumn("file", F.element_at(F.split("place", "/"), -1)).join(have, "file").where(F.expr("endswith(result, concat('/', place))"))
    return met.select("archive", "member", F.lit("ok").alias("status"), F.col("bytes").cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "result", F.lit("resumed_from_disk").alias("reason"))


def done(log: DataFrame, adopted: DataFrame) -> DataFrame:
    """What need not be fetched again: the log's successes, and files that it doesn't know."""
    ok = log.where("status = 'ok'")
    return ok.unionByName(adopted.join(ok.select("archive", "member"), ["archive", "member"], "left_anti"))
