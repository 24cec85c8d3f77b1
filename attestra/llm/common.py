"""Helpers of the training-data operators: tables, shared storage, partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: the space and \t\n\v\f\r.
SPACE_RULE = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts may be long, and a batch is held several times over.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # unless set by the user
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one is set in local mode (tests)
    only: elsewhere a folder of one machine would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="attestra-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: columns, compressed, where a checkpoint holds plain rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a side that is broadcast.
FEW = 50_000


def sided(df: DataFrame, few: int = FEW) -> DataFrame:
    """A side of a join, marked for broadcast if its counted rows are few, else for a merge: Spark's own estimates
    don't see the rows that explode makes, nor those behind a checkpoint."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df.hint("merge")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy() -> None:
    """At the end of a Python task: gives free memory back, as the worker stays for the next task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def one_thread() -> None:
    """In a Python task: numpy's matrix products stay on the task's own core, as the others have tasks of their own."""
    import ctypes
    from pathlib import Path

    import numpy

    for path in (Path(numpy.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, with underscores until no column has it (in any case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def crc_mod(n: int, key: str = "doc_id"):
    """crc32(key as text) mod n."""
    return F.crc32(F.col(key).cast("string")) % F.lit(n)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
