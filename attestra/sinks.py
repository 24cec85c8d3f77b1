"""Sinks: JSON records, tables as CSV and Markdown, logs, model tables. All write through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import evidence


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_records(df: DataFrame, path: str, key: str = "record_id") -> None:
    """Custody records: one folder an id, a row as pretty JSON in each."""
    body = F.to_json(F.struct(*[c for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(F.col(key).alias("id"), body.alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def pack_records(df: DataFrame, path: str, key: str = "record_id", mode: str = "append") -> None:
    """The same records in archives, one a task, which appear together when the write commits (data source ``packed``)."""
    body = F.to_json(F.struct(*[c for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(F.concat(F.col(key).cast("string"), F.lit("/record.json")).alias("name"), body.cast("binary").alias("content")).write.format("packed").mode(mode).save(path)


def cells(df: DataFrame) -> list[Column]:
    """Columns as text: numbers by the rules of evidence.format_cell."""
    return [evidence.format_cell(F.col(c)).alias(c) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]


def write_table(df: DataFrame, path: str) -> None:
    """A CSV table with formatted cells."""
    df.select(*cells(df)).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame) -> DataFrame:
    """line_no, line: a Markdown table, header first; rows keep no order but that of their text."""
    rows = df.select(F.concat(F.lit("| "), F.array_join(F.array(*[F.regexp_replace(c, r"\|", r"\\|") for c in cells(df)]), " | "), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "line_no int, line string")
    return head.unionByName(rows.select(F.lit(2).alias("line_no"), "line"))


def append_log(df: DataFrame, path: str) -> None:
    """Attempts of an acquisition: source, modality, method, status, bytes, reason."""
    df.write.mode("append").parquet(path)


def save_model(df: DataFrame, path: str) -> None:
    """A model as a table (no pickles): the rows are its coefficients, statistics and identity."""
    df.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
