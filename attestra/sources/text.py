"""Text sources and sinks: protocol files, CSV manifests with a banner, JSONL ledgers, path labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.session import cut

LEDGER = "index long, prev_hash string, payload string, entry_hash string"


def parse_protocol(lines: DataFrame, column: str = "value") -> DataFrame:
    """speaker, utt_id, attack, label of lines with five tokens or more; others are dropped."""
    t = lines.select(F.split(F.trim(F.col(column)), r"\s+").alias("t")).where(F.size("t") >= 5)
    return t.select(*[F.col("t")[i].alias(n) for i, n in ((0, "speaker"), (1, "utt_id"), (3, "attack"), (4, "label"))])


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; lines that begin with # are a banner. Arrays are JSON strings: see :func:`json_list`."""
    return spark.read.csv(path, header=True, comment="#", schema=schema, escape='"')


def write_manifest(df: DataFrame, path: str) -> None:
    """Arrays become JSON; the banner belongs beside the data, as part files have no single head."""
    kinds = dict(df.dtypes)
    df.select(*[F.to_json(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def json_list(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their line (pos, from 0) in order of file name and place; blank lines are skipped. Files are read
    in splits: each numbers its own lines, and a row a split carries the lines before it."""
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col(place[0]).alias("file"), F.col(place[1]).alias("at"), F.monotonically_increasing_id().alias("id"))
    lines = cut(lines, "ledger-lines")  # ids hold for one reading
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    ahead = lines.groupBy("file", "at").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = lines.join(ahead, ["file", "at"]).withColumn("pos", F.col("ahead") + F.row_number().over(Window.partitionBy("file", "at").orderBy("id")) - 1)
    return numbered.where(F.trim("line") != "").select("pos", F.from_json("line", LEDGER).alias("e")).select("pos", "e.*")


def write_ledger(df: DataFrame, path: str, chain: str | None = None) -> None:
    """Entries as compact JSON lines, in files whose names keep a chain's order; with ``chain`` each chain gets a folder
    and file of its own."""
    line = F.to_json(F.struct("index", "prev_hash", "payload", "entry_hash")).alias("value")
    if chain is None:
        df.orderBy("index").select(line).write.mode("overwrite").text(path)
    else:
        df.repartition(chain).sortWithinPartitions(chain, "index").select(F.col(chain).alias("chain"), line).write.mode("overwrite").partitionBy("chain").text(path)


def path_labels(path: Column) -> Column:
    """Labels from the last four folders: condition, group, subject and file; e.g. RealVideo-FakeAudio/..."""
    parts = F.split(path, "/")
    condition = F.element_at(parts, -4)
    return F.struct(
        condition.alias("condition"), F.element_at(parts, -3).alias("group"), F.element_at(parts, -2).alias("subject"), F.element_at(parts, -1).alias("file"),
        F.when(condition.startswith("Fake"), "fake").otherwise("real").alias("label_video"), F.when(condition.endswith("FakeAudio"), "fake").otherwise("real").alias("label_audio"),
    )


PROBE = """struct<format:struct<format_name:string,duration:string,size:string,bit_rate:string,tags:map<string,string>>,
 streams:array<struct<codec_type:string,codec_name:string,width:string,height:string,pix_fmt:string,avg_frame_rate:string,nb_frames:string,bit_rate:string,sample_rate:string,channels:string>>>"""


def probe_summary(probe_json: Column) -> list[Column]:
    """The fixed projection of a container probe; casts that fail give null."""
    p = F.from_json(probe_json, PROBE)
    of = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = of("video"), of("audio")
    rate = F.split(v["avg_frame_rate"], "/")
    fps = F.round(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))), 6)
    return [
        p["format"]["format_name"].alias("container"), p["format"]["duration"].try_cast("double").alias("duration_s"), p["format"]["size"].try_cast("bigint").alias("size_bytes"),
        p["format"]["bit_rate"].try_cast("bigint").alias("bit_rate"), F.coalesce(F.size(p["streams"]), F.lit(0)).alias("n_streams"), v["codec_name"].alias("video_codec"),
        v["width"].try_cast("int").alias("width"), v["height"].try_cast("int").alias("height"), v["pix_fmt"].alias("pix_fmt"), fps.alias("avg_frame_rate"), v["nb_frames"].try_cast("int").alias("nb_frames"),
        v["bit_rate"].try_cast("bigint").alias("video_bit_rate"), a.isNotNull().alias("has_audio"), a["codec_name"].alias("audio_codec"), a["sample_rate"].try_cast("int").alias("sample_rate"),
        a["channels"].try_cast("int").alias("channels"), a["bit_rate"].try_cast("bigint").alias("audio_bit_rate"), p["format"]["tags"].alias("tags"),
    ]
