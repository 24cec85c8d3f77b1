"""Acquisition end to end: pick, skip what is there, extract, sink, and an attempt row for each member.

Archives are remote ZIPs read by ranges, or local ones that Spark's readers open. Every task keeps one
handle; what fails stays as a row.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import acquisition, corpus
from attestra.sources import attempts, files
from attestra.sources.remote_zip import RangeFile

ATTEMPTS = "archive string, member string, status string, bytes long, sha256 string, result string, reason string"


def select_members(index: DataFrame, done: DataFrame, stratum: str, per: int, most_bytes: int, extensions: list[str] | None = None, match: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """index: archive, member, size and a stratum. Usable members by quota in hash order, without those in ``done``
    (archive, member): what an earlier run has counts toward the quota. With ``match``, members whose ``on`` it has
    (the same scene or speaker as what is picked already) fill the quota first."""
    usable = index.where(corpus.usable_file(F.col("member"), F.col("size"), most_bytes, extensions))
    key = acquisition.hash_key("archive", "member")
    if match is not None:
        usable = acquisition.match_first(usable, match, on)
        key = F.concat(F.col("priority").cast("string"), key)
    picked = acquisition.quota(usable, stratum, key, per)
    return picked.join(done.select("archive", "member"), ["archive", "member"], "left_anti")


def fetch_remote(wanted: DataFrame, sink: Callable[[str, str, bytes], str], tasks: int = 8, log: str | None = None) -> DataFrame:
    """wanted: archive (URL), member. Reads each member by ranges, one handle an archive and task, and passes it to
    sink(archive, member, data) where it was read; an attempt row for each, with the reason where it failed. With
    ``log`` (a shared folder) tasks flush their attempts as they go, so that a run that ends early can be resumed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [c.split()[0] for c in ATTEMPTS.split(", ")]
        part = attempts.LogPart(log) if log else None
        handles: dict[str, zipfile.ZipFile | Exception] = {}
        for b in batches:
            out = []
            for url, member in b[["archive", "member"]].itertuples(index=False):
                try:
                    if url not in handles:
                        try:
                            handles[url] = zipfile.ZipFile(RangeFile(url))
                        except Exception as e:  # told once an archive, kept for its other members
                            handles[url] = e
                    if isinstance(handles[url], Exception):
                        raise handles[url]
                    data = handles[url].read(member)
                    out.append((url, member, "ok", len(data), hashlib.sha256(data).hexdigest(), str(sink(url, member, data)), None))
                except Exception as e:  # kept as a row
                    out.append((url, member, "fail", 0, None, None, f"{type(e).__name__}: {e}"[:120]))
                if part is not None:
                    part.add(dict(zip(names, out[-1], strict=True)))
            yield pd.DataFrame(out, columns=names)
        if part is not None:
            part.flush()

    # One archive's members near each other: fewer handles, and blocks that are read once.
    return wanted.select("archive", "member").repartitionByRange(tasks, "archive", "member").sortWithinPartitions("archive", "member").mapInPandas(run, ATTEMPTS)


def resume(wanted: DataFrame, listing: DataFrame, log: str) -> tuple[DataFrame, DataFrame]:
    """What is done (attempt rows of the log, and files of the listing that it lacks) and the rest of ``wanted``
    (archive, member, place: the end of a fetched file's path). Failed attempts are tried again."""
    done = attempts.done(attempts.read_log(wanted.sparkSession, log, ATTEMPTS), attempts.on_disk(wanted, listing))
    done = done.join(wanted.select("archive", "member"), ["archive", "member"], "left_semi")
    return done, wanted.join(done.select("archive", "member"), ["archive", "member"], "left_anti")


def fetch_local(wanted: DataFrame, archives: DataFrame, sink: Callable[[str, str, bytes], str]) -> DataFrame:
    """As fetch_remote, from archives (archive, content) that Spark has read."""
    got = files.extract(archives, wanted)
    kept = files.sink(got, sink)
    return got.join(kept, ["archive", "member"], "left").select(
        "archive", "member", F.when(F.col("error").isNull(), "ok").otherwise("fail").alias("status"), F.coalesce(F.length("data"), F.lit(0)).cast("long").alias("bytes"),
        F.when(F.col("error").isNull(), F.sha2("data", 256)).alias("sha256"), "result", F.col("error").alias("reason"),
    )


def summary(attempts: DataFrame) -> DataFrame:
    """Per archive: members read and failed, bytes."""
    return attempts.groupBy("archive").agg(F.count_if(F.col("status") == "ok").alias("n"), F.count_if(F.col("status") == "fail").alias("failed"), F.sum("bytes").alias("bytes"))


def directory_manifest(listing: DataFrame, per_condition: int, fractions: list[tuple[str, float]]) -> DataFrame:
    """listing: path, length, sha256. Labels from the folders, ``per_condition`` files of each condition in hash order, and splits."""
    from attestra.sources.text import path_labels

    labelled = listing.withColumn("l", path_labels(F.col("path"))).select("path", "length", "sha256", "l.*")
    picked = acquisition.quota(labelled, "condition", acquisition.hash_key("subject", "file"), per_condition).drop("place")
    return acquisition.assign_splits(picked, "condition", acquisition.hash_key("subject", "file"), fractions)
