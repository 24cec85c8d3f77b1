"""What must not grow with the tables: sides that are broadcast, pairs that are gathered, files of one task."""

import random

from pyspark.sql import functions as F

from attestra.operators import audit, triage
from attestra.streaming import registry_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hashes(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 4)]
    out = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(8))) for b in base for _ in range(4)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


def test_hamming_pairs_come_once_without_gathering(spark):
    h = hashes(200, 1)
    df = spark.createDataFrame([(x,) for x in h], "h long")
    want = sorted((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in h for b in h if ((a ^ b) & (2**64 - 1)).bit_count() <= 6)
    for heavy in (20_000, 3):  # without and with crowded quarters
        found = triage.hamming_distinct(df, df, 6, heavy)
        assert sorted(map(tuple, found.collect())) == want
        if heavy > 3:
            assert "Broadcast" not in plan(found) and "Aggregate" not in plan(found)


def test_ids_of_several_hashes_have_a_pair_once(spark):
    left = spark.createDataFrame([(1, 0), (1, 3), (1, 0), (2, 5)], "id long, h long")
    found = triage.hamming_join(left, spark.createDataFrame([(9, 1), (9, 2)], "other long, h long"), 6)
    assert sorted(map(tuple, found.collect())) == [(1, 9, 1), (2, 9, 1), (2, 9, 3)]


def test_resamples_are_dealt_evenly_and_drawn_as_defined(spark):
    scores = spark.range(300).coalesce(1).select("id", (F.col("id") / 300).alias("score"), (F.col("id") % 2 == 0).alias("label"))
    drawn = audit._resampled(scores, 20, 1337)
    assert drawn.rdd.getNumPartitions() > 1  # one before
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("1337"), "b", "id")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    every = scores.crossJoin(spark.range(1, 21).withColumnRenamed("id", "b"))
    want = every.select("b", "id", sum(((u > F.lit(e)).cast("long") for e in audit.POISSON), F.lit(0)).alias("w")).where("w > 0")
    assert sorted(map(tuple, drawn.select("b", "id", "w").collect())) == sorted(map(tuple, want.collect()))


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path):
    for part in range(2):
        rows = spark.range(part * 10, part * 10 + 10, 1, 3).select(F.concat(F.lit("h"), F.col("id") % 4).alias("sha"), F.col("id").alias("seq"))
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = registry_stream.stream_of(spark, f"{tmp_path}/in", "sha string, seq long", None)
        registry_stream.run_available(registry_stream.triage_stream(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = spark.read.schema(registry_stream.OUT).parquet(f"{tmp_path}/out").collect()
    assert {(r.seq, r.first_seq, r.action) for r in found} == {(i, i % 4, "miss" if i < 4 else "exact_hit") for i in range(20)} and len(found) == 20
