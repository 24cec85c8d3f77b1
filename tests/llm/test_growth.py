"""What must not grow with the documents: sides that are broadcast, rows of one task."""

from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import bpe, common, minhash, rollup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_sides_are_not_broadcast(spark):
    rows, few = spark.range(1000).withColumn("k", F.col("id") % 7), spark.range(7).withColumnRenamed("id", "k")
    found = minhash._salted(rows, few, ["k"], "id")
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert found.count() == 1000


def test_sides_are_counted_before_they_are_broadcast(spark):
    left, right = spark.range(100), spark.range(90).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("id")).distinct()
    assert "Broadcast" in plan(left.join(common.sided(right, 90), "id")) and "Broadcast" not in plan(left.join(common.sided(right, 89), "id"))


def test_near_dedup_broadcasts_nothing_uncounted(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common.sided, "__defaults__", (0,))
    docs = spark.createDataFrame([(i, f"a text of many words that is the same in group number {i // 2} of all of them") for i in range(20)], "doc_id long, text string")
    found = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert "Broadcast" not in plan(found)
    assert {r.doc_id for r in found.collect()} == set(range(0, 20, 2))


def test_piece_sizes_are_those_of_the_encoder():
    encoder, size = bpe.tokenizer(bpe.default_path()), rollup.piece_sizes(bpe.default_path()).__getitem__
    for text in ("", "Some words, some 12,345 numbers", "straße ÉCOLE x" * 30, "日本語 \U0001f600 á"):
        assert sum(map(size, text.encode().split())) == len(encoder.encode(text))
