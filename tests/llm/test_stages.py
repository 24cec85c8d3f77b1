"""Pipeline stages and queries over nulls, repeated rows, empty tables and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import media, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} other{i % 7}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, LONG, "en", "b"), (3, LONG + " end", "en", "a"), (3, LONG + " end", "en", "a"), (4, None, None, None), (5, "", "en", "a"), (None, LONG, "en", "a"), (None, None, None, None), (6, "short", "en", "c"), (7, "x" * 4000, "de", "a")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(["class_id", "h", "rid", "key", "body", "row", "band", "ids", "n_tokens", "decoded"])])


def test_near_dedup_stage(spark, sf, docs, odd):
    for df in (docs, odd):
        out = corpus_pipeline.near_dedup_stage(spark, df, sf)
        assert out.columns == df.columns
        kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert kept == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0), (True, 0)]  # rows without an id stay
    assert corpus_pipeline.near_dedup_stage(spark, docs.where("false"), sf).collect() == []


def test_bpe_stage(spark, sf, docs, odd):
    plain = corpus_pipeline.bpe_stage(spark, docs, sf)
    assert plain.columns == [*docs.columns, "n_tokens", "ids"]
    by = {(r.doc_id, r.text): (r.n_tokens, bytes(r.ids)) for r in plain.collect()}
    assert plain.count() == 10 and by[4, None] == by[5, ""] == (0, b"") and by[6, "short"][0] > 0 and all(4 * n == len(i) for n, i in by.values())
    out = corpus_pipeline.bpe_stage(spark, odd, sf)  # of its own names the result is what counts
    assert {(r.doc_id, r.text): (r.n_tokens, bytes(r.ids)) for r in out.collect()} == by and "class_id" in out.columns
    assert corpus_pipeline.bpe_stage(spark, docs.where("false"), sf).collect() == []


def test_quality_of_empty_and_repeated_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, 0, 1), (7, 0, 1), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    none = docs.where("false")
    assert quality.keep_good(none, labels).collect() == [] and quality.keep_good(none, labels.where("false")).columns == docs.columns
    twice = docs.unionByName(docs)
    kept = sorted(str((r.doc_id, r.text)) for r in quality.keep_good(twice, labels).collect())
    assert kept[::2] == kept[1::2]  # a repeated row is judged like the first
    assert not any(r.text is None for r in quality.keep_good(twice, labels).collect())


def test_media_of_an_empty_table(spark, tmp_path, docs):
    docs.where("false").write.parquet(f"file://{tmp_path}/empty/documents.parquet")
    assert media.op5_media(spark, f"file://{tmp_path}/empty").collect() == []
    docs.write.parquet(f"file://{tmp_path}/some/documents.parquet")
    got = media.op5_media(spark, f"file://{tmp_path}/some").collect()
    assert len(got) == 10 and {r.n_bytes for r in got if r.doc_id == 4} == {0} and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in got)
