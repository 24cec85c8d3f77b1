"""User columns may have any name, those that operators use among themselves included."""

from pyspark.sql import functions as F

from attestra.llm import langid, rollup

TEXTS = [(1, "the quick brown fox", "en"), (2, "der schnelle braune fuchs", "de"), (3, None, "en"), (4, "", "de")]


def test_langid_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    model = langid.train(df)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model, ["doc_id"]).collect()}
    odd = df.select("doc_id", "text", F.lit("a").alias("__text"), F.lit("b").alias("row"), F.lit("c").alias("Score"), F.lit("d").alias("lang_pred"), F.lit("e").alias("a.b"))
    got = langid.predict(odd, model, ["doc_id", "text", "__text", "row", "Score", "lang_pred", "a.b"])
    assert got.columns == ["doc_id", "text", "__text", "row", "Score", "lang_pred", "a.b", "lang_pred_", "score_"]
    rows = got.collect()
    assert {r.doc_id: (r["lang_pred_"], r["score_"]) for r in rows} == plain and {tuple(r)[2:7] for r in rows} == {("a", "b", "c", "d", "e")}
    assert plain[3][0] == plain[4][0] == "und" and plain[1][0] == "en"


def test_token_counts_keep_columns_of_any_name(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    plain = {r.doc_id: (r[rollup.WORD], r[rollup.BYTE]) for r in rollup.token_counts(df, ["doc_id"]).collect()}
    odd = df.select("doc_id", "text", F.lit("a").alias("__text"), F.lit("b").alias("row"), F.lit("c").alias(rollup.WORD), F.lit("d").alias("words"))
    got = rollup.token_counts(odd, ["doc_id", "__text", "row", rollup.WORD, "words"])
    assert got.columns == ["doc_id", "__text", "row", rollup.WORD, "words", rollup.WORD + "_", rollup.BYTE]
    rows = got.collect()
    assert {r.doc_id: (r[rollup.WORD + "_"], r[rollup.BYTE]) for r in rows} == plain and {tuple(r)[1:5] for r in rows} == {("a", "b", "c", "d")}
    assert plain[3] == plain[4] == (0, 0) and plain[1][0] > 0
