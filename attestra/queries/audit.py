"""Audit over documents and labels: a score from n_chars and doc_id against quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import audit as A
from attestra.operators import fusion as U
from attestra.queries import fusion as fusion_queries
from attestra.queries.base import query
from attestra.session import table

S = "s AS (SELECT doc_id AS id, (n_chars % 50 + 30 * quality) / 80.0 AS score, quality = 1 AS label, lang FROM documents JOIN labels USING (doc_id))"


def scores(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 50 + 30 * F.col("quality")) / F.lit(80.0)).alias("score"), (F.col("quality") == 1).alias("label"), "lang")


AUC = """r AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS rk FROM s),
 a AS (SELECT {g} AS g, CAST(count(*) FILTER (WHERE label) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT label) AS DOUBLE) AS q, CAST(sum(rk) FILTER (WHERE label) AS DOUBLE) AS r FROM r GROUP BY {g})"""


@query("roc_auc", f"WITH {S}, {AUC.format(g='lang')} SELECT g AS lang, round(CASE WHEN p * q = 0 THEN 0.5 ELSE (r - p * (p + 1) / 2) / (p * q) END, 6) AS auc FROM a")
def _(spark, d):
    return A.roc_auc(scores(spark, d), ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


@query("recall_at_fpr", f"WITH {S}, t AS (SELECT quantile_cont(CAST(score AS DOUBLE), 0.99) AS threshold FROM s WHERE NOT label) SELECT round(avg(CAST(score > threshold AS INTEGER)), 6) AS recall, round(max(threshold), 6) AS threshold FROM s, t WHERE label")
def _(spark, d):
    return A.recall_at_fpr(scores(spark, d), 0.01).select(F.round("recall", 6).alias("recall"), F.round("threshold", 6).alias("threshold"))


D = """d AS (SELECT id, score, label, sum(CAST(label AS INTEGER)) OVER w AS tp, sum(CAST(NOT label AS INTEGER)) OVER w AS fp, (SELECT count(*) FROM s WHERE label) AS p, (SELECT count(*) FROM s WHERE NOT label) AS q FROM s
 WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("eer", f"WITH {S}, {D}, e AS (SELECT *, fp / q AS far, 1.0 - tp / p AS frr FROM d) SELECT round((far + frr) / 2, 6) AS eer FROM e ORDER BY abs(far - frr), score DESC, id LIMIT 1")
def _(spark, d):
    return A.eer(scores(spark, d)).select(F.round("eer", 6).alias("eer"))


@query("roc_points", f"WITH {S}, {D} SELECT round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM d UNION ALL SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1.0::DOUBLE, 1.0::DOUBLE)) e")
def _(spark, d):
    return A.roc_points(scores(spark, d)).select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("pr_points", f"WITH {S}, {D} SELECT id, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM d")
def _(spark, d):
    return A.pr_points(scores(spark, d)).select("id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("ece", f"WITH {S}, b AS (SELECT greatest(ceil(CAST(score AS DOUBLE) * 10), 1) AS bin, count(*) AS n, avg(CAST(score AS DOUBLE)) AS c, avg(CAST(label AS INTEGER)) AS a FROM s GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def _(spark, d):
    return A.ece(scores(spark, d)).select(F.round("ece", 6).alias("ece"))


@query("reliability_bins", f"WITH {S} SELECT CAST(greatest(ceil(CAST(score AS DOUBLE) * 8), 1) AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(score AS DOUBLE)), 6) AS confidence, round(avg(CAST(label AS INTEGER)), 6) AS accuracy FROM s GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return A.reliability(scores(spark, d)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


TRUTH = "CASE WHEN quality = 0 AND toxic = 1 THEN 'BOTH_FAKE' WHEN quality = 0 THEN 'VIDEO_FAKE' WHEN toxic = 1 THEN 'AUDIO_FAKE' ELSE 'REAL' END"


def judged(spark, d):
    return fusion_queries.fused(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("truth", F.expr(TRUTH))


PIVOT = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS \"{v}\"" for v in U.VERDICTS)


@query("confusion_pivot", f"{fusion_queries.FUSED} SELECT {TRUTH} AS truth, {PIVOT} FROM f JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    return A.confusion(judged(spark, d).select("truth", "verdict"), "truth", "verdict", U.VERDICTS)


@query("accuracy_summary", f"""{fusion_queries.FUSED}, j AS (SELECT *, {TRUTH} AS truth FROM f JOIN labels USING (doc_id)) SELECT count(*) AS n, round(avg(CAST(verdict = truth AS INTEGER)), 6) AS accuracy,
 round(avg(CASE WHEN verdict <> 'UNKNOWN' THEN CAST(verdict = truth AS INTEGER) END), 6) AS decided_accuracy, round(avg(CAST(verdict = 'UNKNOWN' AS INTEGER)), 6) AS abstention FROM j""")
def _(spark, d):
    right, none = (F.col("verdict") == F.col("truth")).cast("double"), F.col("verdict") == "UNKNOWN"
    return judged(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.when(~none, right)), 6).alias("decided_accuracy"), F.round(F.avg(none.cast("double")), 6).alias("abstention"))


MARGINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


@query("risk_coverage", f"""{fusion_queries.FUSED}, j AS (SELECT top - second AS margin, (CASE WHEN p0 = top THEN 'REAL' WHEN p1 = top THEN 'VIDEO_FAKE' WHEN p2 = top THEN 'AUDIO_FAKE' ELSE 'BOTH_FAKE' END) = {TRUTH} AS correct FROM f JOIN labels USING (doc_id))
 SELECT CAST(least AS DOUBLE) AS least, round(avg(CAST(margin >= least AS INTEGER)), 6) AS coverage, round(avg(CASE WHEN margin >= least THEN 1 - CAST(correct AS INTEGER) END), 6) AS risk FROM j, (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in MARGINS)}]) AS least) GROUP BY least""")
def _(spark, d):
    best = F.element_at(F.array(*[F.lit(v) for v in U.VERDICTS[:4]]), F.array_position("post", F.array_max("post")).cast("int"))
    rows = judged(spark, d).select("margin", (best == F.col("truth")).alias("correct"))
    return A.risk_coverage(rows, MARGINS).select("least", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("c1_uniformity", """SELECT lang, field, n AS distinct_values, n <= 1 AS uniform FROM (SELECT lang, unnest([{'field': 'source', 'n': count(DISTINCT source) + max(CAST(source IS NULL AS INTEGER))}, {'field': 'lang_code', 'n': count(DISTINCT lang) + 0}]) AS x FROM documents GROUP BY lang), LATERAL (SELECT x.field AS field, CAST(x.n AS BIGINT) AS n)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.col("lang").alias("lang_code"))
    return A.uniformity(docs, ["source", "lang_code"], ["lang"])


@query("c2_leakage", """WITH f AS (SELECT doc_id AS id, quality = 1 AS label, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, quality = 1, 'doc_id', CAST(doc_id AS DOUBLE) FROM labels),
 r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0 AS rk FROM f),
 a AS (SELECT feature, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS q, sum(rk) FILTER (WHERE label) AS r FROM r GROUP BY feature),
 u AS (SELECT feature, CAST((r - p * (p + 1) / 2.0) / (p * q) AS DOUBLE) AS auc FROM a)
 SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, greatest(auc, 1 - auc) - 0.5 < 0.15 AS passed FROM u""")
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    chars = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id").select(F.col("doc_id").alias("id"), "label", F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("score"))
    ids = labels.select(F.col("doc_id").alias("id"), "label", F.lit("doc_id").alias("feature"), F.col("doc_id").cast("double").alias("score"))
    return A.leakage(chars.unionByName(ids)).select("feature", F.round("auc", 6).alias("auc"), "passed")


@query("c6_cross", f"WITH {S}, {AUC.format(g='lang')} SELECT g AS lang, CASE WHEN p * q = 0 THEN 0.5 ELSE (r - p * (p + 1) / 2) / (p * q) END > 0.62 + 0.05 AS passed FROM a")
def _(spark, d):
    return A.roc_auc(scores(spark, d), ["lang"]).select("lang", A.cross_dataset(F.col("auc"), F.lit(0.62)).alias("passed"))


def clips(spark, d):
    """Features of clips (embeddings), fake where the label is odd."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("label") % 2 == 1).alias("label"))


@query("c5_multiseed")
def _(spark, d):
    """The matched readout refitted under five seeds on 70 % of clips, scored on the others; passes with five usable ones."""
    return A.multiseed(clips(spark, d), list(range(5)))


@query("c3_floor")
def _(spark, d):
    """Real against real: the matched readout on arbitrary labels of real clips; the mean AUC of five splits must stay under 0.62."""
    return A.coherence_floor(clips(spark, d).where("NOT label"), list(range(5)))
