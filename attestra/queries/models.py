"""Models over embeddings: 64 features a clip, fake where the label is odd."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import models as M
from attestra.queries.base import query
from attestra.session import table

LONG = "l AS (SELECT vec_id, label % 2 = 1 AS fake, unnest(range(0, len(embedding))) AS j, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)"
STATS = "s AS (SELECT j, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-9 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM l GROUP BY j), z AS (SELECT vec_id, fake, l.j, x, (x - mean) / sd AS z FROM l JOIN s ON l.j = s.j)"


def long(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2 == 1).alias("fake"), "embedding")
    return M.exploded(e, "vec_id", "embedding", "fake")


def standard(spark, d):
    x = long(spark, d)
    return M.standardise(x, M.feature_stats(x))


@query("standardise", f"WITH {LONG}, {STATS} SELECT vec_id, CAST(j AS INTEGER) AS j, round(z, 6) AS z FROM z")
def _(spark, d):
    return standard(spark, d).select("vec_id", "j", F.round("z", 6).alias("z"))


@query("feature_stats", f"WITH {LONG}, {STATS} SELECT CAST(j AS INTEGER) AS j, round(mean, 6) AS mean, round(sd, 6) AS sd FROM s")
def _(spark, d):
    return M.feature_stats(long(spark, d)).select("j", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("class_stats", f"WITH {LONG} SELECT CAST(j AS INTEGER) AS j, round(avg(x) FILTER (WHERE NOT fake), 6) AS real_mean, round(stddev_pop(x) FILTER (WHERE NOT fake), 6) AS real_std, round(avg(x) FILTER (WHERE fake), 6) AS fake_mean FROM l GROUP BY j")
def _(spark, d):
    return M.class_stats(long(spark, d), "fake").select("j", *[F.round(c, 6).alias(c) for c in ("real_mean", "real_std", "fake_mean")])


DIST = f"WITH {LONG}, {STATS}, d AS (SELECT vec_id, sqrt(sum(z * z)) AS distance FROM z GROUP BY vec_id)"


@query("mahalanobis_diag", f"{DIST} SELECT vec_id, round(distance, 6) AS distance FROM d")
def _(spark, d):
    return M.diagonal_distance(standard(spark, d), "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("ood_percentile", f"""{DIST}, q AS (SELECT unnest(quantile_cont(distance, [{', '.join(str(i / 100) for i in range(101))}])) AS r FROM d), g AS (SELECT vec_id, distance, count(*) FILTER (WHERE round(r, 9) < round(distance, 9)) AS b FROM d, q GROUP BY vec_id, distance)
 SELECT vec_id, CAST(least(b, 100) AS INTEGER) AS ood_percentile, least(b, 100) >= 99 AS ood_flag FROM g""")
def _(spark, d):
    dist = M.diagonal_distance(standard(spark, d), "vec_id").withColumn("distance", F.round("distance", 9))
    return M.ood_percentile(dist, "distance", dist).select("vec_id", "ood_percentile", "ood_flag")


MEMBERS = "m AS (SELECT vec_id, list_transform(embedding[1:15], lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE) * 3))) AS p FROM embeddings)"


def members(spark, d):
    from attestra.functions import expressions as X

    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 15), lambda x: X.sigmoid(x.cast("double") * 3)).alias("p"))


@query("vacuity", f"WITH {MEMBERS}, s AS (SELECT vec_id, list_avg(p) AS m, greatest(list_var_pop(p), 1e-9) AS v FROM m) SELECT vec_id, round(m, 6) AS mean, round(sqrt(v), 6) AS sd, round(2 / (least(60.0, greatest(0.0, m * (1 - m) / v - 1)) + 2), 6) AS vacuity FROM s")
def _(spark, d):
    v = M.vacuity(F.col("p"))
    return members(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in v.items()])


WEIGHTS = "w AS (SELECT j, avg(z) FILTER (WHERE fake) - avg(z) FILTER (WHERE NOT fake) AS weight FROM z GROUP BY j), c AS (SELECT vec_id, z.j, z * weight AS contribution FROM z JOIN w ON z.j = w.j)"


def contributed(spark, d):
    z = standard(spark, d)
    w = z.groupBy("j").agg((F.avg(F.when(F.col("fake"), F.col("z"))) - F.avg(F.when(~F.col("fake"), F.col("z")))).alias("weight"))
    return M.contributions(z, w)


@query("contributions_topk", f"WITH {LONG}, {STATS}, {WEIGHTS} SELECT vec_id, CAST(j AS INTEGER) AS j, round(contribution, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(contribution), 9) DESC, j) AS rn FROM c) WHERE rn <= 4")
def _(spark, d):
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.round(F.abs("contribution"), 9)).alias("k"), "j", F.round("contribution", 6).alias("contribution")))), 1, 4)
    return contributed(spark, d).groupBy("vec_id").agg(top.alias("t")).select("vec_id", F.inline("t")).drop("k")


@query("feature_validity", "SELECT vec_id, len(embedding) = 64 AS available FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", M.valid_features(F.col("embedding"), 64).alias("available"))


@query("feature_covariance", f"WITH {LONG} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY a.j, b.j")
def _(spark, d):
    """Of all pairs of features, from sums of partitions: d x d numbers, whatever the rows."""
    _, s = M.covariance(vectors(spark, d), "v")
    return spark.createDataFrame([(i, j, round(float(x), 6)) for i, row in enumerate(s) for j, x in enumerate(row)], "i int, j int, cov double")


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("bagged_logistic")
def _(spark, d):
    return M.fit_bagged(M.scaled(vectors(spark, d), "v", "z"), "z", "y").select("member", F.size("coefs").alias("n"), F.round(F.element_at("coefs", -1), 4).alias("bias"))


@query("calibrated_predictions")
def _(spark, d):
    """Bagged fit on the standardised features of two thirds, Platt calibration on the other third, vacuity."""
    rows = M.scaled(vectors(spark, d), "v", "z").withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(3)) == 0)
    model = M.fit_bagged(rows.where("NOT held"), "z", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "coefs"))), lambda x: x["coefs"]).alias("coefs"))
    scored = rows.crossJoin(F.broadcast(model)).withColumn("members", M.member_probabilities(F.col("z"), F.col("coefs"))).drop("coefs")
    v = M.vacuity(F.col("members"))
    scored = scored.select("vec_id", "y", "held", v["mean"].alias("mean"), v["vacuity"].alias("vacuity"))
    ab = M.fit_platt(scored.where("held"), "mean", "y")
    return scored.crossJoin(F.broadcast(ab)).select("vec_id", F.round(M.platt(F.col("mean"), F.col("a"), F.col("b")), 6).alias("p_fake"), F.round("vacuity", 6).alias("vacuity"))


@query("mahalanobis_full")
def _(spark, d):
    rows = M.scaled(vectors(spark, d).select("vec_id", "v"), "v", "z")
    return M.mahalanobis(rows, "z").select("vec_id", F.round("distance", 6).alias("distance"))
