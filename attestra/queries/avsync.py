"""Audiovisual synchrony: hourly view and purchase values of all events as two activity curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators import sequences as Q
from attestra.queries.base import query
from attestra.session import table

#: Curves by user group; t counts hours from the first, gaps are 0.
CURVES = """h AS (SELECT user_id % 3 AS clip, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS hr, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS b FROM events GROUP BY 1, 2),
 lim AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h), g AS (SELECT c.clip, t FROM (SELECT unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS clip) c, (SELECT unnest(range(0, hi - lo + 1)) AS t FROM lim)),
 c AS (SELECT g.clip, g.t, coalesce(round(a, 6), 0) AS a, coalesce(round(b, 6), 0) AS b FROM g CROSS JOIN lim LEFT JOIN h ON h.clip = g.clip AND h.hr = lim.lo + g.t)"""


def curves(spark, d):
    e = table(spark, d, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    value = lambda kind: F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)), 6)
    h = e.groupBy((F.col("user_id") % 3).alias("clip"), hour.alias("hr")).agg(value("view").alias("a"), value("purchase").alias("b"))
    lim = e.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    grid = lim.select("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - F.col("lo"))).alias("t")).select("t", (F.col("lo") + F.col("t")).alias("hr"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("clip"))
    return grid.join(h, ["clip", "hr"], "left").select("clip", "t", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


XCORR = "x AS (SELECT l.clip, lag, CASE WHEN count(*) < 4 OR stddev_pop(l.a) <= 1e-12 OR stddev_pop(r.b) <= 1e-12 THEN 0 ELSE corr(l.a, r.b) END AS corr FROM (SELECT *, unnest(range(-12, 13)) AS lag FROM c) l JOIN c r ON r.clip = l.clip AND r.t = l.t + lag GROUP BY l.clip, lag)"


@query("xcorr_curve", f"WITH {CURVES}, {XCORR} SELECT clip, CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr FROM x")
def _(spark, d):
    return Q.cross_correlation(curves(spark, d), "clip", "t", "a", "b", 12).select("clip", "lag", F.round("corr", 6).alias("corr"))


@query("peak_lag", f"WITH {CURVES}, {XCORR} SELECT clip, round(max(corr), 6) AS peak, CAST((list(lag ORDER BY round(corr, 9) DESC, lag))[1] AS INTEGER) AS lag, round((max(corr) - avg(corr)) / CASE WHEN stddev_pop(corr) > 1e-12 THEN stddev_pop(corr) ELSE 1 END, 6) AS prominence, round(max(CASE WHEN lag = 0 THEN corr END), 6) AS at_zero FROM x GROUP BY clip")
def _(spark, d):
    p = Q.peak(Q.cross_correlation(curves(spark, d), "clip", "t", "a", "b", 12), "clip")
    return p.select("clip", F.round("peak", 6).alias("peak"), "lag", F.round("prominence", 6).alias("prominence"), F.round("at_zero", 6).alias("at_zero"))


WIN = "k AS (SELECT clip, max(t) + 1 AS n FROM c GROUP BY clip), s AS (SELECT clip, unnest(range(0, greatest(1, n - 25 + 1), 6)) AS start FROM k WHERE n >= 8), v AS (SELECT s.clip, s.start, c.t, a, b FROM s JOIN c ON c.clip = s.clip AND c.t >= s.start AND c.t < s.start + 25)"


@query("hopping_windows", f"WITH {CURVES}, {WIN} SELECT clip, start, count(*) AS n, round(sum(a), 6) AS total FROM v GROUP BY clip, start")
def _(spark, d):
    return Q.hopping(curves(spark, d), "clip", "t", 25, 6).groupBy("clip", "start").agg(F.count("*").alias("n"), F.round(F.sum("a"), 6).alias("total"))


LAGGED = f"{WIN}, wx AS (SELECT l.clip, l.start, lag, CASE WHEN count(*) < 4 OR stddev_pop(l.a) <= 1e-12 OR stddev_pop(r.b) <= 1e-12 THEN 0 ELSE corr(l.a, r.b) END AS corr FROM (SELECT *, unnest(range(-4, 5)) AS lag FROM v) l JOIN v r ON r.clip = l.clip AND r.start = l.start AND r.t = l.t + lag GROUP BY l.clip, l.start, lag), wp AS (SELECT clip, start, (list(lag ORDER BY round(corr, 9) DESC, lag))[1] AS lag, max(corr) AS corr FROM wx GROUP BY clip, start)"


def lagged(spark, d):
    w = Q.window_correlation(curves(spark, d), "clip", "t", "a", "b", 25, 6, 4)
    p = Q.peak(w.withColumn("key", F.struct("clip", "start")), "key")
    return p.select("key.clip", "key.start", "lag", F.col("peak").alias("corr"))


@query("window_lag_stats", f"WITH {CURVES}, {LAGGED} SELECT clip, count(*) AS windows, round(stddev_pop(lag), 6) AS lag_std, round(median(abs(lag)), 6) AS lag_median_abs, round(avg(CAST(abs(lag) > 2 AS INTEGER)), 6) AS desynced, round(avg(corr), 6) AS corr_mean, round(min(corr), 6) AS corr_min FROM wp GROUP BY clip")
def _(spark, d):
    return lagged(spark, d).groupBy("clip").agg(
        F.count("*").alias("windows"), F.round(F.stddev_pop("lag"), 6).alias("lag_std"), F.round(F.median(F.abs("lag")), 6).alias("lag_median_abs"), F.round(F.avg((F.abs("lag") > 2).cast("int")), 6).alias("desynced"), F.round(F.avg("corr"), 6).alias("corr_mean"), F.round(F.min("corr"), 6).alias("corr_min")
    )


@query("suspicious_intervals", f"""WITH {CURVES}, {LAGGED}, i AS (SELECT clip, CAST(start AS DOUBLE) AS s, CAST(start + 25 AS DOUBLE) AS e, corr, CAST(lag AS INTEGER) AS lag, CAST(abs(lag) AS DOUBLE) AS severity FROM wp WHERE abs(lag) > 2),
 m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY clip ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM i), n AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY s, e) AS isle FROM m)
 SELECT clip, min(s) AS start_s, max(e) AS end_s, round(min(corr), 6) AS corr, (list(lag ORDER BY abs(lag) DESC, s))[1] AS lag, max(severity) AS severity FROM n GROUP BY clip, isle""")
def _(spark, d):
    i = lagged(spark, d).where(F.abs("lag") > 2).select("clip", F.col("start").cast("double").alias("start_s"), (F.col("start") + 25).cast("double").alias("end_s"), "corr", "lag", F.abs("lag").cast("double").alias("severity"))
    return Q.merge_intervals(i, "clip").select("clip", "start_s", "end_s", F.round("corr", 6).alias("corr"), "lag", "severity")


@query("mutual_information", f"""WITH {CURVES}, r AS (SELECT clip, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, count(*) AS n FROM c GROUP BY clip), q AS (SELECT c.clip, n, least(floor((a - a0) / (a1 - a0) * 8), 7) AS i, least(floor((b - b0) / (b1 - b0) * 8), 7) AS j FROM c JOIN r ON r.clip = c.clip),
 x AS (SELECT clip, i, j, max(n) AS n, count(*) AS k FROM q GROUP BY clip, i, j), y AS (SELECT *, sum(k) OVER (PARTITION BY clip, i) AS ki, sum(k) OVER (PARTITION BY clip, j) AS kj FROM x) SELECT clip, round(sum(k / n * log2(k * n / (ki * kj))), 6) AS mi FROM y GROUP BY clip""")
def _(spark, d):
    return Q.mutual_information(curves(spark, d), "clip", "a", "b").select("clip", F.round("mi", 6).alias("mi"))


@query("asof_interp", f"""WITH {CURVES}, p AS (SELECT clip, CAST(t * 4 AS DOUBLE) AS t, a FROM c), q AS (SELECT clip, CAST(t * 3 + 1 AS DOUBLE) AS t FROM c), j AS (SELECT q.clip, q.t, max(p.t) FILTER (WHERE p.t <= q.t) AS t0, min(p.t) FILTER (WHERE p.t >= q.t) AS t1 FROM q JOIN p ON p.clip = q.clip GROUP BY q.clip, q.t)
 SELECT j.clip, j.t, round(CASE WHEN t0 IS NULL THEN y.a WHEN t1 IS NULL OR t1 = t0 THEN x.a ELSE x.a + (y.a - x.a) * (j.t - t0) / (t1 - t0) END, 6) AS x FROM j LEFT JOIN p x ON x.clip = j.clip AND x.t = t0 LEFT JOIN p y ON y.clip = j.clip AND y.t = t1""")
def _(spark, d):
    c = curves(spark, d)
    points = c.select("clip", (F.col("t") * 4).cast("double").alias("t"), F.col("a").alias("x"))
    return Q.interpolate(points, c.select("clip", (F.col("t") * 3 + 1).cast("double").alias("t")), "clip", "t", "x").select("clip", "t", F.round("x", 6).alias("x"))


RUNS = "f AS (SELECT clip, t, a, a > 100 AS voiced, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS pos FROM c), u AS (SELECT *, pos - sum(CAST(voiced AS INTEGER)) OVER (PARTITION BY clip ORDER BY t) AS isle FROM f)"


@query("voiced_runs", f"WITH {CURVES}, {RUNS} SELECT clip, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop, count(*) AS length FROM u WHERE voiced GROUP BY clip, isle")
def _(spark, d):
    return Q.runs(curves(spark, d).withColumn("voiced", F.col("a") > 100), "clip", "t", "voiced").select("clip", "start", "stop", "length")


@query("run_jitter", f"WITH {CURVES}, {RUNS}, j AS (SELECT clip, isle, a, lag(a) OVER (PARTITION BY clip, isle ORDER BY t) AS p, count(*) OVER (PARTITION BY clip, isle) AS n FROM u WHERE voiced), r AS (SELECT clip, isle, avg(abs(a - p)) / nullif(avg(a), 0) AS jit FROM j WHERE n >= 3 GROUP BY clip, isle) SELECT clip, round(avg(jit), 6) AS jitter FROM r GROUP BY clip")
def _(spark, d):
    from pyspark.sql import Window

    c = curves(spark, d)
    w = Q.over("clip", "t")
    f = c.withColumn("voiced", F.col("a") > 100).withColumn("isle", F.row_number().over(w) - F.sum((F.col("a") > 100).cast("int")).over(w)).where("voiced")
    f = f.withColumns({"p": F.lag("a").over(Window.partitionBy("clip", "isle").orderBy("t")), "n": F.count("*").over(Window.partitionBy("clip", "isle"))}).where("n >= 3")
    return f.groupBy("clip", "isle").agg(X.ratio(F.avg(F.abs(F.col("a") - F.col("p"))), F.avg("a")).alias("j")).groupBy("clip").agg(F.round(F.avg("j"), 6).alias("jitter"))


@query("envelope_corr", f"WITH {CURVES} SELECT clip, CASE WHEN stddev_pop(a) <= 1e-12 OR stddev_pop(b) <= 1e-12 THEN 0 ELSE round(corr(a, b), 6) END AS corr FROM c GROUP BY clip")
def _(spark, d):
    return curves(spark, d).groupBy("clip").agg(F.round(X.correlation("a", "b"), 6).alias("corr"))


@query("time_shift", f"WITH {CURVES} SELECT clip, t, coalesce(lag(a, 3) OVER (PARTITION BY clip ORDER BY t), 0) AS shifted FROM c")
def _(spark, d):
    return curves(spark, d).select("clip", "t", F.lag("a", 3, 0.0).over(Q.over("clip", "t")).alias("shifted"))
