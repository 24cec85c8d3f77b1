"""Feature analogues in SQL over embeddings and events, and the numeric kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators import seal
from attestra.operators import sequences as Q
from attestra.operators import tier0
from attestra.queries.base import query
from attestra.session import table


def vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query("quick_stats", f"""WITH {E} SELECT vec_id, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 6) AS a_rms, round(list_max(list_transform(v, lambda x: abs(x))) / sqrt(list_avg(list_transform(v, lambda x: x * x))), 6) AS a_crest,
 round(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (v[i] < 0) <> (v[i + 1] < 0) THEN 1.0 ELSE 0.0 END)) / 63, 6) AS a_zcr, round(list_avg(list_transform(v, lambda x: CASE WHEN abs(x) < 0.1 THEN 1.0 ELSE 0.0 END)), 6) AS a_silence_frac FROM e""")
def _(spark, d):
    return vec(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in tier0.quick_stats(F.col("v")).items()])


SERIES = "s AS (SELECT user_id AS clip, event_id AS t, round(value, 6) AS x FROM events)"


def series(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("t"), F.round("value", 6).alias("x"))


@query("motion_smoothness", f"WITH {SERIES}, l AS (SELECT clip, x, abs(x - lag(x) OVER (PARTITION BY clip ORDER BY t)) AS st FROM s) SELECT clip, round(avg(st) / CASE WHEN abs(avg(x)) > 1e-12 THEN avg(x) ELSE 1 END, 6) AS smoothness FROM l GROUP BY clip")
def _(spark, d):
    return Q.smoothness(series(spark, d), "clip", "t", "x").select("clip", F.round("smoothness", 6).alias("smoothness"))


@query("entropy_hist", "WITH g AS (SELECT user_id AS clip, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT clip, n / sum(n) OVER (PARTITION BY clip) AS p FROM g) SELECT clip, round(sum(-p * log2(p)) / log2(5), 6) AS entropy FROM p GROUP BY clip")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), "event_type")
    return Q.entropy(e, "clip", "event_type", 5).select("clip", F.round("entropy", 6).alias("entropy"))


@query("grid_dispersion", f"WITH {E}, l AS (SELECT vec_id, (i - 1) // 8 AS cell, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM e)), c AS (SELECT vec_id, cell, avg(abs(x)) AS m FROM l GROUP BY 1, 2) SELECT vec_id, round(min(m) / median(m), 6) AS min_ratio, round(stddev_pop(m) / median(m), 6) AS dispersion FROM c GROUP BY vec_id")
def _(spark, d):
    cells = vec(spark, d).select("vec_id", F.posexplode("v").alias("i", "x")).groupBy("vec_id", F.floor(F.col("i") / 8).alias("cell")).agg(F.avg(F.abs("x")).alias("m"))
    return cells.groupBy("vec_id").agg(F.round(X.ratio(F.min("m"), F.median("m")), 6).alias("min_ratio"), F.round(X.ratio(F.stddev_pop("m"), F.median("m")), 6).alias("dispersion"))


PAD = """p AS (SELECT clip, t, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY clip) AS n, first_value(x) OVER w AS f, last_value(x) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 sum(x) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM s WINDOW w AS (PARTITION BY clip ORDER BY t)), a AS (SELECT clip, t, x, (sm + greatest(3 - i, 0) * f + greatest(i + 2 - n, 0) * l) / 5 AS ma FROM p)"""


@query("moving_average", f"WITH {SERIES}, {PAD} SELECT clip, t, round(ma, 6) AS ma FROM a")
def _(spark, d):
    return Q.moving_average(series(spark, d), "clip", "t", "x", 5, "ma").select("clip", "t", F.round("ma", 6).alias("ma"))


@query("flicker", f"WITH {SERIES}, {PAD} SELECT clip, round(stddev_pop(x - ma) / nullif(avg(x), 0), 6) AS flicker FROM a GROUP BY clip")
def _(spark, d):
    return Q.moving_average(series(spark, d), "clip", "t", "x", 5, "ma").groupBy("clip").agg(F.round(X.ratio(F.stddev_pop(F.col("x") - F.col("ma")), F.avg("x")), 6).alias("flicker"))


@query("second_order", f"WITH {SERIES}, l AS (SELECT clip, lead(x) OVER w - x AS d1, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d2 FROM s WINDOW w AS (PARTITION BY clip ORDER BY t)) SELECT clip, round(avg(abs(d2)), 6) AS second_mean, round(avg(abs(d2)) / nullif(avg(abs(d1)), 0), 6) AS second_ratio FROM l GROUP BY clip")
def _(spark, d):
    x = Q.differences(series(spark, d), "clip", "t", "x").groupBy("clip").agg(F.avg(F.abs("d2")).alias("a"), F.avg(F.abs("d1")).alias("b"))
    return x.select("clip", F.round("a", 6).alias("second_mean"), F.round(X.ratio("a", "b"), 6).alias("second_ratio"))


@query("lag1_autocorr", f"WITH {SERIES}, l AS (SELECT clip, x, lag(x) OVER (PARTITION BY clip ORDER BY t) AS y FROM s) SELECT clip, CASE WHEN stddev_pop(CASE WHEN y IS NOT NULL THEN x END) <= 1e-12 OR stddev_pop(y) <= 1e-12 THEN 0 ELSE round(corr(x, y), 6) END AS autocorr FROM l GROUP BY clip")
def _(spark, d):
    x = series(spark, d).withColumn("y", F.lag("x").over(Q.over("clip", "t"))).where("y IS NOT NULL")
    return x.groupBy("clip").agg(F.round(X.correlation("x", "y"), 6).alias("autocorr"))


@query("kurtosis_residual", f"WITH {SERIES} SELECT clip, CASE WHEN stddev_pop(x) > 1e-12 THEN round(kurtosis_pop(x), 5) ELSE 0 END AS kurtosis FROM s GROUP BY clip")
def _(spark, d):
    return series(spark, d).groupBy("clip").agg(F.when(F.stddev_pop("x") > 1e-12, F.round(F.kurtosis("x"), 5)).otherwise(F.lit(0.0)).alias("kurtosis"))


@query("selfsim_decay", f"""WITH {E}, c AS (SELECT vec_id // 20 AS clip, vec_id % 20 AS t, v FROM e), p AS (SELECT a.clip, CAST(b.t - a.t AS DOUBLE) AS gap, list_cosine_similarity(a.v, b.v) AS cs FROM c a JOIN c b ON a.clip = b.clip AND b.t - a.t >= 2)
 SELECT clip, count(*) AS pairs, round(avg(cs), 6) AS mean_cos, round(regr_slope(cs, gap), 6) AS slope FROM p GROUP BY clip""")
def _(spark, d):
    c = vec(spark, d).select(F.floor(F.col("vec_id") / 20).alias("clip"), (F.col("vec_id") % 20).alias("t"), "v")
    return Q.self_similarity(c, "clip", "t", "v").select("clip", "pairs", F.round("mean_cos", 6).alias("mean_cos"), F.round("slope", 6).alias("slope"))


@query("selfsim_entropy", f"""WITH {E}, c AS (SELECT vec_id // 40 AS clip, vec_id % 40 AS t, v FROM e), p AS (SELECT a.clip, least(floor((round(list_cosine_similarity(a.v, b.v), 12) + 1) * 8), 15) AS bin FROM c a JOIN c b ON a.clip = b.clip AND b.t - a.t >= 2),
 g AS (SELECT clip, bin, count(*) AS n FROM p GROUP BY clip, bin), q AS (SELECT clip, n / sum(n) OVER (PARTITION BY clip) AS p FROM g) SELECT clip, round(sum(-p * log2(p)) / 4, 6) AS entropy FROM q GROUP BY clip""")
def _(spark, d):
    c = vec(spark, d).select(F.floor(F.col("vec_id") / 40).alias("clip"), (F.col("vec_id") % 40).alias("t"), "v")
    return Q.similarity_entropy(c, "clip", "t", "v", block=16).select("clip", F.round("entropy", 6).alias("entropy"))


@query("robust_spread", f"WITH {SERIES}, m AS (SELECT clip, median(x) AS med, stddev_pop(x) AS sd FROM s GROUP BY clip), q AS (SELECT s.clip, max(med) AS med, median(abs(x - med)) AS mad, max(sd) AS sd FROM s JOIN m ON m.clip = s.clip GROUP BY s.clip) SELECT clip, round(med, 6) AS median, round(CASE WHEN mad > 1e-12 THEN mad * 1.4826 ELSE sd END, 6) AS spread FROM q")
def _(spark, d):
    return Q.robust_spread(series(spark, d), "clip", "x").select("clip", F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"))


@query("tier0_gate", """SELECT doc_id, CASE WHEN doc_id % 29 = 0 OR doc_id % 5 = 0 OR n_chars = 0 THEN 'escalate_forced' WHEN (n_chars % 100) / 100.0 <= 0.2 AND (doc_id % 10) / 10.0 <= 0.5 THEN 'early_exit_clean' ELSE 'escalate' END AS action FROM documents""")
def _(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    action = tier0.gate((n % 100) / F.lit(100.0), (i % 10) / F.lit(10.0), i % 29 != 0, i % 5 == 0, n > 0, 0.2)
    return table(spark, d, "documents").select("doc_id", action.alias("action"))


@query("tier_selection", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size >= 32 AND p_partkey % 40 >= 16 THEN 'cloud' WHEN p_size >= 8 AND p_partkey % 40 >= 4 THEN 'consumer' ELSE 'edge' END AS tier FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", tier0.tier_of(F.col("p_size"), F.col("p_partkey") % 40, F.col("p_size") % 2 == 0).alias("tier"))


@query("frame_sampling", "SELECT doc_id, array_to_string(CASE WHEN n_chars <= 32 THEN range(0, n_chars) ELSE list_sort(list_distinct(list_transform(range(0, 32), lambda i: CAST(floor(i * (n_chars - 1) / 31.0) AS BIGINT)))) END, ',') AS places FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(X.sample_places(F.col("n_chars").cast("int"), 32), lambda x: x.cast("string")), ",").alias("places"))


def clips(spark, d, **kw):
    """A clip an item of the benchmark, driven by its text."""
    from attestra.operators import clips as K

    # Few bytes in, much work: so many tasks as there are shuffle partitions, whatever the bytes.
    spread = table(spark, d, "benchmark").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id")
    return K.from_texts(spread, "item_id", "text", **kw)


@query("visual_kernel")
def _(spark, d):
    from attestra.kernels import visual
    from attestra.operators import clips as K

    return K.visual_features(clips(spark, d)).select("clip_id", F.explode(K.feature_map(visual.NAMES)).alias("feature", "value")).withColumn("value", F.round("value", 6))


@query("multiregion_kernel")
def _(spark, d):
    from attestra.operators import clips as K

    return K.visual_features(clips(spark, d), regions=True).select("clip_id", "available", F.size("features").alias("n"))


@query("audio_kernel")
def _(spark, d):
    from attestra.kernels import audio
    from attestra.operators import clips as K

    return K.audio_features(clips(spark, d)).select("clip_id", F.explode(K.feature_map(audio.NAMES)).alias("feature", "value")).withColumn("value", F.round("value", 5))


@query("av_offset_kernel", "SELECT item_id AS clip_id, 5 AS lag FROM benchmark WHERE text IS NOT NULL")
def _(spark, d):
    """Clips whose audio is 200 ms late: the peak stands at 5 frames of 40 ms."""
    from attestra.operators import clips as K

    curve = K.activity_curves(clips(spark, d, shift_ms=200.0))
    return Q.peak(Q.cross_correlation(curve, "clip_id", "t", "a", "b", 12), "clip_id").select("clip_id", "lag")


@query("av_features")
def _(spark, d):
    """The 15 synchrony features of clips whose audio is 200 ms late."""
    from attestra.kernels import av
    from attestra.operators import clips as K

    return K.av_features(clips(spark, d, shift_ms=200.0)).select("clip_id", F.explode(K.feature_map(av.NAMES)).alias("feature", "value")).withColumn("value", F.round("value", 5))


@query("tier0_features")
def _(spark, d):
    from attestra.kernels import av
    from attestra.operators import clips as K

    return K.tier0_features(clips(spark, d)).select("clip_id", F.explode(K.feature_map([*av.MOTION, *av.SOUND])).alias("feature", "value")).withColumn("value", F.round("value", 5))


@query("log_mel_kernel")
def _(spark, d):
    """Mean log-mel spectrum of each clip's voice, a row a band."""
    from attestra.operators import clips as K

    return K.log_mel(clips(spark, d)).select("clip_id", F.posexplode("features").alias("band", "value")).withColumn("value", F.round("value", 4))


@query("manipulated_clips")
def _(spark, d):
    """The clips, each with manipulations sampled for its id; features of the first tier of what came out."""
    from attestra.operators import clips as K
    from attestra.operators import corpus

    level = corpus.quality(corpus.draw("clip_id", "quality"))
    planned = clips(spark, d).withColumns({"video_ops": corpus.video_operations(level, "clip_id"), "audio_ops": corpus.audio_operations(level, "clip_id"), "desync_ms": F.when(F.col("clip_id") % 2 == 1, 240.0).otherwise(0.0), "seed": F.col("clip_id")})
    made = K.manipulated(planned)
    return made.select("clip_id", "error", F.sha2("frames", 256).alias("frames_sha256"), F.length("audio").cast("long").alias("audio_bytes"))


@query("clip_hashes")
def _(spark, d):
    from attestra.operators import clips as K

    h = K.hashes(clips(spark, d))
    return h.select("clip_id", F.array_join(F.transform("video_phash", X.hash_hex), ",").alias("video_phash"), F.array_join(F.transform("audio_phash", X.hash_hex), ",").alias("audio_phash"))


@query("clip_commitments", """WITH p AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL AND strlen(text) > 0),
 k AS (SELECT doc_id, n, h, unnest(range(0, (n + 511) // 512)) AS i FROM p), l AS (SELECT doc_id, i, sha256('\\x00'::BLOB || encode('text|512|' || i || '|' || least(512, n - i * 512)) || unhex(substr(h, CAST(i * 1024 + 1 AS BIGINT), 1024))) AS leaf FROM k)
 SELECT doc_id, count(*) AS chunks, sha256(string_agg(leaf, '' ORDER BY i)) AS leaves_sha256 FROM l GROUP BY doc_id""")
def _(spark, d):
    """Texts as tracks of bytes, committed to by chunks of 512."""
    leaves = seal.chunk_leaves(table(spark, d, "documents"), "doc_id", "text", "text", 512)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "leaf"))), lambda x: x["leaf"]), "")
    return leaves.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sha2(listed, 256).alias("leaves_sha256"))


@query("track_roots")
def _(spark, d):
    """The trees over both tracks' chunks of each clip."""
    from attestra.operators import clips as K
    from attestra.operators import merkle

    c = K.commitments(clips(spark, d)).select(F.concat_ws("|", "clip_id", "track").alias("name"), F.posexplode("leaves").alias("i", "leaf"))
    return merkle.roots(c, "name", "i", "leaf").select(F.split("name", "[|]")[0].cast("long").alias("clip_id"), F.split("name", "[|]")[1].alias("track"), F.col("n_leaves").alias("chunks"), "root")
