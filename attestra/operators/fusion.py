"""Fusion of the branches into a five-way verdict. Column expressions only.

Cells are ordered RR, FR, RF, FF: (video, audio) real or fake. A branch comes as a struct of
p (probability of fake), llr, vacuity, available and ood_flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import expressions as X

#: Cells, thresholds and verdicts of the fusion rules.
CELLS = ["RR", "FR", "RF", "FF"]
VERDICTS = ["REAL", "VIDEO_FAKE", "AUDIO_FAKE", "BOTH_FAKE", "UNKNOWN"]
DECIDE, CONFIDENT_LLR, CONFIDENT_VACUITY, BAND, PENALTY = 0.55, 1.6, 0.30, 0.15, 3.0
TIER2_UNCERTAINTY = 0.25


def coupling(rows: DataFrame, video: str, audio: str, desync: str) -> DataFrame:
    """P(desync | cell) = (k + 2) / (n + 4), also for cells without rows."""
    cell = F.when(F.col(video) & F.col(audio), "FF").when(F.col(video), "FR").when(F.col(audio), "RF").otherwise("RR")
    counted = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col(desync)).alias("k"))
    cells = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "pos int, cell string")
    full = F.broadcast(cells).join(counted, "cell", "left").select("pos", "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    return full.withColumn("p_desync", (F.col("k") + 2) / (F.col("n") + F.lit(4.0)))


def branch(p: Column, vacuity: Column, available: Column | None = None, ood: Column | None = None) -> Column:
    """Neutral where it isn't available: p 0.5, llr 0, vacuity 1."""
    there = F.lit(True) if available is None else F.coalesce(available, F.lit(False))
    p = F.when(there, p).otherwise(F.lit(0.5))
    return F.struct(p.alias("p"), X.logit(p).alias("llr"), F.when(there, vacuity).otherwise(F.lit(1.0)).alias("vacuity"), there.alias("available"), (F.lit(False) if ood is None else ood).alias("ood_flag"))


def posterior(video: str, audio: str, sync: str, table: Column | list[float], prior_video: float = 0.5, prior_audio: float = 0.5, penalty: float = PENALTY) -> Column:
    """Array of the four cells' probabilities."""
    table = F.array(*[F.lit(float(x)) for x in table]) if isinstance(table, list) else table
    v, a, s = (X.temper(F.col(f"{b}.p"), F.col(f"{b}.vacuity"), penalty) for b in (video, audio, sync))

    def weight(i: int) -> Column:
        fv, fa = i in (1, 3), i in (2, 3)
        c = X.clip(table[i], 1e-4, 1 - 1e-4)
        pv, pa = (v if fv else F.lit(1.0) - v), (a if fa else F.lit(1.0) - a)
        prior = (prior_video if fv else 1 - prior_video) * (prior_audio if fa else 1 - prior_audio)
        return F.lit(prior) * pv * pa * (s * c + (F.lit(1.0) - s) * (F.lit(1.0) - c))

    return X.let(F.array(*[weight(i) for i in range(4)]), lambda w: F.transform(w, lambda x: x / (w[0] + w[1] + w[2] + w[3])))


def fuse(df: DataFrame, table: Column | list[float], video: str = "video", audio: str = "audio", sync: str = "sync", decide: float = DECIDE, penalty: float = PENALTY) -> DataFrame:
    """Adds post, p_video, p_audio, top, margin, joint_vacuity, video_verdict, audio_verdict, flags and verdict."""
    df = df.withColumn("post", posterior(video, audio, sync, table, penalty=penalty))
    ordered = F.sort_array("post", asc=False)
    df = df.withColumns(
        {
            "p_video": F.col("post")[1] + F.col("post")[3],
            "p_audio": F.col("post")[2] + F.col("post")[3],
            "top": ordered[0],
            "margin": ordered[0] - ordered[1],
            "joint_vacuity": (F.col(f"{video}.vacuity") + F.col(f"{audio}.vacuity") + F.col(f"{sync}.vacuity")) / F.lit(3.0),
        }
    )
    conflicts, verdicts = {}, {}
    for name, b, p in (("video", video, "p_video"), ("audio", audio, "p_audio")):
        sure = F.col(f"{b}.available") & (F.abs(F.col(f"{b}.llr")) >= CONFIDENT_LLR) & (F.col(f"{b}.vacuity") <= CONFIDENT_VACUITY)
        conflicts[name] = sure & ((F.col(f"{b}.llr") > 0) != (F.col(p) > 0.5))
        verdicts[f"{name}_verdict"] = F.when(conflicts[name] | ~F.col(f"{b}.available"), "UNKNOWN").when(F.col(p) >= 0.5 + BAND, "FAKE").when(F.col(p) <= 0.5 - BAND, "REAL").otherwise("UNKNOWN")
    df = df.withColumns({**verdicts, "video_conflict": conflicts["video"], "audio_conflict": conflicts["audio"]})
    flags = [F.when(F.col(f"{n}_conflict"), f"{n}_conflict") for n in ("video", "audio")]
    for n, b in (("video", video), ("audio", audio), ("sync", sync)):
        flags += [F.when(~F.col(f"{b}.available"), f"{n}_unavailable"), F.when(F.col(f"{b}.available") & F.col(f"{b}.ood_flag"), f"{n}_ood")]
    cell = F.array_position("post", F.array_max("post")).cast("int")
    missing = ~F.col(f"{video}.available") & ~F.col(f"{audio}.available")
    verdict = (
        F.when(F.col("video_conflict") | F.col("audio_conflict") | missing, "UNKNOWN")
        .when((F.col("video_verdict") == "UNKNOWN") | (F.col("audio_verdict") == "UNKNOWN"), "UNKNOWN")
        .when(F.col("top") < decide, "UNKNOWN")
        .otherwise(F.element_at(F.array(*[F.lit(v) for v in VERDICTS[:4]]), cell))
    )
    return df.withColumn("flags", F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))).withColumn("verdict", verdict)


def without_branch(df: DataFrame, branch: str) -> DataFrame:
    """Ablation: the branch as if it had never run (uninformative, fully vacuous, unavailable)."""
    return df.withColumn(branch, F.struct(F.lit(0.5).alias("p"), F.lit(0.0).alias("llr"), F.lit(1.0).alias("vacuity"), F.lit(False).alias("available"), F.lit(False).alias("ood_flag")))


def tier2_trigger(escalate: Column, decide: float = DECIDE, uncertainty: float = TIER2_UNCERTAINTY) -> Column:
    return (F.col("top") < decide) | (F.col("joint_vacuity") > uncertainty) | escalate | F.col("video_conflict") | F.col("audio_conflict")


def deferred(df: DataFrame) -> DataFrame:
    """The result of a clip that another tier must judge: uniform, fully vacuous."""
    return df.withColumns({"post": F.array(*[F.lit(0.25)] * 4), "p_video": F.lit(0.5), "p_audio": F.lit(0.5), "top": F.lit(0.25), "margin": F.lit(0.0), "joint_vacuity": F.lit(1.0), "verdict": F.lit("UNKNOWN")})


def early_exit(df: DataFrame, p: str) -> DataFrame:
    """The result of a clip that the cheap tier calls clean: (1 - p, p/3, p/3, p/3), both marginals p."""
    p_ = F.col(p)
    third = p_ / F.lit(3.0)
    return df.withColumns({"post": F.array(F.lit(1.0) - p_, third, third, third), "p_video": p_, "p_audio": p_, "top": F.lit(1.0) - p_, "margin": F.lit(1.0) - F.lit(4.0) * p_ / F.lit(3.0), "verdict": F.lit("REAL")})


def cached(verdict: Column) -> Column:
    """A registry's verdict word; an unknown one is UNKNOWN."""
    return F.when(verdict.isin(VERDICTS), verdict).otherwise("UNKNOWN")
