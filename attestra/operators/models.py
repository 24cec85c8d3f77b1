"""Branch models: standardisation, bagged logistic fits, calibration, vacuity, out-of-distribution.

A fitted model is one row of arrays; scoring is Spark expressions over it. Fitting runs each
bootstrap member as one grouped task over a bounded table of training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators.quantiles import quantiles

#: Fixed values of the models.
BOOTSTRAPS, C_VALUE, SEED, MAX_EVIDENCE, SHRINK, OOD_PERCENTILE = 15, 0.25, 1337, 60.0, 0.20, 99


def exploded(df: DataFrame, key: str, features: str, *keep: str) -> DataFrame:
    """Long form: key, keep, j (feature place), x."""
    return df.select(key, *keep, F.posexplode(features).alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def feature_stats(long: DataFrame) -> DataFrame:
    """j, mean and population deviation, 1 where the deviation is none."""
    s = long.groupBy("j").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return s.withColumn("sd", F.when(F.col("sd") < 1e-9, F.lit(1.0)).otherwise(F.col("sd")))


def standardise(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds z; stats is one row a feature, so it is broadcast."""
    return long.join(F.broadcast(stats), "j").withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))


def class_stats(long: DataFrame, fake: str) -> DataFrame:
    real = F.when(~F.col(fake), F.col("x"))
    return long.groupBy("j").agg(F.avg(real).alias("real_mean"), F.stddev_pop(real).alias("real_std"), F.avg(F.when(F.col(fake), F.col("x"))).alias("fake_mean"))


def diagonal_distance(standardised: DataFrame, key: str) -> DataFrame:
    """Mahalanobis distance under a diagonal covariance."""
    return standardised.groupBy(key).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("distance"))


def ood_percentile(df: DataFrame, distance: str, reference: DataFrame) -> DataFrame:
    """Percent of the 101 reference points below the distance, at most 100; flagged from 99."""
    ref = quantiles(reference, distance, [i / 100.0 for i in range(101)]).select(F.col("quantiles").alias("ref"))
    below = F.least(F.size(F.filter("ref", lambda r: r < F.col(distance))), F.lit(100))
    return df.crossJoin(F.broadcast(ref)).withColumn("ood_percentile", below).withColumn("ood_flag", below >= OOD_PERCENTILE).drop("ref")


def vacuity(members: Column) -> dict[str, Column]:
    """Mean, deviation and vacuity of an array of members' probabilities: agreement is evidence."""
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / F.size(members)
    var = F.aggregate(members, F.lit(0.0), lambda a, x: a + x * x) / F.size(members) - mean * mean
    var = F.greatest(var, F.lit(1e-9))
    evidence = F.least(F.lit(MAX_EVIDENCE), F.greatest(F.lit(0.0), mean * (F.lit(1.0) - mean) / var - F.lit(1.0)))
    return {"mean": mean, "sd": F.sqrt(var), "vacuity": F.lit(2.0) / (evidence + F.lit(2.0))}


def predict(df: DataFrame, members: str, extra: str, distance_percentile: str, available: str, reason: str, platt: tuple[Column | float, Column | float]) -> DataFrame:
    """The whole prediction of a branch: members' and extra probabilities together, their mean calibrated by ``platt``
    (slope and offset over its log-odds), vacuity from the members' agreement (not calibrated), a vacuity of 0.5 at
    OOD_PERCENTILE and of 1 beyond all training distances at least, and an uninformative row where the branch isn't
    available. Adds p_fake, llr, ensemble_sd, vacuity, ood_flag and reason_unavailable."""
    every = F.concat(F.col(members), F.coalesce(F.col(extra), F.array().cast("array<double>")))
    usable = F.col(available) & (F.size(every) > 0)
    found = df.withColumn("all_", F.when(usable, every).otherwise(F.array(F.lit(0.5))))
    v = vacuity(F.col("all_"))
    found = found.withColumns({"m_": v["mean"], "sd_": v["sd"], "v_": v["vacuity"]})
    slope, offset = (x if isinstance(x, Column) else F.lit(float(x)) for x in platt)
    found = found.withColumn("c_", X.sigmoid(slope * X.logit("m_") + offset))
    ood = usable & (F.col(distance_percentile) >= OOD_PERCENTILE)
    return found.withColumns({
        "p_fake": F.when(usable, F.col("c_")).otherwise(F.lit(0.5)), "llr": F.when(usable, X.logit("c_")).otherwise(F.lit(0.0)), "ensemble_sd": F.when(usable, F.col("sd_")).otherwise(F.lit(0.0)),
        "vacuity": F.when(~usable, F.lit(1.0)).when(ood, F.least(F.lit(1.0), F.greatest(F.col("v_"), F.lit(0.5) + F.lit(0.5) * (F.col(distance_percentile) - OOD_PERCENTILE) / F.lit(100.0 - OOD_PERCENTILE)))).otherwise(F.col("v_")), "ood_flag": ood,
        "reason_unavailable": F.when(~usable, F.coalesce(F.col(reason), F.lit("no members"))),
    }).drop("all_", "m_", "sd_", "v_", "c_")


def member_probabilities(z: Column, coefs: Column) -> Column:
    """Each member's probability from standardised features; the bias comes last in its coefficients."""

    def one(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(z, F.slice(c, 1, F.size(c) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return X.sigmoid(dot + F.element_at(c, -1))

    return F.transform(coefs, one)


def platt(p: Column, a: Column, b: Column) -> Column:
    return X.sigmoid(a * X.logit(p) + b)


def contributions(long: DataFrame, weights: DataFrame) -> DataFrame:
    """weight * z of each feature; weights is one row a feature (j, weight)."""
    return long.join(F.broadcast(weights), "j").withColumn("contribution", F.col("z") * F.col("weight"))


def valid_features(v: Column, n: int) -> Column:
    return v.isNotNull() & (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def solve_logistic(x: np.ndarray, y: np.ndarray, c: float = C_VALUE, rounds: int = 60) -> np.ndarray:
    """Balanced, L2-penalised logistic regression by Newton steps; the bias, last, isn't penalised."""
    n1 = y.sum()
    weight = np.where(y > 0, len(y) / (2 * max(n1, 1)), len(y) / (2 * max(len(y) - n1, 1)))
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1 / c), 0)
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -60, 60)))
        grad = x1.T @ (weight * (p - y)) + ridge * w
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit_bagged(df: DataFrame, features: str, label: str, bootstraps: int = BOOTSTRAPS, most_rows: int = 20_000) -> DataFrame:
    """member and coefs (bias last): each member a fit on a resample with replacement. features: standardised (see scaled()).

    Training is bounded: at most ``most_rows`` rows by the hash of their features; each member
    gets them as one group."""
    rows = df.select(F.col(features).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).where("v IS NOT NULL AND y IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("v", "y")).limit(most_rows)
    spread = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["member"].iloc[0])
        x, y = np.array(pdf["v"].tolist(), float), pdf["y"].to_numpy(float)
        order = np.lexsort((*x.T[::-1], y))
        x, y = x[order], y[order]
        at = np.random.default_rng(SEED + k).integers(0, len(y), len(y))
        if y[at].min() == y[at].max():
            at = np.arange(len(y))
        return pd.DataFrame({"member": [k], "coefs": [solve_logistic(x[at], y[at]).tolist()]})

    return spread.groupBy("member").applyInPandas(one, "member int, coefs array<double>")


def fit_platt(scored: DataFrame, p: str, label: str, most_rows: int = 20_000) -> DataFrame:
    """a and b of the calibration: a nearly unpenalised logistic fit on the logit of the mean."""
    rows = scored.select(X.logit(F.col(p)).alias("l"), F.col(label).cast("double").alias("y")).orderBy(F.xxhash64("l", "y")).limit(most_rows)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        if y.min() == y.max():
            return pd.DataFrame({"a": [1.0], "b": [0.0]})
        a, b = solve_logistic(pdf[["l"]].to_numpy(float), y, 1e6)
        return pd.DataFrame({"a": [a], "b": [b]})

    return rows.groupBy().applyInPandas(one, "a double, b double")


def shrunk(s: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """A covariance matrix drawn towards its mean variance."""
    return (1 - shrink) * s + shrink * np.trace(s) / len(s) * np.eye(len(s))


def shrunk_covariance(z: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    return shrunk(np.cov(z, rowvar=False), shrink)


def added(df: DataFrame, sums, key: str = "k") -> dict[int, np.ndarray]:
    """Adds up arrays of a fixed length over all partitions: sums takes a partition's batches and gives {k: array}."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, v in sums(batches).items():
            yield pd.DataFrame({key: k, "i": np.arange(len(v)), "x": np.asarray(v, float)})

    got = df.mapInPandas(run, f"{key} int, i int, x double").groupBy(key, "i").agg(F.sum("x").alias("x")).toPandas().sort_values([key, "i"])
    return {int(k): g["x"].to_numpy() for k, g in got.groupby(key)}


def covariance(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of all rows, from sums of partitions: of x first, then of its deviations' products.
    Empty without rows; a covariance of zeros with one."""
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v"))

    def first(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total = 0
        for b in batches:
            if len(b):
                x = np.array(b["v"].tolist(), float)
                total = total + np.append(len(x), x.sum(0))
        return {0: total} if np.ndim(total) else {}

    sums = added(rows, first)
    if not sums:
        return np.zeros(0), np.zeros((0, 0))
    n, *total = sums[0]
    mean = np.array(total) / n

    def second(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            if len(b):
                c = np.array(b["v"].tolist(), float) - mean
                total += c.T @ c
        return {0: total.ravel()}

    return mean, added(rows, second)[0].reshape(len(mean), -1) / max(n - 1, 1)


def scaled(df: DataFrame, features: str, out: str) -> DataFrame:
    """Adds the features less their mean, over their deviation (1 where it is next to nothing), of all rows."""
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        n, mean, square = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.array(b["v"].tolist(), float)
                n, mean, square = n + len(x), mean + x.sum(0), square + (x * x).sum(0)
        return {0: np.concatenate([[n], mean, square])} if n else {}

    found = added(rows, sums)
    if not found:
        return df.withColumn(out, F.col(features).cast("array<double>"))
    n, total = found[0][0], found[0][1:]
    mean, square = np.split(total / n, 2)
    sd = np.sqrt(np.maximum(square - mean**2, 0))
    sd = np.where(sd < 1e-9, 1.0, sd)
    m, s = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, sd))
    centred = F.zip_with(F.col(features).cast("array<double>"), m, lambda a, b: a - b)
    return df.withColumn(out, F.zip_with(centred, s, lambda a, b: a / b))


def mahalanobis(df: DataFrame, features: str, out: str = "distance") -> DataFrame:
    """Distance under the shrunk covariance of all rows; the matrix is d x d, whatever the rows."""
    mean, s = covariance(df, features)
    inverse = np.linalg.pinv(shrunk(s))
    schema = df.schema.simpleString()[7:-1] + f",{out}:double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1) - mean if len(pdf) else np.zeros((0, len(mean)))
            yield pdf.assign(**{out: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c, inverse, c), 0))})

    return df.mapInPandas(run, schema)
