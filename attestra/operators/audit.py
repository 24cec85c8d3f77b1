"""Metrics and audit controls, all as grouped aggregation and windows over scores.

``scores`` holds id, score (double) and label (boolean). Ties in score are broken by id where
an order is needed. Running sums over all scores never sort them in one task: see running().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions import expressions as X
from attestra.operators import models
from attestra.operators.quantiles import quantiles
from attestra.session import cut


def running(df: DataFrame, sums: dict[str, Column], by: list[str] | None = None, descending: bool = False, then: list[str] | None = None, parts: int = 64) -> DataFrame:
    """Adds running sums in order of ``score`` (then of ``then``) within ``by``, without sorting all rows in
    one task: approximate quantiles cut the scores into ranges, each range sums up itself, and the totals of the
    ranges before it, a row a range and group, are added. A score that fills ranges is one of its own, cut again by
    quantiles of the first of ``then`` (a number)."""
    keys = by or []
    cuts = df.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 1000).alias("q")).first()["q"] or []
    crowded = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    cuts = sorted(set(cuts))
    place = sum(((F.col("score") > F.lit(c)).cast("int") for c in cuts), F.lit(0)) if len(cuts) < 8 else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("score") > c))
    sub = F.lit(0)
    if crowded and then and isinstance(df.schema[then[0]].dataType, T.NumericType):
        tied = F.col("score").isin(crowded)
        place = 2 * place + tied.cast("int")  # after the others of its range, whose upper end it is
        found = df.where(tied).groupBy("score").agg(F.percentile_approx(then[0], [i / parts for i in range(1, parts)], 1000).alias("q")).collect()  # at most parts / 2 scores
        for r in found:
            own = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(r["q"]))]), lambda c: F.col(then[0]) > c))
            sub = F.when(F.col("score") == F.lit(r["score"]), own).otherwise(sub)
    placed = df.withColumns({"range_": -place if descending else place, "sub_": sub})
    at = ["range_", "sub_"]
    totals = placed.groupBy(*keys, *at).agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select(*keys, *at, *[F.coalesce(F.sum(f"{n}_all").over(ahead), F.lit(0)).alias(f"{n}_before") for n in sums])
    own = Window.partitionBy(*keys, *at).orderBy(F.desc("score") if descending else "score", *(then or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(offsets, [*keys, *at])
    return out.withColumns({n: F.col(f"{n}_before") + F.sum(c).over(own) for n, c in sums.items()}).drop(*at, *[f"{n}_before" for n in sums])


def roc_auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC by tie-averaged ranks; 0.5 with one class, or none where there are no groups.

    Scores are grouped to distinct values first."""
    keys = by or []
    values = cut(scores.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if("label").alias("pos")), "auc")  # read three times
    ranked = running(values, {"rank_": F.col("n")}, by).withColumn("rank", F.col("rank_") - (F.col("n") - 1) / F.lit(2.0))
    a = ranked.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    p, q = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("p", "q"))  # no rows: no classes
    return a.select(*keys, F.when((p == 0) | (q == 0), F.lit(0.5)).otherwise((F.col("r") - p * (p + 1) / 2) / F.greatest(p * q, F.lit(1.0))).alias("auc"))


def recall_at_fpr(scores: DataFrame, fpr: float) -> DataFrame:
    """Share of positives strictly above the (1 - fpr) quantile of negatives; 0 without a class."""
    thr = quantiles(scores.where("NOT label"), "score", [1 - fpr]).select(F.get("quantiles", F.lit(0)).alias("threshold"))
    pos = scores.where("label").crossJoin(F.broadcast(thr))  # one row: the threshold
    return pos.agg(F.coalesce(F.avg((F.col("score") > F.col("threshold")).cast("double")), F.lit(0.0)).alias("recall"), F.first("threshold").alias("threshold"))


def _descending(scores: DataFrame) -> DataFrame:
    scores = cut(scores, "scores")  # read for quantiles, totals and sums
    total = scores.agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"))
    sums = {"tp": F.col("label").cast("long"), "fp": (~F.col("label")).cast("long")}
    return running(scores, sums, descending=True, then=["id"]).crossJoin(F.broadcast(total))  # one row: the totals


def roc_points(scores: DataFrame) -> DataFrame:
    """fpr, tpr after each score in descending order, with the ends (0, 0) and (1, 1); a rate of a class
    that isn't there is 0."""
    points = _descending(scores).select(X.ratio("fp", "q", 0.0).alias("fpr"), X.ratio("tp", "p", 0.0).alias("tpr"))
    ends = scores.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    return points.unionByName(ends)


def pr_points(scores: DataFrame) -> DataFrame:
    """id, recall (0 without positives) and precision after each score in descending order."""
    return _descending(scores).select("id", X.ratio("tp", "p", 0.0).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def eer(scores: DataFrame) -> DataFrame:
    """Mean of false acceptance and rejection where they are nearest, the first such place; 0.5 with one class."""
    d = _descending(scores).withColumn("far", X.ratio("fp", "q", 0.0)).withColumn("frr", F.lit(1.0) - X.ratio("tp", "p", 0.0))
    at = F.min_by((F.col("far") + F.col("frr")) / F.lit(2.0), F.struct(F.abs(F.col("far") - F.col("frr")), -F.col("score"), F.col("id")))
    return d.agg(F.when((F.max("p") > 0) & (F.max("q") > 0), at).otherwise(F.lit(0.5)).alias("eer"))


def bin_of(score: Column, bins: int) -> Column:
    """(low, high] bins from 1, the first closed below."""
    return F.greatest(F.ceil(score * bins), F.lit(1)).cast("int")


def reliability(scores: DataFrame, bins: int = 8, least: int = 3) -> DataFrame:
    g = scores.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("accuracy"))
    return g.where(F.col("n") >= least)


def ece(scores: DataFrame, bins: int = 10) -> DataFrame:
    g = reliability(scores, bins, 1)
    return g.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    return rows.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def uniformity(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """C1: distinct values of each column, nulls counting as one; uniform is 1 or none."""
    counts = df.groupBy(*(by or [])).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(c) for c in columns])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("distinct_values")) for c in columns])).alias("x")
    return counts.select(*(by or []), long).select(*(by or []), "x.*").withColumn("uniform", F.col("distinct_values") <= 1)


def leakage(scores: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """C2 for single content-blind features: AUC up to direction must stay near 0.5."""
    a = roc_auc(scores, ["feature"])
    return a.withColumn("auc", F.greatest("auc", F.lit(1.0) - F.col("auc"))).withColumn("passed", F.col("auc") - F.lit(0.5) < F.lit(tolerance))


def _resampled(scores: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Poisson(1) resamples: b and the row's weight w in it, by hashes of (replicate, id). Replicates are
    extra rows of one grouped aggregation, so nothing is gathered. Rows are dealt evenly first, as each is drawn
    ``replicates`` times, which their size doesn't tell. Eight hex digits over 2^32 exceed an edge if they come
    after the edge's own as text; most rows need two or three comparisons."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("id").cast("string")))
    weight = F.lit(len(POISSON)).cast("long")
    for k, e in reversed(list(enumerate(POISSON))):
        weight = F.when(F.col("draw_") < F.lit(f"{int(e * 4294967296):08x}g"), F.lit(k).cast("long")).otherwise(weight)
    tasks = 4 * scores.sparkSession.sparkContext.defaultParallelism
    drawn = scores.repartition(tasks, "id").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw_", draw)
    return drawn.where(F.col("draw_") >= F.lit(f"{int(POISSON[0] * 4294967296):08x}g")).withColumn("w", weight).drop("draw_")


def _poisson(most: int = 8) -> list[float]:
    """P(X <= k) of a Poisson variable of mean 1, from k = 0 on."""
    edges, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, most + 1):
        total += p
        edges.append(total)
        p /= k
    return edges


POISSON = _poisson()


def bootstrap(scores: DataFrame, statistic: Callable[[DataFrame], DataFrame], replicates: int = 1000, seed: int = 1337, level: float = 0.95) -> DataFrame:
    """The percentile interval of any statistic: it gets rows with b (replicate) and w (weight) and gives b and value."""
    found = statistic(_resampled(scores, replicates, seed)).select("value")
    return found.agg(F.count("value").alias("replicates"), F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))


def weighted_auc(drawn: DataFrame) -> DataFrame:
    """b, value: the AUC of each replicate that has both classes."""
    values = drawn.groupBy("b", "score").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("label"), F.col("w")).otherwise(0)).alias("pos"))
    w = Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / F.lit(2.0))
    a = ranked.groupBy("b").agg(F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r")).where("p > 0 AND q > 0")
    return a.select("b", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("value"))


def bootstrap_auc(scores: DataFrame, replicates: int = 1000, seed: int = 1337, level: float = 0.95) -> DataFrame:
    """The AUC and its percentile interval."""
    return bootstrap(scores, weighted_auc, replicates, seed, level).crossJoin(F.broadcast(roc_auc(scores)))  # one row: the point estimate


def bootstrap_auc_grouped(scores: DataFrame, replicates: int = 1000, seed: int = 1337, level: float = 0.95, parts: int = 64) -> DataFrame:
    """The AUC and its percentile interval without a row for each row and replicate: rows of one score and label are
    drawn together (a sum of n Poisson variables of mean 1 is one of mean n), so work follows distinct scores.

    Scores are cut into ranges. A range adds up, for all replicates at once, its positives, its negatives and the
    pairs that they win within it; what it wins over lower ranges is its positives times their negatives. Draws depend
    on seed, score and label alone, not on how rows are dealt."""
    values = scores.where("score IS NOT NULL").groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    cuts = values.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 1000).alias("q")).first()["q"] or []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: F.col("score") > c))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, p, n, won = None, 0, 0, 0.0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"range_": own, "b": np.arange(replicates), "p": p, "n": n, "won": won})

        for batch in batches:
            for r, score, pos, neg in batch[["range_", "score", "pos", "neg"]].itertuples(index=False):
                if r != own:
                    if own is not None:
                        yield out()
                    own, p, n, won = r, np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
                key = np.array([score], np.float64).view(np.uint64)[0]
                draw = lambda k, side: np.random.Generator(np.random.Philox(key=[int(key), seed * 2 + side])).poisson(k, replicates)  # noqa: B023, E731
                a, z = draw(pos, 1), draw(neg, 0)
                won += a * (n + z / 2)
                p += a
                n += z
        if own is not None:
            yield out()

    ranges = values.withColumn("range_", place).repartition("range_").sortWithinPartitions("range_", "score").mapInPandas(run, "range_ int, b int, p double, n double, won double")
    before = Window.partitionBy("b").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    ranges = ranges.withColumn("lower", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    each = ranges.groupBy("b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("won") + F.col("p") * F.col("lower")).alias("won")).where("p > 0 AND n > 0")
    found = each.select((F.col("won") / (F.col("p") * F.col("n"))).alias("value"))
    interval = found.agg(F.count("value").alias("replicates"), F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))
    return interval.crossJoin(F.broadcast(roc_auc(scores)))  # one row: the point estimate


def audited_tuple(scores: DataFrame, method: str, task: str, floor: float, replicates: int = 1000, seed: int = 1337) -> DataFrame:
    """One row of all metrics of a method on a task, beside the floor it has to clear."""
    counted = scores.agg(F.count("*").alias("n"), F.avg(((F.col("score") >= 0.5) == F.col("label")).cast("double")).alias("accuracy"))
    out = counted.crossJoin(bootstrap_auc(scores, replicates, seed).drop("replicates")).crossJoin(recall_at_fpr(scores, 0.001).select(F.col("recall").alias("recall_at_fpr"))).crossJoin(ece(scores))  # one row each
    return out.select(F.lit(method).alias("method"), F.lit(task).alias("task"), "n", "auc", "low", "high", F.lit(floor).alias("floor"), (F.col("auc") - F.lit(floor)).alias("margin"), "recall_at_fpr", "ece", "accuracy")


def matched_readout(rows: DataFrame, seeds: list[int], c: float = models.C_VALUE, rounds: int = 60) -> DataFrame:
    """seed, score and label of each row that a seed tests: under each seed, one balanced, L2-penalised
    logistic readout (the objective of ``models.solve_logistic``) over features standardised on the rows it
    trains on. rows: v, and arrays train and y (booleans) with a place a seed. The Newton steps add up
    sums of partitions over all rows. A seed with one class on either side gives no rows."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            if len(b):
                yield np.array(b["v"].tolist(), float), np.array(b["train"].tolist(), bool), np.array(b["y"].tolist(), bool)

    def moments(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total: dict = {}
        for x, train, y in split(batches):
            for k in range(len(seeds)):
                t, own = train[:, k], y[:, k]
                counts = [(t & own).sum(), (t & ~own).sum(), (~t & own).sum(), (~t & ~own).sum()]
                total[k] = total.get(k, 0) + np.concatenate([counts, x[t].sum(0), (x[t] ** 2).sum(0)])
        return total

    state = {}
    for k, m in models.added(rows, moments).items():
        if (m[:4] > 0).all():
            n = m[0] + m[1]
            mean, square = np.split(m[4:] / n, 2)
            sd = np.sqrt(np.maximum(square - mean**2, 0))
            state[k] = (mean, np.where(sd < 1e-9, 1, sd), n / (2 * m[0]), n / (2 * m[1]), np.zeros(len(mean) + 1))
    open_ = set(state)
    for _ in range(rounds):
        if not open_:
            break
        now = {k: state[k] for k in open_}

        def slopes(batches: Iterator[pd.DataFrame], now=now) -> dict[int, np.ndarray]:
            total: dict = {}
            for x, train, y in split(batches):
                for k, (mean, sd, one, zero, w) in now.items():
                    t = train[:, k]
                    x1 = np.column_stack([(x[t] - mean) / sd, np.ones(t.sum())])
                    p = 1 / (1 + np.exp(-np.clip(x1 @ w, -60, 60)))
                    weight = np.where(y[t, k], one, zero)
                    hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1
                    total[k] = total.get(k, 0) + np.concatenate([x1.T @ (weight * (p - y[t, k])), hess.ravel()])
            return total

        for k, g in models.added(rows, slopes).items():
            mean, sd, one, zero, w = state[k]
            ridge = np.append(np.full(len(mean), 1 / c), 0)
            hess = g[len(w) :].reshape(len(w), -1) + np.diag(ridge) + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(hess, g[: len(w)] + ridge * w)
            state[k] = (mean, sd, one, zero, w - step)
            if np.abs(step).max() < 1e-10:
                open_.discard(k)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, train, y in split(batches):
            for k, (mean, sd, _, _, w) in state.items():
                t = ~train[:, k]
                z = (x[t] - mean) / sd @ w[:-1] + w[-1]
                yield pd.DataFrame({"seed": seeds[k], "score": 1 / (1 + np.exp(-np.clip(z, -60, 60))), "label": y[t, k]})

    return rows.mapInPandas(scored, "seed int, score double, label boolean")


def _share(seed: int, what: str, of: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(of))


def _spread(rows: DataFrame, labels: list[Column], seeds: list[int]) -> DataFrame:
    """seeds usable, mean, deviation, least, most and each AUC of readouts fitted on 70 % and scored on the rest."""
    drawn = rows.select("v", F.array(*[_share(s, "train", 10) < 7 for s in seeds]).alias("train"), F.array(*labels).alias("y"))
    a = roc_auc(matched_readout(drawn, seeds), ["seed"])
    each = F.transform(F.array_sort(F.collect_list(F.struct("seed", "auc"))), lambda x: x["auc"])
    return a.agg(F.count("*").alias("n_seeds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.min("auc").alias("low"), F.max("auc").alias("high"), each.alias("per_seed"))


def coherence_floor(real: DataFrame, seeds: list[int]) -> DataFrame:
    """C3: real rows (id, v) under arbitrary labels; passes with a mean AUC under 0.62, not without a usable seed."""
    return _spread(real, [_share(s, "label", 2) == 0 for s in seeds], seeds).withColumn("passed", F.coalesce(F.col("mean_auc") < 0.62, F.lit(False)))


def multiseed(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """C5: rows (id, v, label) refitted under each seed; passes with five usable ones."""
    return _spread(rows, [F.col("label")] * len(seeds), seeds).withColumn("passed", F.col("n_seeds") >= 5)


def baseline_leakage(rows: DataFrame, baselines: dict[str, list[str]], seed: int = 0, tolerance: float = 0.15) -> DataFrame:
    """C2: rows: id, label and columns of content-blind numbers. Each baseline (a set of columns) is fitted by the
    matched readout on 70 % and scored on the rest; the worst distance of its AUC from 0.5 must stay under the tolerance."""
    out = None
    for name, columns in baselines.items():
        v = F.array(*[F.col(c).cast("double") for c in columns])
        drawn = rows.select("id", v.alias("v"), F.col("label")).select("v", F.array(_share(seed, "train", 10) < 7).alias("train"), F.array("label").alias("y"))
        one = roc_auc(matched_readout(drawn, [seed])).select(F.lit(name).alias("baseline"), "auc")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("distance", F.abs(F.col("auc") - F.lit(0.5))).withColumn("passed", F.col("distance") < F.lit(tolerance))


def risk_coverage(df: DataFrame, margins: list[float]) -> DataFrame:
    """df: margin (double) and correct (boolean). Coverage and risk at each least margin."""
    grid = df.sparkSession.createDataFrame([(float(m),) for m in margins], "least double")
    kept = df.withColumn("kept", F.lit(True)).crossJoin(F.broadcast(grid)).withColumn("kept", F.col("margin") >= F.col("least"))
    return kept.groupBy("least").agg(F.avg(F.col("kept").cast("double")).alias("coverage"), F.avg(F.when(F.col("kept"), 1.0 - F.col("correct").cast("double"))).alias("risk"))


def cross_dataset(auc: Column, floor: Column, margin: float = 0.05) -> Column:
    """C6: another corpus' AUC must clear the floor by a margin."""
    return auc > floor + F.lit(margin)
