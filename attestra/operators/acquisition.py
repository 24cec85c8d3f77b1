"""Corpus acquisition and planning: picks, quotas, splits, checkpoints and budgets.

Picks are by hash order, so they don't depend on partitioning and repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*columns: str, salt: str = "") -> Column:
    """A hexadecimal key any engine can compute: md5 of the columns."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns]))


def stratified_pick(df: DataFrame, stratum: str, key: Column, n: int) -> DataFrame:
    """n rows spread over strata in turn: the first of each, then the second, ..."""
    w = Window.partitionBy(stratum).orderBy("__k")
    ranked = df.withColumn("__k", key).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", stratum).limit(n).drop("__k")


def quota(df: DataFrame, stratum: str, key: Column, per: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy("__k")
    return df.withColumn("__k", key).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per).drop("__k")


def match_first(pool: DataFrame, picked: DataFrame, on: str) -> DataFrame:
    """Pool rows with priority 0 where a picked row has their ``on``, else 1."""
    keys = picked.select(on).distinct()
    return pool.join(keys, on, "left_semi").withColumn("priority", F.lit(0)).unionByName(pool.join(keys, on, "left_anti").withColumn("priority", F.lit(1)))


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def budget(df: DataFrame, seq: str, size: str, most: int, by: str) -> DataFrame:
    """Running total within ``by`` and whether it passes the budget."""
    w = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("total", F.sum(size).over(w)).withColumn("over_budget", F.col("total") > most)


def assign_splits(df: DataFrame, stratum: str, key: Column, fractions: list[tuple[str, float]]) -> DataFrame:
    """Splits within each stratum by the order of hexadecimal keys; the last takes the remainder. A stratum is
    ranked in 256 ranges of its keys, and a row a range carries the count of those before it: no task ranks all."""
    placed = df.withColumn("__k", key).withColumn("__r", F.substring("__k", 1, 2))
    counts = placed.groupBy(stratum, "__r").agg(F.count("*").alias("__m"))
    w = Window.partitionBy(stratum)
    ranges = counts.withColumns({"__n": F.sum("__m").over(w), "__ahead": F.sum("__m").over(w.orderBy("__r")) - F.col("__m")}).drop("__m").withColumnRenamed(stratum, "__s")
    met = placed.join(ranges, placed[stratum].eqNullSafe(ranges["__s"]) & (placed["__r"] == ranges["__r"])).drop(ranges["__r"]).drop("__s")
    ranked = met.withColumn("__i", F.col("__ahead") + F.row_number().over(Window.partitionBy(stratum, "__r").orderBy("__k")))
    total, split = 0.0, None
    for name, f in fractions[:-1]:
        total += f
        inside = F.col("__i") <= F.floor(F.col("__n") * F.lit(round(total, 9)))
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return ranked.withColumn("split", split.otherwise(fractions[-1][0])).drop("__k", "__r", "__i", "__n", "__ahead")


#: Provenance scenarios and their weights.
SCENARIOS = [("none", 0.60), ("consistent_real", 0.12), ("consistent_ai", 0.12), ("clash_manifest", 0.08), ("clash_watermark", 0.08)]


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def scenario(u: Column) -> Column:
    total, out = 0.0, None
    for name, p in SCENARIOS[:-1]:
        total += p
        hit = u < F.lit(round(total, 9))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(SCENARIOS[-1][0])


#: The four cells of a balanced corpus (real or fake video, real or fake audio).
CELLS = ["RR", "FR", "RF", "FF"]


def plan_clips(base: DataFrame, key: str, seed: int, variant: str = "base") -> DataFrame:
    """clip_id, label, seed and split: each base row (a distinct number ``key``) is planned once in each of the four cells."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(name).alias("label")) for i, name in enumerate(CELLS)])
    rows = base.select(F.col(key).cast("long").alias("i"), F.explode(cells).alias("x"))
    rows = rows.select(F.format_string(f"{variant}_%s_%05d", "x.label", "i").alias("clip_id"), "x.label", (F.lit(seed * 1000003) + F.col("i") * len(CELLS) + F.col("x.c")).alias("seed"))
    return assign_splits(rows, "label", hash_key("clip_id"), [("train", 0.60), ("val", 0.15), ("test", 0.25)])


def gate(sources: DataFrame, gates: DataFrame, on: str) -> DataFrame:
    """Adds status and reason: sources that ``gates`` (on, reason) names are skipped before anything is fetched."""
    named = gates.groupBy(on).agg(F.min("reason").alias("reason"))
    return sources.join(named, on, "left").withColumn("status", F.when(F.col("reason").isNull(), "fetch").otherwise("skip"))
