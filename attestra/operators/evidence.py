"""Ranked findings from feature contributions, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, LEAST = 4, 0.05


def group_prefix(contributions: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Features of one prefix become one: contributions add up, value and z come from the strongest."""
    name = F.when(F.col("feature").startswith(prefix), F.lit(prefix + "*")).otherwise(F.col("feature"))
    strongest = F.struct(F.round(F.abs("contribution"), 9), "feature")
    g = contributions.groupBy(*keys, name.alias("feature"))
    # The name is grouped, so the strongest is picked by its own struct.
    return g.agg(F.sum("contribution").alias("contribution"), F.max_by(F.struct("value", "z"), strongest).alias("s")).select(*keys, "feature", "contribution", "s.value", "s.z")


def findings(contributions: DataFrame, keys: list[str], k: int = TOP_K, least: float = LEAST) -> DataFrame:
    """The k strongest of each key from ``least`` on, with rank and direction."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature")
    strong = contributions.where(F.abs("contribution") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return strong.withColumn("direction", F.when(F.col("contribution") > 0, "manipulated").otherwise("authentic"))


def render(found: DataFrame, key: str) -> DataFrame:
    """One line a finding, in rank order."""
    line = F.format_string("%d. %s %s (%.3f)", "rank", "feature", "direction", "contribution")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return found.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


def report(branches: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """branches: key, branch, available, reason, ood_flag, ood_score; found: key, branch, rank, feature, direction.
    One row a clip: findings by branch and rank, and notes on branches without findings or out of distribution."""
    note = F.when(~F.col("available"), F.concat("branch", F.lit(" produced no findings: "), F.coalesce("reason", F.lit("unknown")))).when(F.col("ood_flag"), F.format_string("%s findings are discounted: outside the training distribution (percentile %.0f)", "branch", "ood_score"))
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    notes = branches.withColumn("note", note).groupBy(key).agg(F.transform(listed("branch", "note"), lambda x: x["note"]).alias("notes"))
    lines = found.groupBy(key).agg(F.transform(listed("branch", "rank", "feature", "direction"), lambda x: F.concat_ws(" ", x["branch"], x["feature"], x["direction"])).alias("findings"))
    return notes.join(lines, key, "left").select(key, F.coalesce("findings", F.array().cast("array<string>")).alias("findings"), F.filter("notes", lambda x: x.isNotNull()).alias("notes"))


def format_cell(x: Column) -> Column:
    """Table cells: 4 places under 1000, else 1; n/a if not finite, empty if null."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(x.isNull(), "").when(bad, "n/a").when(F.abs(x) < 1000, F.format_string("%.4f", x)).otherwise(F.format_string("%.1f", x))
