"""Exact quantiles of groups of any size, by selection over ranges.

``percentile`` and ``median`` keep all distinct values of a group in one task. Here equal values are
counted first; groups of few distinct values take the built-in way. Others are cut into ranges by an
approximate sketch, each range is counted, and only the ranges that hold a wanted rank stay, to be cut
again until they are small enough to be ranked by a window. No task sorts more than ``limit`` values,
and each round keeps about 1 / ``fan`` of the values a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import cut

#: Distinct values that one task ranks, ranges of a round, and rows of a table that is broadcast.
LIMIT, FAN, BROADCAST = 100_000, 64, 50_000


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def quantiles(df: DataFrame, value: Column | str, points: list[float], by: list[str] | None = None, limit: int = LIMIT, fan: int = FAN) -> DataFrame:
    """``by`` and ``quantiles``: the values at ``points`` (0 to 1), between two values in proportion. Nulls don't
    count; a group of nulls has null quantiles; without ``by`` an empty table has one row of them."""
    keys = by or []
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, x.cast("double").alias("x_"))
    counted = rows.groupBy(*keys, "x_").agg(F.count("*").alias("c_"))
    counted = cut(counted, "values")
    wanted = F.array(*[F.lit(float(p)) for p in points])
    sizes = counted.groupBy(*keys).agg(F.count("x_").alias("d_"), F.sum(F.when(F.col("x_").isNotNull(), F.col("c_"))).alias("n_"))
    big = cut(sizes.where(F.col("d_") > limit), "groups")
    if big.isEmpty():
        return counted.groupBy(*keys).agg(F.percentile("x_", wanted, F.col("c_")).alias("quantiles"))
    if keys:
        names = _small(big.select(*keys))
        few = counted.join(names, keys, "left_anti").groupBy(*keys).agg(F.percentile("x_", wanted, F.col("c_")).alias("quantiles"))
        state = counted.where("x_ IS NOT NULL").join(names, keys)
    else:
        few, state = None, counted.where("x_ IS NOT NULL")
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i_"), F.lit(float(p)).alias("p_")) for i, p in enumerate(points)])).alias("w")
    asked = big.select(*keys, "n_", places).select(*keys, "w.i_", (F.col("w.p_") * (F.col("n_") - 1)).alias("at_"), "n_")
    asked = asked.withColumns({"low_": F.floor("at_"), "high_": F.least(F.floor("at_") + 1, F.col("n_") - 1)})
    targets = asked.select(*keys, F.explode(F.array("low_", "high_")).alias("rank_")).distinct().withColumns({"piece_": F.lit(0).cast("long"), "ahead_": F.lit(0).cast("long")})
    found = select_ranks(state.withColumn("piece_", F.lit(0).cast("long")), targets, keys, limit, fan)
    value_at = lambda side: found.select(*keys, F.col("rank_").alias(f"{side}_"), F.col("x_").alias(f"{side}_x"))
    both = asked.join(value_at("low"), [*keys, "low_"]).join(value_at("high"), [*keys, "high_"])
    share = F.col("at_") - F.col("low_")
    v = F.when(share == 0, F.col("low_x")).otherwise((F.lit(1.0) - share) * F.col("low_x") + share * F.col("high_x"))
    many = both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", v.alias("v")))), lambda s: s["v"]).alias("quantiles"))
    return many if few is None else few.unionByName(many)


def select_ranks(state: DataFrame, targets: DataFrame, keys: list[str], limit: int, fan: int) -> DataFrame:
    """keys, rank_, x_: the values at ranks (from 0). state: keys, piece_, x_ (distinct), c_ (its count);
    targets: keys, piece_, rank_ and ahead_ (rows before the piece)."""
    place = [*keys, "piece_"]
    out = None
    for round_ in range(64):
        pieces = state.groupBy(*place).agg(F.count("*").alias("d_"), F.percentile_approx("x_", [i / fan for i in range(1, fan)], 10_000).alias("cuts_"))
        pieces = cut(pieces, f"pieces{round_}")
        done = pieces.where(F.col("d_") <= limit).select(*place)
        ranked = state.join(_small(done), place)
        upto = Window.partitionBy(*place).orderBy("x_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumn("upto_", F.sum("c_").over(upto))
        met = ranked.join(_small(targets), place).where((F.col("rank_") - F.col("ahead_") < F.col("upto_")) & (F.col("rank_") - F.col("ahead_") >= F.col("upto_") - F.col("c_")))
        met = cut(met.select(*keys, "rank_", "x_"), f"found{round_}")
        out = met if out is None else out.unionByName(met)
        open_ = pieces.where(F.col("d_") > limit).select(*place, "cuts_")
        if open_.isEmpty():
            return out
        ranged = state.join(_small(open_), place).withColumn("range_", F.size(F.filter("cuts_", lambda q: F.col("x_") > q))).drop("cuts_")
        counts = cut(ranged.groupBy(*place, "range_").agg(F.sum("c_").alias("in_")), f"ranges{round_}")
        before = Window.partitionBy(*place).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most ``fan`` rows
        counts = counts.withColumn("before_", F.coalesce(F.sum("in_").over(before), F.lit(0)))
        own = F.col("rank_") - F.col("ahead_") - F.col("before_")
        hit = targets.join(counts, place).where((own >= 0) & (own < F.col("in_")))
        next_ = (F.col("piece_") * fan + F.col("range_")).alias("piece_")
        hit = cut(hit.select(*place, "range_", "rank_", (F.col("ahead_") + F.col("before_")).alias("ahead_")), f"hits{round_}")
        state = cut(ranged.join(_small(hit.select(*place, "range_").distinct()), [*place, "range_"]).select(*keys, next_, "x_", "c_"), f"state{round_}")
        targets = hit.select(*keys, next_, "rank_", "ahead_")
    raise RuntimeError("ranges don't shrink")


def median(df: DataFrame, value: Column | str, by: list[str] | None = None, out: str = "median", **kw) -> DataFrame:
    found = quantiles(df, value, [0.5], by, **kw)
    return found.select(*(by or []), F.get("quantiles", F.lit(0)).alias(out))
