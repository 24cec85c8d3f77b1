"""Sequence operators over rows (clip, t, value): differences, smoothing, runs, lags, intervals.

All are windows within a clip or equi-joins; nothing crosses clips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.operators.quantiles import median
from attestra.session import cut


def over(clip: str, t: str):
    return Window.partitionBy(clip).orderBy(t)


def differences(df: DataFrame, clip: str, t: str, x: str) -> DataFrame:
    """Adds d1 = x[t+1] - x[t] and d2 = x[t+2] - 2 x[t+1] + x[t]; null at the end."""
    w = over(clip, t)
    a, b = F.lead(x, 1).over(w), F.lead(x, 2).over(w)
    return df.withColumns({"d1": a - F.col(x), "d2": b - F.lit(2) * a + F.col(x)})


def moving_average(df: DataFrame, clip: str, t: str, x: str, size: int, out: str) -> DataFrame:
    """Centred mean of ``size`` values; the ends are repeated where the window leaves the clip."""
    half = size // 2
    w = over(clip, t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(clip)), "__first": F.first(x).over(whole), "__last": F.last(x).over(whole)})
    inner = F.sum(x).over(w.rowsBetween(-half, half))
    before, after = F.greatest(F.lit(half + 1) - F.col("__i"), F.lit(0)), F.greatest(F.col("__i") + half - F.col("__n"), F.lit(0))
    return df.withColumn(out, (inner + before * F.col("__first") + after * F.col("__last")) / F.lit(float(size))).drop("__i", "__n", "__first", "__last")


def runs(df: DataFrame, clip: str, t: str, flag: str) -> DataFrame:
    """Gaps and islands: start, stop (exclusive, in row places) and length of each run of true."""
    w = over(clip, t)
    placed = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("isle", F.col("pos") - F.sum(F.col(flag).cast("int")).over(w))
    return placed.where(flag).groupBy(clip, "isle").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("*").alias("length")).drop("isle")


def merge_intervals(df: DataFrame, clip: str) -> DataFrame:
    """df: start_s, end_s, corr, lag, severity. Intervals that touch or overlap become one, with the
    least correlation, the lag of greatest size and the highest severity."""
    w = Window.partitionBy(clip).orderBy("start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(before.isNull() | (F.col("start_s") > before), 1).otherwise(0)).withColumn("isle", F.sum("new").over(w))
    lag = F.max_by("lag", F.struct(F.abs("lag"), -F.col("start_s")))
    return marked.groupBy(clip, "isle").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min("corr").alias("corr"), lag.alias("lag"), F.max("severity").alias("severity")).drop("isle")


def zscore(df: DataFrame, clip: str, x: str, out: str) -> DataFrame:
    w = Window.partitionBy(clip)
    sd = F.stddev_pop(x).over(w)
    return df.withColumn(out, (F.col(x) - F.avg(x).over(w)) / F.when(sd > 1e-12, sd).otherwise(F.lit(1.0)))


def cross_correlation(df: DataFrame, clip: str, t: str, a: str, b: str, most: int) -> DataFrame:
    """Correlation of a[t] with b[t + lag] for each lag up to ``most`` either way, centred on the overlap;
    0 with fewer than 4 pairs or a constant side. Lags are exploded and met by an equi-join on time."""
    left = df.select(clip, F.col(t).cast("long").alias("t"), F.col(a).alias("a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("at", F.col("t") + F.col("lag"))
    right = df.select(clip, F.col(t).cast("long").alias("at"), F.col(b).alias("b"))
    pairs = left.join(right, [clip, "at"])
    c = pairs.groupBy(clip, "lag").agg(F.count("*").alias("n"), X.correlation("a", "b").alias("c"))
    return c.select(clip, "lag", F.when(F.col("n") < 4, F.lit(0.0)).otherwise(F.col("c")).alias("corr"))


def peak(df: DataFrame, clip: str) -> DataFrame:
    """The first greatest lag, its value, prominence and the value at lag 0."""
    sd = F.stddev_pop("corr")
    return df.groupBy(clip).agg(
        F.max("corr").alias("peak"), F.max_by("lag", F.struct(F.round("corr", 9), -F.col("lag"))).alias("lag"), ((F.max("corr") - F.avg("corr")) / F.when(sd > 1e-12, sd).otherwise(F.lit(1.0))).alias("prominence"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("at_zero")
    )


#: Rows that a window needs.
LEAST = 8


def hopping(df: DataFrame, clip: str, t: str, size: int, hop: int) -> DataFrame:
    """Rows with the start of each whole window [start, start + size) over them; row places from 0. A clip of fewer
    than ``size`` rows is one window if it has :data:`LEAST` of them."""
    n = df.groupBy(clip).agg((F.max(t) + 1).alias("n"))
    lowest = F.greatest(F.lit(0), F.ceil((F.col(t) - (size - 1)) / F.lit(hop)) * hop)
    highest = F.least(F.floor(F.col(t) / F.lit(hop)) * hop, F.greatest(F.lit(0), F.floor((F.col("n") - size) / F.lit(hop)) * hop))
    found = df.join(n, clip).where(F.col("n") >= min(LEAST, size)).where(lowest <= highest)
    return found.withColumn("start", F.explode(F.sequence(lowest.cast("long"), highest.cast("long"), F.lit(hop).cast("long")))).drop("n")


def window_correlation(df: DataFrame, clip: str, t: str, a: str, b: str, size: int, hop: int, most: int) -> DataFrame:
    """clip, start, lag, corr: the correlation of a[t] with b[t + lag] within each window of :func:`hopping`, for lags
    up to ``most`` either way; 0 with fewer than 4 pairs or a constant side. Rows are (t = 0, 1, ...) without gaps.

    A row meets each lag once, whatever the windows over it: sums run along the pairs of one lag, and a window is the
    difference of two of them. Values are taken from the clip's mean first, so that differences keep their digits;
    whether a side is constant is counted, not computed."""
    whole = Window.partitionBy(clip)
    rows = df.select(clip, F.col(t).cast("long").alias("t"), (F.col(a) - F.avg(a).over(whole)).alias("a"), (F.col(b) - F.avg(b).over(whole)).alias("b"), F.count("*").over(whole).alias("n")).where(F.col("n") >= min(LEAST, size))
    by_t = Window.partitionBy(clip).orderBy("t")
    steps = {"da": (F.col("a") != F.lag("a").over(by_t)).cast("long"), "db": (F.col("b") != F.lag("b").over(by_t)).cast("long")}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in steps.items()})
    left = rows.select(clip, "t", "n", "a", "da", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("at", F.col("t") + F.col("lag"))
    pairs = left.join(rows.select(clip, F.col("t").alias("at"), "b", "db"), [clip, "at"])
    sums = {"s1": F.lit(1), "sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b"), "ca": F.col("da"), "cb": F.col("db")}
    along = Window.partitionBy(clip, "lag").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = pairs.withColumns({k: F.sum(v).over(along) for k, v in sums.items()})
    # Pairs of a window: t from start + max(0, -lag) on, up to before stop - max(0, lag).
    width = F.least(F.lit(size), F.col("n"))
    last_start = F.greatest(F.lit(0), F.floor((F.col("n") - size) / F.lit(hop)) * hop)
    head, tail = F.greatest(F.lit(0), -F.col("lag")), F.greatest(F.lit(0), F.col("lag"))
    first_of = F.col("t") - head  # the window that begins with this pair
    last_of = F.col("t") + 1 + tail - width  # the one that ends with it
    is_start = lambda s: (s >= 0) & (s <= last_start) & (s % hop == 0)
    # The sums before the first pair are those of its row less its own, but its changes are none of the window's.
    own = {k: F.col(k) if k in ("ca", "cb") else F.col(k) - v for k, v in sums.items()}
    edges = F.array(
        F.when(is_start(last_of), F.struct(last_of.cast("long").alias("start"), *[F.col(k).cast("double").alias(k) for k in sums])),
        F.when(is_start(first_of), F.struct(first_of.cast("long").alias("start"), *[(-v).cast("double").alias(k) for k, v in own.items()])),
    )
    e = run.select(clip, "lag", F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("e")).groupBy(clip, "e.start", "lag").agg(F.count("*").alias("ends"), *[F.sum(F.col("e")[k]).alias(k) for k in sums])
    n = F.col("s1")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    corr = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb)
    flat = (F.col("ca") == 0) | (F.col("cb") == 0) | (va <= 0) | (vb <= 0)
    return e.where("ends = 2").select(clip, "start", "lag", F.when((n < 4) | flat, F.lit(0.0)).otherwise(corr).alias("corr"))


def interpolate(points: DataFrame, at: DataFrame, clip: str, t: str, x: str) -> DataFrame:
    """x at the times ``at`` (clip, t): linear between the points around, clamped at the ends."""
    both = points.select(clip, F.col(t).alias("t"), F.col(x).alias("x"), F.lit(False).alias("asked")).unionByName(at.select(clip, F.col(t).alias("t"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("asked")))
    known = F.when(F.col("x").isNotNull(), F.struct("t", "x"))
    w = Window.partitionBy(clip).orderBy("t", "asked")
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    j = both.withColumns({"p": before, "q": after}).where("asked")
    span = F.col("q.t") - F.col("p.t")
    value = F.when(F.col("p").isNull(), F.col("q.x")).when(F.col("q").isNull() | (span == 0), F.col("p.x")).otherwise(F.col("p.x") + (F.col("q.x") - F.col("p.x")) * (F.col("t") - F.col("p.t")) / span)
    return j.select(clip, "t", value.alias("x"))


def mutual_information(df: DataFrame, clip: str, a: str, b: str, bins: int = 8) -> DataFrame:
    """In bits over a bins x bins histogram of the values' ranges; 0 with fewer than 16 rows."""
    w = Window.partitionBy(clip)

    def place(x: str) -> Column:
        low, high = F.min(x).over(w), F.max(x).over(w)
        return F.least(F.floor((F.col(x) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)) * bins), F.lit(bins - 1))

    cells = df.select(clip, place(a).alias("i"), place(b).alias("j")).groupBy(clip, "i", "j").agg(F.count("*").alias("n"))
    rows = cells.withColumns({"all": F.sum("n").over(w), "ni": F.sum("n").over(Window.partitionBy(clip, "i")), "nj": F.sum("n").over(Window.partitionBy(clip, "j"))})
    part = F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("ni") * F.col("nj")))
    return rows.groupBy(clip).agg(F.when(F.max("all") < 16, F.lit(0.0)).otherwise(F.greatest(F.sum(part), F.lit(0.0))).alias("mi"))


def entropy(df: DataFrame, clip: str, value: str, bins: int) -> DataFrame:
    """Shannon entropy of the classes of ``value``, over log2(bins)."""
    g = df.groupBy(clip, value).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(clip)))
    return g.groupBy(clip).agg((F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(float(bins)))).alias("entropy"))


def resultant(df: DataFrame, clip: str, angle: str, weight: str) -> DataFrame:
    """Length of the weighted mean of unit vectors: 1 where all angles agree, near 0 where they are spread; 0 without weight."""
    a, w = F.col(angle), F.col(weight)
    return df.groupBy(clip).agg(X.ratio(F.sqrt(F.pow(F.sum(w * F.cos(a)), 2) + F.pow(F.sum(w * F.sin(a)), 2)), F.sum(w), 0.0).alias("resultant"))


def smoothness(df: DataFrame, clip: str, t: str, x: str) -> DataFrame:
    """mean |change| over mean."""
    step = df.withColumn("step", F.abs(F.col(x) - F.lag(x).over(over(clip, t))))
    return step.groupBy(clip).agg((F.avg("step") / F.when(F.abs(F.avg(x)) > 1e-12, F.avg(x)).otherwise(F.lit(1.0))).alias("smoothness"))


def robust_spread(df: DataFrame, clip: str, x: str) -> DataFrame:
    """Median and 1.4826 * median absolute deviation (the deviation where that is none)."""
    m = median(df, x, [clip], "med").join(df.groupBy(clip).agg(F.stddev_pop(x).alias("sd")), clip)
    away = median(df.select(clip, F.col(x).alias("x")).join(m, clip), F.abs(F.col("x") - F.col("med")), [clip], "mad")
    g = m.join(away, clip).withColumnRenamed("med", "median")
    return g.select(clip, "median", F.when(F.col("mad") > 1e-12, F.col("mad") * F.lit(1.4826)).otherwise(F.col("sd")).alias("spread"))


def self_similarity(df: DataFrame, clip: str, t: str, vector: str, least_gap: int = 2) -> DataFrame:
    """Pairs, mean cosine of the vectors of one clip at least ``least_gap`` steps apart (0 with a zero vector), and
    its slope over the gap. ``t`` is distinct within a clip.

    No pair is formed but the near ones that are left out: the sum of all cosines is half of what the squared sum of
    the unit vectors has over their number, and the sum of gap times cosine comes from sums that run along t in each
    dimension. Rows are frames times dimensions."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    base = df.select(clip, F.col(t).cast("long").alias("t"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    base = base.withColumn("size_", F.sqrt(dot(F.col("v"), F.col("v"))))
    unit = base.select(clip, "t", F.when(F.col("size_") > 0, F.transform("v", lambda x: x / F.col("size_"))).otherwise(F.transform("v", lambda x: F.lit(0.0))).alias("u"))
    place = unit.select(clip, "t").withColumn("k", F.row_number().over(over(clip, "t")) - 1)
    times = place.groupBy(clip).agg(F.count("*").cast("double").alias("n"), F.sum("t").cast("double").alias("st"), F.sum(F.col("t").cast("double") * F.col("t")).alias("stt"), F.sum(F.col("k").cast("double") * F.col("t")).alias("skt"))
    long = unit.select(clip, "t", F.posexplode("u").alias("d", "x"))
    before = Window.partitionBy(clip, "d").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.withColumns({"p": F.coalesce(F.sum("x").over(before), F.lit(0.0)), "q": F.coalesce(F.sum(F.col("x") * F.col("t")).over(before), F.lit(0.0))})
    every = sums.groupBy(clip).agg(F.sum(F.col("x") * F.col("p")).alias("c"), F.sum(F.col("x") * (F.col("t") * F.col("p") - F.col("q"))).alias("gc"))
    # Pairs that are too near.
    later = unit.select(clip, F.col("t").alias("at"), F.col("u").alias("w"))
    near = unit.select(clip, "u", "t", F.explode(F.sequence(F.lit(1), F.lit(max(least_gap - 1, 1)))).alias("gap")).where(F.col("gap") < least_gap).withColumn("at", F.col("t") + F.col("gap")).join(later, [clip, "at"])
    near = near.groupBy(clip).agg(F.count("*").alias("m"), F.sum("gap").alias("mg"), F.sum(F.col("gap") * F.col("gap")).alias("mgg"), F.sum(dot(F.col("u"), F.col("w"))).alias("mc"), F.sum(F.col("gap") * dot(F.col("u"), F.col("w"))).alias("mgc"))
    a = every.join(times, clip).join(near, clip, "left").na.fill(0, ["m", "mg", "mgg", "mc", "mgc"])
    n = F.col("n")
    pairs = n * (n - 1) / 2 - F.col("m")
    gaps = 2 * F.col("skt") - (n - 1) * F.col("st") - F.col("mg")
    squares = n * F.col("stt") - F.col("st") * F.col("st") - F.col("mgg")
    cosines, crossed = F.col("c") - F.col("mc"), F.col("gc") - F.col("mgc")
    spread = squares - gaps * gaps / pairs
    slope = F.when((pairs > 1) & (spread > 1e-9), (crossed - gaps * cosines / pairs) / spread)
    return a.where(pairs > 0).select(clip, pairs.cast("long").alias("pairs"), (cosines / pairs).alias("mean_cos"), slope.alias("slope"))


def similarity_entropy(df: DataFrame, clip: str, t: str, vector: str, least_gap: int = 2, bins: int = 16, block: int = 2048) -> DataFrame:
    """clip, entropy: of the histogram of cosines at least ``least_gap`` steps apart over ``bins`` bins of [-1, 1], in bits,
    over log2(bins). Frames are put into blocks of neighbours, and each pair of blocks is a task's product of two
    matrices: no task has more than two blocks of a clip, and only counts leave it."""
    placed = df.select(clip, F.col(t).cast("long").alias("t"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("b", F.floor(F.col("t") / block).cast("long"))
    blocks = placed.groupBy(clip, "b").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("rows"))
    blocks = cut(blocks.select(clip, "b", F.col("rows.t").alias("ts"), F.col("rows.v").alias("vs")), "similarity-blocks")
    others = blocks.select(clip, F.col("b").alias("c"))
    jobs = blocks.select(clip, "b").join(others, clip).where("c >= b")  # a row a pair of blocks
    both = jobs.join(blocks, [clip, "b"]).join(blocks.select(clip, F.col("b").alias("c"), F.col("ts").alias("ts2"), F.col("vs").alias("vs2")), [clip, "c"])
    kind = df.schema[clip].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t1, t2 = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("ts", "ts2"))
                x, y = (np.array(batch.column(c)[i].as_py(), float).reshape(len(n), -1) for c, n in (("vs", t1), ("vs2", t2)))
                x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
                cos = (x @ y.T)[t2[None, :] - t1[:, None] >= least_gap]
                # Rounded, so that equal vectors are in one bin whatever the last digit says.
                count = np.bincount(np.clip(np.floor((np.round(cos, 12) + 1) * bins / 2), 0, bins - 1).astype(int), minlength=bins)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i] * bins)), pa.array(range(bins), pa.int32()), pa.array(count, pa.int64())], names=["key", "bin", "n"])

    counted = both.select(F.col(clip).alias("key"), "ts", "vs", "ts2", "vs2").mapInArrow(run, f"key {kind}, bin int, n long").groupBy("key", "bin").agg(F.sum("n").alias("n")).where("n > 0")
    p = F.col("n") / F.sum("n").over(Window.partitionBy("key"))
    return counted.withColumn("p", p).groupBy(F.col("key").alias(clip)).agg((F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(float(bins)))).alias("entropy"))
