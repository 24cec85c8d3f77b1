"""Scalar functions of the evidence model, as Spark columns. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """Non-finite values become 0."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def ratio(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b; ``default`` (null if none) where b is 0 or either is missing."""
    x = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def correlation(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """Pearson's correlation as an aggregate; ``default`` where either is constant or there are no pairs."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    sa, sb = F.stddev_pop(F.when(both, a)), F.stddev_pop(F.when(both, b))
    return F.coalesce(F.when((sa > 1e-12) & (sb > 1e-12), F.try_divide(F.covar_pop(a, b), sa * sb)), F.lit(default))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def logit(p: Column | str) -> Column:
    p = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -60.0, 60.0)))


def temper(p: Column | str, vacuity: Column | str, penalty: float = 3.0) -> Column:
    """Pulls p toward 0.5 by its vacuity."""
    w = F.lit(1.0) / (F.lit(1.0) + F.lit(penalty) * clip(vacuity, 0.0, 1.0))
    return clip(F.lit(0.5) + (col(p) - F.lit(0.5)) * w, 1e-6, 1 - 1e-6)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_hex(h: Column | str) -> Column:
    """A 64-bit hash (two's complement) as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(col(h))), 16, "0")


def hex_hash(x: Column | str) -> Column:
    return F.conv(col(x), 16, -10).cast("long")


def pack_bits(bits: Column | str) -> Column:
    """An array of 64 zeros and ones to a 64-bit hash, the first bit highest."""
    return F.aggregate(col(bits), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row: a lambda's variable isn't inlined, as a
    column of a lower projection may be into a lambda, where it is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def threshold_bits(values: Column | str) -> Column:
    """1 where a value exceeds the median of all but the first."""

    def bits(v: Column) -> Column:
        rest = F.sort_array(F.slice(v, 2, F.size(v) - 1))
        middle = F.element_at(rest, ((F.size(rest) + 1) / 2).cast("int"))
        return let(middle, lambda m: F.transform(v, lambda x: (x > m).cast("int")))

    return let(col(values), bits)


def sequence_distance(a: Column | str, b: Column | str) -> Column:
    """Mean over the shorter sequence of the least Hamming distance in the window around the
    proportional place of the longer, over 64; 1 if either is empty."""
    a, b = col(a), col(b)
    swap = F.size(a) <= F.size(b)
    short, long_ = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    pair = F.array(F.struct(short.alias("s"), long_.alias("l"), F.size(short).alias("n"), F.size(long_).alias("m")))

    def distance(p: Column) -> Column:
        window = F.greatest(F.lit(1), F.floor(p["m"] / p["n"]).cast("int"))

        def least(h: Column, i: Column) -> Column:
            centre = F.when(p["n"] == 1, F.lit(0)).otherwise(F.floor(i * (p["m"] - 1) / F.greatest(F.lit(1), p["n"] - 1)).cast("int"))
            low, high = F.greatest(F.lit(0), centre - window), F.least(p["m"], centre + window + 1)
            return F.array_min(F.transform(F.slice(p["l"], low + 1, high - low), lambda x: F.bit_count(x.bitwiseXOR(h)).cast("int")))

        total = F.aggregate(F.transform(p["s"], least), F.lit(0).cast("long"), lambda t, x: t + x)
        return F.when(p["n"] == 0, F.lit(1.0)).otherwise(total / p["n"] / F.lit(64.0))

    return F.transform(pair, distance)[0]


def sample_places(total: Column | str, n: int) -> Column:
    """Places of n frames spread over total; all where there are no more than n."""
    total = col(total)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / F.lit(max(n - 1, 1))).cast("int")))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= n, F.sequence(F.lit(0), (F.greatest(total, F.lit(1)) - 1).cast("int"))).otherwise(spread)


def half_even(x: Column | str, places: int = 0) -> Column:
    """Rounds halves to the even neighbour, as reports do."""
    return F.bround(col(x), places)


def utc_text(us: Column | str) -> Column:
    """Microseconds since 1970 as ISO 8601 in UTC, to the millisecond."""
    seconds = (col(us) / F.lit(1000000)).cast("decimal(18,6)")
    return F.date_format(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def luma(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    return F.lit(0.299) * col(red) + F.lit(0.587) * col(green) + F.lit(0.114) * col(blue)
