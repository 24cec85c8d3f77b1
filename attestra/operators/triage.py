"""Recognition of known clips: exact and perceptual lookup, registry upsert.

Everything is a join on hashes. In the similarity join, hashes within d bits of each other differ
by d // 4 bits at most in one of their four quarters, so an equi-join on the quarters and their
neighbours loses no pair; crowded quarters are met by two.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.session import cut


def exact_triage(clips: DataFrame, sha: str = "sha", seq: str = "seq") -> DataFrame:
    """Clips in order of arrival: the first of a hash is analysed, later ones hit it.
    Adds first_seq and action."""
    first = clips.groupBy(sha).agg(F.min(seq).alias("first_seq"))
    return clips.join(first, sha).withColumn("action", F.when(F.col(seq) == F.col("first_seq"), "miss").otherwise("exact_hit"))


def stale_triage(clips: DataFrame, registry: DataFrame, schema: str, digest: str, sha: str = "sha") -> DataFrame:
    """Looks clips up in a registry (sha, feature_schema, config_digest); a hit under another
    schema or configuration is stale and doesn't short-circuit."""
    found = clips.join(registry.select(sha, "feature_schema", "config_digest", F.lit(True).alias("known")), sha, "left")
    stale = (F.col("feature_schema") != F.lit(schema)) | (F.col("config_digest") != F.lit(digest))
    action = F.when(F.col("known").isNull(), "miss").when(stale, "stale").otherwise("exact_hit")
    return found.withColumn("action", action).withColumn("short_circuit", F.col("action") == "exact_hit").drop("known")


def upsert_latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Last writer wins: the row of the highest ``seq`` of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def quarters(h):
    """(number, value) of the four 16-bit parts of a 64-bit hash."""
    return F.array(*[F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(h, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(4)])


def probes(h, bits: int):
    """The quarters of all hashes whose quarter differs from h's by at most bits // 4 bits: two hashes within
    ``bits`` differ by so few in one quarter at least."""
    near = [sum(1 << b for b in c) for r in range(bits // 4 + 1) for c in combinations(range(16), r)]
    masks = F.array(*[F.lit(m).cast("long") for m in near])
    return F.flatten(F.transform(quarters(h), lambda q: F.transform(masks, lambda m: F.struct(q["part"].alias("part"), q["value"].bitwiseXOR(m).alias("value")))))


#: Distinct hashes of one quarter beyond which two quarters are asked for, and keys of a broadcast table.
HEAVY, KEYS = 20_000, 50_000


def hamming_distinct(left: DataFrame, right: DataFrame, bits: int, heavy: int = HEAVY) -> DataFrame:
    """ha, hb, bits: pairs of distinct hashes (column h of each side, distinct in itself) within ``bits`` bits.

    A key of one quarter holds 1 / 65536 of evenly spread hashes. Where one holds more than ``heavy`` on the right (blank
    frames), a pair that meets in it agrees within bits // 3 bits in one of the other three quarters as well, so keys
    of two quarters replace it: no pair is lost, and one value of a quarter is no longer one task. A pair that meets in
    several keys counts in the first of them alone, so pairs needn't be gathered to drop repeats. Joins are merged:
    Spark's estimates don't see the rows that explode makes, and would broadcast all of them."""
    a = left.select(F.col("h").alias("ha"), F.explode(probes(F.col("h"), bits)).alias("k"))
    b = right.select(F.col("h").alias("hb"), F.explode(quarters(F.col("h"))).alias("k"))
    crowded = b.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("k")
    crowded = cut(crowded, "crowded")
    few = crowded.limit(KEYS + 1).count()
    differ = [F.bit_count(F.shiftrightunsigned(F.col("ha").bitwiseXOR(F.col("hb")), 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    first = lambda most, but=None: F.coalesce(*[F.when((n <= most) if but is None else (n <= most) & (but != i), i) for i, n in enumerate(differ)])
    near = lambda met: met.where((X.hamming("ha", "hb") <= bits) & (F.col("k.part") == first(bits // 4))).select("ha", "hb", X.hamming("ha", "hb").cast("long").alias("bits"))
    if not few:
        return near(a.join(b.hint("merge"), "k"))
    names = F.broadcast(crowded) if few <= KEYS else crowded
    light = a.join(names, "k", "left_anti").join(b.join(names, "k", "left_anti").hint("merge"), "k")
    second = lambda side, h, other: side.join(names, "k").select(h, "k", F.explode(other).alias("k2")).where(F.col("k2.part") != F.col("k.part"))
    wide = second(a, "ha", probes(F.col("ha"), bits // 3 * 4 + 3)).join(second(b, "hb", quarters(F.col("hb"))).hint("merge"), ["k", "k2"])
    return near(light).unionByName(near(wide.where(F.col("k2.part") == first(bits // 3, F.col("k.part")))))


def hamming_join(left: DataFrame, right: DataFrame, bits: int, left_id: str = "id", right_id: str = "other", h: str = "h", heavy: int = HEAVY) -> DataFrame:
    """left_id, right_id, bits: pairs within ``bits`` bits. Columns: id and hash on each side. Distinct hashes are
    compared once; their ids are joined to the pairs that are found. (Where equal hashes are many, so are their
    pairs: see :func:`hamming_groups`.)"""
    a, b = left.select(F.col(left_id), F.col(h).alias("ha")).distinct(), right.select(F.col(right_id), F.col(h).alias("hb")).distinct()
    pairs = hamming_distinct(a.select(F.col("ha").alias("h")).distinct(), b.select(F.col("hb").alias("h")).distinct(), bits, heavy)
    found = pairs.join(a, "ha").join(b, "hb").select(left_id, right_id, "bits")
    # Ids of one hash each have a pair once.
    several = any(not side.groupBy(id_).count().where("count > 1").isEmpty() for side, id_ in ((a, left_id), (b, right_id)))
    return found.distinct() if several else found


def hamming_groups(rows: DataFrame, bits: int, id_: str = "id", h: str = "h", heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """The same within one table without a row for each pair of copies: membership (id, representative: the least
    id of its hash, and members) and pairs of representatives (low < high, bits)."""
    groups = rows.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(id_).alias("representative"), F.count("*").alias("members"))
    groups = cut(groups, "groups")
    membership = rows.select(F.col(id_), F.col(h).alias("h")).join(groups, "h").select(id_, "representative", "members")
    pairs = hamming_distinct(groups.select("h"), groups.select("h"), bits, heavy).where("ha <> hb")
    one, two = groups.select(F.col("h").alias("ha"), F.col("representative").alias("low")), groups.select(F.col("h").alias("hb"), F.col("representative").alias("high"))
    return membership, pairs.join(one, "ha").join(two, "hb").where("low < high").select("low", "high", "bits")


def top_candidates(pairs: DataFrame, left_id: str, right_id: str, k: int = 5) -> DataFrame:
    """The k nearest of each left id; adds rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(left_id).orderBy("bits", right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shortcircuit_policy(pairs: DataFrame, allow: bool, tight: float, same_config) -> DataFrame:
    """A perceptual candidate short-circuits only where allowed, tight and of the same configuration."""
    distance = F.col("bits") / F.lit(64.0)
    return pairs.withColumn("distance", distance).withColumn("short_circuit", F.lit(allow) & (distance <= F.lit(tight)) & same_config)


def sequence_candidates(queries: DataFrame, registry: DataFrame, most: float = 0.10, k: int = 5) -> DataFrame:
    """queries: id, video, audio; registry: other, video, audio (arrays of 64-bit hashes). The k nearest entries of
    each query by video sequence distance up to ``most``, with the audio distance (1 where a side is empty).

    A mean of at most 64 * most bits has a part of so many bits at most, so pairs meet by an equi-join on keys of
    single hashes; none within the distance is lost. Only they are verified in whole."""
    bits = int(64 * most)
    a = queries.select("id", F.explode(F.array_distinct("video")).alias("h")).select("id", F.explode(probes(F.col("h"), bits)).alias("k"), "h")
    b = registry.select("other", F.explode(F.array_distinct("video")).alias("g")).select("other", F.explode(quarters(F.col("g"))).alias("k"), "g")
    met = a.join(b.hint("merge"), "k").where(X.hamming("h", "g") <= bits).select("id", "other").distinct()
    both = met.join(queries, "id").join(registry.withColumnsRenamed({"video": "video2", "audio": "audio2"}), "other")
    audio = F.when((F.size("audio") == 0) | (F.size("audio2") == 0), F.lit(1.0)).otherwise(X.sequence_distance("audio", "audio2"))
    near = both.select("id", "other", X.sequence_distance("video", "video2").alias("video_distance"), audio.alias("audio_distance")).where(F.col("video_distance") <= most + 1e-12)
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.round("video_distance", 9), "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
