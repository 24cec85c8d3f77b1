"""Merkle trees by levels, for tracks of any number of leaves.

A round folds blocks of neighbouring nodes by several levels at once (an array of bounded size) and
hands on one node a block, so a tree of n leaves takes log(n) / bits rounds, each of which has that
much fewer rows. An odd last node of a level is paired with itself, as the definition has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.custody import _node_sql
from attestra.session import scratch

#: Levels of a round; where a leaf's siblings are wanted as well, blocks are smaller as each leaf reads its own.
ROOT_BITS, PROOF_BITS = 12, 6


def _levels(bits: int) -> str:
    """The levels of ``nodes``, ``up`` of them above it. Every step goes up, also from a single node."""
    pair = _node_sql("top[2 * i]", "top[least(2 * i + 1, size(top) - 1)]")
    step = f"concat(acc, transform(array(element_at(acc, -1)), top -> transform(sequence(0, cast((size(top) - 1) div 2 as int)), i -> {pair})))"
    return f"if(up = 0, array(nodes), aggregate(sequence(1, up), array(nodes), (acc, k) -> {step}))"


def _rounds(leaves: DataFrame, track: str, i: str, leaf: str, bits: int, keep_levels: bool):
    """Written tables, one a round: track, block, height (levels above the nodes), n (leaves) and levels (or the top alone)."""
    spark = leaves.sparkSession
    sizes = leaves.groupBy(track).agg(F.count("*").alias("n"))
    state = leaves.select(track, F.col(i).cast("long").alias("i"), F.col(leaf).alias("h")).join(sizes, track)
    state = state.withColumn("height", F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    at = 0
    while True:
        blocks = state.groupBy(track, "n", "height", F.shiftright("i", bits).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("nodes"))
        levels = F.expr(_levels(bits))
        blocks = blocks.withColumn("up", F.least("height", F.lit(bits))).withColumn("levels", levels if keep_levels else F.slice(levels, -1, 1))
        path = scratch(spark, f"merkle-{at}")
        blocks.select(track, "n", "height", "block", "up", "levels").write.parquet(path)
        blocks = spark.read.parquet(path)
        yield blocks
        above = blocks.where(F.col("height") > bits)
        if above.isEmpty():
            return
        state = above.select(track, F.col("block").alias("i"), F.get(F.element_at("levels", -1), F.lit(0)).alias("h"), "n", (F.col("height") - bits).alias("height"))
        at += 1


def roots(leaves: DataFrame, track: str, i: str, leaf: str, bits: int = ROOT_BITS) -> DataFrame:
    """track, n_leaves, root. Leaves: places 0, 1, ... of each track, and their hashes (hex)."""
    out = None
    for blocks in _rounds(leaves, track, i, leaf, bits, False):
        done = blocks.where(F.col("height") <= bits).select(track, F.col("n").alias("n_leaves"), F.get(F.element_at("levels", -1), F.lit(0)).alias("root"))
        out = done if out is None else out.unionByName(done)
    return out


def proofs(leaves: DataFrame, track: str, i: str, leaf: str, bits: int = PROOF_BITS) -> DataFrame:
    """track, i, leaf, path (hash and side of each sibling, from the leaf up) and root."""
    sibling = "(shiftright(p, k) ^ 1)"
    inner = f"named_struct('hash', lv[least({sibling}, size(lv) - 1)], 'side', if({sibling} > shiftright(p, k), 'right', 'left'))"
    piece = F.expr(f"transform(slice(levels, 1, size(levels) - 1), (lv, k) -> {inner})")
    out = None
    for round_, blocks in enumerate(_rounds(leaves, track, i, leaf, bits, True)):
        below = blocks.select(track, "block", "height", "levels", F.posexplode(F.get("levels", F.lit(0))).alias("p", "h"))
        own = below.select(track, (F.shiftleft("block", bits) + F.col("p")).alias("at"), "h", piece.alias("piece"), F.when(F.col("height") <= bits, F.get(F.element_at("levels", -1), F.lit(0))).alias("top"))
        if round_ == 0:
            out = own.select(track, F.col("at").alias("i"), F.col("h").alias("leaf"), F.col("piece").alias("path"), F.col("top").alias("root"))
            continue
        higher = own.select(track, F.col("at").alias("at_"), "piece", "top")
        joined = out.withColumn("at_", F.when(F.col("root").isNull(), F.shiftright("i", bits * round_))).join(higher, [track, "at_"], "left")
        out = joined.select(track, "i", "leaf", F.concat("path", F.coalesce("piece", F.array().cast("array<struct<hash:string,side:string>>"))).alias("path"), F.coalesce("root", "top").alias("root"))
    return out
