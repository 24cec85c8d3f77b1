"""Custody: Merkle trees, inclusion proofs, hash chains and their verification.

Trees of one row a track are arrays folded by higher-order functions (tracks of any size: ``merkle``);
chains are folded in order (``ledger``). Verification needs no fold: each entry is checked against the
one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.ledger import GENESIS, fold

#: The prefixes of leaves and nodes.
LEAF, NODE = "00", "01"


def leaf_hash(data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit(LEAF)), data.cast("binary")), 256)


def _node_sql(left: str, right: str) -> str:
    return f"sha2(concat(unhex('{NODE}'), unhex({left}), unhex({right})), 256)"


def _up_sql(a: str) -> str:
    """One level up from the array named ``a``: pairs of neighbours; an odd last node is paired with itself."""
    pair = _node_sql(f"{a}[2 * i]", f"{a}[least(2 * i + 1, size({a}) - 1)]")
    return f"if(size({a}) <= 1, {a}, transform(sequence(0, cast((size({a}) - 1) div 2 as int)), i -> {pair}))"


def merkle_root(leaves: str, most_levels: int = 40) -> Column:
    """Root of an array of leaf hashes (hex); null for none. Levels beyond the root change nothing."""
    return F.expr(f"aggregate(sequence(1, {most_levels}), {leaves}, (a, k) -> {_up_sql('a')}, a -> get(a, 0))")


def merkle_levels(leaves: str) -> Column:
    """All levels, leaves first, up to the root."""
    count = f"cast(ceil(log2(greatest(size({leaves}), 1))) as int)"
    step = f"concat(acc, transform(array(element_at(acc, -1)), top -> {_up_sql('top')}))"
    return F.expr(f"if({count} = 0, array({leaves}), aggregate(sequence(1, {count}), array({leaves}), (acc, k) -> {step}))")


def inclusion_proof(levels: str, index: str) -> Column:
    """Siblings from leaf to root: hash and side."""
    at = f"shiftright({index}, k)"
    sibling = f"({at} ^ 1)"
    inner = f"named_struct('hash', lv[least({sibling}, size(lv) - 1)], 'side', if({sibling} > {at}, 'right', 'left'))"
    return F.expr(f"transform(slice({levels}, 1, size({levels}) - 1), (lv, k) -> {inner})")


def proof_root(leaf: str, path: str) -> Column:
    return F.expr(f"aggregate({path}, {leaf}, (h, s) -> if(s.side = 'right', {_node_sql('h', 's.hash')}, {_node_sql('s.hash', 'h')}))")


def combined_root(video: Column, audio: Column, context: Column, tag: str = "custody-root") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(tag), video, audio, context), 256)


def entry_hash(index: Column, prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", index.cast("string"), prev, body), 256)


def build_chain(rows: DataFrame, chain: str, seq: str, body: str) -> DataFrame:
    """Ledger entries of each chain in order of ``seq``: index, prev_hash, payload, entry_hash."""
    return fold(rows, chain, seq, body)


def check_chain(ledger: DataFrame, chain: str) -> DataFrame:
    """Each chain's length, whether it is intact, the first broken place and why (index, then prev, then digest).
    The place of an entry is its order as stored, column ``pos``."""
    w = Window.partitionBy(chain).orderBy("pos")
    place = F.row_number().over(w) - 1
    prev = F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    marked = ledger.withColumns({"place": place, "want": prev})
    reason = (
        F.when(F.col("index") != F.col("place"), "index")
        .when(F.col("prev_hash") != F.col("want"), "prev_hash")
        .when(F.col("entry_hash") != entry_hash(F.col("index"), F.col("prev_hash"), F.col("payload")), "digest")
    )
    broken = marked.withColumn("reason", reason)
    bad = F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))
    return broken.groupBy(chain).agg(F.count("*").alias("entries"), F.min(bad).alias("bad")).select(chain, "entries", F.col("bad").isNull().alias("valid"), F.col("bad.place").alias("broken_at"), F.col("bad.reason").alias("reason"))


def tampered(ledger: DataFrame, kind: str, at: int = 1) -> DataFrame:
    """A copy with one entry changed, deleted, or exchanged with the next."""
    if kind == "modify":
        return ledger.withColumn("payload", F.when(F.col("index") == at, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    if kind == "delete":
        return ledger.where(F.col("index") != at)
    if kind == "reorder":
        return ledger.withColumn("pos", F.when(F.col("pos") == at, at + 1).when(F.col("pos") == at + 1, at).otherwise(F.col("pos")))
    raise ValueError(kind)


def changed_leaves(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves of the same track and place whose hashes differ, or that one side lacks."""
    j = before.withColumnRenamed("leaf", "l").join(after.withColumnRenamed("leaf", "r"), keys, "full")
    return j.where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys)
