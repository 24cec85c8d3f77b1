"""Conversation prefix trie: distributed MSD radix partitioning over dictionary-encoded turn ids.

1. Distinct turns (role, text) get ids in their order (a table of digests and ids in the shared folder); conversations
   become arrays of ids, are rebuilt (below), and equal sequences become one row with their number,
   smallest conv_id and the digest of their ids.
2. All sequences start in one bucket. A bucket of more than :data:`LOCAL` sequences is split by its
   next id, in rounds over all such buckets: the longest prefix that all of its sequences share (that
   of its least and its greatest) is skipped at once, so rounds follow branchings and not turns. A
   bucket is named by the ids at which its branch was taken, so its ancestors are prefixes of its name.
3. Smaller buckets are finished in one task each by multikey quicksort; its recursion emits the nodes.
   The nodes along the shared prefix of a large bucket come from its aggregates.
4. What a bucket adds to the subtrees above it (leaves, saved words) is summed by prefix of its name.

A rebuilt conversation c has the first h turns of conversation c - c % 20, and then its own after its
first h, h = crc32(c as text) % 4 (``%`` has the sign of c). Turns are ordered by turn (null first),
role and text; a null role or text is empty.

Defined results: rows without conv_id are left out; repeated rows are turns of their own; a
conversation whose rebuilt form has no turn is a member of the root alone; the empty table gives no
rows. Columns besides conv_id, turn, role and text are not read. A conversation is held as ids (16 bytes
a turn) by one task; texts never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm import common

#: Sequences of a bucket that one task finishes.
LOCAL = 256
#: Large buckets whose names are broadcast; beyond it the sequences are joined by shuffle.
NAMES = 50_000
#: Conversations of an id range, joined to one piece of text for the digest: at most 2 ** RANGE.
RANGE = 12

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "path array<long>, top boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, ws: each conversation's turns as dictionary ids in order, and the words of each."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Texts travel to be told apart and put in order; turns and ids then meet by the texts' digests.
    named = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    dictionary = turns.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    dictionary = common.written(dictionary.select(named.alias("named"), F.monotonically_increasing_id().alias("id"), F.regexp_count("text", F.lit(common.SPACE_RULE)).cast("long").alias("n")), "trie-turns")
    own = turns.select("conv_id", "turn", named.alias("named")).join(dictionary, "named").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "n"))).alias("own"))
    return own.select("conv_id", F.col("own.id").alias("ids"), F.col("own.n").alias("ws"))


def rebuild(encoded: DataFrame) -> DataFrame:
    """Conversations with the head of their base."""
    heads = encoded.select(F.col("conv_id").alias("base"), F.slice("ids", 1, 3).alias("base_ids"), F.slice("ws", 1, 3).alias("base_ws"))
    keyed = encoded.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", common.crc_mod(4, "conv_id").cast("int")).join(heads, "base", "left")
    merged = lambda c: F.expr(f"concat(slice(coalesce(base_{c}, CAST(array() AS array<long>)), 1, h), slice({c}, h + 1, size({c})))").alias(c)
    return keyed.select("conv_id", merged("ids"), merged("ws"))


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: ids, ws, n (conversations), low (smallest conv_id), ends (digest of the conv_ids)."""
    pieces = convs.groupBy("ids", F.shiftright("conv_id", RANGE).alias("piece")).agg(
        F.any_value("ws").alias("ws"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ends")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, sha = None, None, None
        names = ["ids", "ws", "n", "low", "ends"]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            done = []
            for ids, ws, n, low, ends in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row is not None and ids == key:
                    row[2] += n
                    row[3] = min(row[3], low)
                    sha.update(b"," + ends.encode())
                    continue
                if row is not None:
                    done.append([*row, sha.hexdigest()])
                key, row, sha = ids, [ids, ws, n, low], hashlib.sha256(ends.encode())
            if done:
                yield batch(done)
        if row is not None:
            yield batch([[*row, sha.hexdigest()]])

    ordered = pieces.repartition("ids").sortWithinPartitions("ids", "piece").select("ids", "ws", "n", "low", "ends")
    return ordered.mapInArrow(digest, "ids array<long>, ws array<long>, n long, low long, ends string")


def finish(rows: list[tuple], depth: int, parent: int | None) -> list[list]:
    """Nodes of one bucket, its top last: conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends. A row is
    (ids, ws, n, low, ends); all rows share their first ``depth`` ids and differ as a whole.

    Multikey quicksort: sequences with the same id at the place in hand go one place on, as a node; those with
    lesser and greater ids are sorted at that place. The stack takes the recursion's part."""
    nodes: list[list] = []
    stack: list[tuple] = [("open", rows, depth, None)]
    while stack:
        what, members, at, above = stack.pop()
        if what == "open":
            n, low = sum(m[2] for m in members), min(m[3] for m in members)
            ended = [m for m in members if len(m[0]) == at]
            rest = [m for m in members if len(m[0]) > at] if ended else members
            saved = (n - 1) * members[0][1][at - 1] if at else 0
            node = [low, at, above[0] if above else parent, n, 0, 0, saved, ended[0][4] if ended else NO_ENDS]
            stack.append(("close", node, at, above))
            if rest:
                stack.append(("split", rest, at, node))
        elif what == "split":
            pivot = sorted((members[0][0][at], members[len(members) // 2][0][at], members[-1][0][at]))[1]
            for part in ([m for m in members if m[0][at] < pivot], [m for m in members if m[0][at] > pivot]):
                if part:
                    stack.append(("split", part, at, above))
            stack.append(("open", [m for m in members if m[0][at] == pivot], at + 1, above))
        else:
            node = members
            node[5] = node[5] or 1
            nodes.append(node)
            if above:
                above[4] += 1
                above[5] += node[5]
                above[6] += node[6]
    return nodes


def _local_nodes(local: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 7, pa.string())
        names = [c.split()[0] for c in NODE.split(", ")]
        kinds = tuple(pa.int32() if n == "depth" else k for n, k in zip(names, kinds, strict=True))

        def out(place: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            path, depth, parent = place
            nodes = finish(rows, depth, parent)
            for a in range(0, len(nodes), 5000):
                part = nodes[a : a + 5000]
                columns = [[list(path)] * len(part), [i + 1 == len(nodes) for i in range(a, a + len(part))], *zip(*part, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        place, rows = None, []
        for b in batches:
            for path, depth, parent, *row in zip(*(b.column(c).to_pylist() for c in ("path", "depth", "parent", "ids", "ws", "n", "low", "ends")), strict=True):
                here = (tuple(path), depth, parent)
                if here != place and rows:
                    yield from out(place, rows)
                    rows = []
                place = here
                rows.append(tuple(row))
        if rows:
            yield from out(place, rows)
        common.tidy()

    return local.repartition("path").sortWithinPartitions("path").mapInArrow(run, NODE)


def prefix_trie(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, ids, ws): columns of :data:`NODE` but path and top."""
    state = common.written(sequences(convs).select(F.expr("CAST(array() AS array<long>)").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "*"), "trie-state")
    small, large = [], []
    while True:
        buckets = state.groupBy("path", "depth", "parent").agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("low").alias("low"), F.min(F.struct("ids", "ws", "ends")).alias("lo"), F.max("ids").alias("hi")).where(F.col("seqs") > local)
        differ = F.expr("array_position(zip_with(lo.ids, hi, (x, y) -> x <=> y), false)")
        found = common.written(buckets.withColumn("shared", F.when(differ > 0, differ - 1).otherwise(F.size("lo.ids")).cast("int")), "trie-large")
        many = found.count()
        if not many:
            small.append(state)
            break
        names = found.select("path", "shared", F.col("low").alias("above"))
        if many <= NAMES:
            names = F.broadcast(names)
        small.append(state.join(names, "path", "left_anti"))
        split = state.join(names, "path").where(F.size("ids") > F.col("shared"))
        state = common.written(
            split.select(F.expr("concat(path, array(ids[shared]))").alias("path"), (F.col("shared") + 1).alias("depth"), F.col("above").alias("parent"), "ids", "ws", "n", "low", "ends"),
            "trie-state",
        )
        large.append((found, state))
    rows = small[0]
    for x in small[1:]:
        rows = rows.unionByName(x)
    nodes = _local_nodes(rows)
    columns = [c.split()[0] for c in NODE.split(", ")][2:]
    if not large:
        return nodes.select(columns)
    nodes = common.written(nodes, "trie-nodes")
    every, kids = None, None
    for found, below in large:
        count = below.select("path").distinct().groupBy(F.expr("slice(path, 1, size(path) - 1)").alias("path")).agg(F.count("*").alias("kids"))
        every = found if every is None else every.unionByName(found)
        kids = count if kids is None else kids.unionByName(count)
    # One row for each node along a large bucket's shared prefix; saved words add up from its end.
    runs = every.join(kids, "path", "left").select("*", F.explode(F.sequence("depth", "shared")).alias("at"))
    runs = runs.withColumn("own", F.when(F.col("at") > 0, (F.col("n") - 1) * F.expr("lo.ws[at - 1]")).otherwise(F.lit(0)))
    adds = nodes.where("top").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    adds = adds.unionByName(runs.groupBy("path").agg(F.lit(0).cast("long").alias("leaves"), F.sum("own").alias("saved")))
    prefixes = F.explode(F.expr("transform(sequence(0, size(path) - 1), j -> slice(path, 1, j))"))
    below = adds.where("size(path) > 0").select(prefixes.alias("path"), "leaves", "saved").groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = Window.partitionBy("path").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("at") == F.col("shared")
    trunk = runs.withColumn("up", F.sum("own").over(up)).join(below, "path").select(
        F.col("low").alias("conv_id"),
        F.col("at").alias("depth"),
        F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("up") + F.col("saved")).alias("saved_tokens"),
        F.when(last & (F.size("lo.ids") == F.col("shared")), F.col("lo.ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes.select(columns).unionByName(trunk)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = rebuild(encode_turns(common.table(spark, sf_dir, "conversations")))
    return prefix_trie(convs).withColumn("depth", F.col("depth").cast("long"))


OP13_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id
), heads AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM own
), r AS (
  SELECT a.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, d, len(turns) = d AS ends, list_slice(turns, 1, d) AS key, turns FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(key[d].text, '[^\x20\x09-\x0D]+')) END AS own_saved
  FROM members GROUP BY key, d
), kids AS (
  SELECT list_slice(key, 1, d - 1) AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.key = k.key AND n.d = k.d
), up AS (
  SELECT list_slice(key, 1, i) AS key, i AS d, CAST(n_children = 0 AS BIGINT) AS leaf, own_saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM full_nodes)
), sums AS (SELECT key, d, sum(leaf) AS n_leaves, sum(own_saved) AS saved FROM up GROUP BY key, d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.key = s.key AND n.d = s.d LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.key = list_slice(n.key, 1, n.d - 1)
"""
