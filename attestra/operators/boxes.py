"""Embedded manifest stores: their boxes (length, type, payload; nested), and the claims that they hold.

A box is a 4-byte length (big-endian, header included; 1: an 8-byte length follows; 0: up to the end), a
4-letter type and its payload. A ``jumb`` box holds boxes, the first of which (``jumd``) describes it: 16
bytes of kind, toggles, and a label ended by a zero. Lengths are checked against the box around; what
doesn't fit is reported and never read past.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.provenance import ABSENT, INVALID, PRESENT, ai_claim
from attestra.session import cut

#: Boxes within boxes beyond which a store is invalid.
DEEPEST = 32
OK, TRUNCATED, MALFORMED = "ok", "truncated", "malformed"
#: Labels and the fields that are read.
STORE, ASSERTIONS, CLAIM, ACTIONS = "c2pa", "c2pa.assertions", "c2pa.claim", "c2pa.actions"
BOXES = "box int, parent int, depth int, kind string, label string, start long, size long, status string, data binary"


def boxes_of(content: bytes) -> list[tuple]:
    """Rows of :data:`BOXES` in order of place; a super box's label is that of its description, and only boxes that
    hold no others have data."""
    out: list[list] = []
    stack = [(0, len(content), -1, 0)]  # from, to, parent, depth
    while stack:
        at, end, parent, depth = stack.pop()
        if at >= end:
            continue
        size, kind, head, status = 0, "", 8, OK
        if end - at < 8:
            status = TRUNCATED
        else:
            size, kind = struct.unpack(">I", content[at : at + 4])[0], content[at + 4 : at + 8].decode("latin-1")
            if size == 0:
                size = end - at
            elif size == 1:
                head = 16
                size = struct.unpack(">Q", content[at + 8 : at + 16])[0] if end - at >= 16 else 0
            if size < head or depth > DEEPEST:
                status = MALFORMED
            elif size > end - at:
                status = TRUNCATED
        inner = min(at + size, end) if status != MALFORMED else end
        own = len(out)
        nested = kind == "jumb" and status != MALFORMED
        out.append([own, parent, depth, kind, None, at, size, status, content[at + head : inner] if not nested and status == OK else None])
        if kind == "jumd" and parent >= 0 and status == OK and out[parent][4] is None:
            payload = content[at + head : inner]
            if len(payload) >= 17 and payload[16] & 2:
                out[parent][4] = payload[17:].split(b"\0", 1)[0].decode("utf-8", "replace")
        if status == OK:  # nothing that follows a box of unknown length can be placed
            stack.append((inner, end, parent, depth))
        if nested:
            stack.append((at + head, inner, own, depth + 1))
    return [tuple(x) for x in out]


def read_boxes(df: DataFrame, key: str, content: str) -> DataFrame:
    """key and :data:`BOXES`, a row a box; null and empty contents have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [c.split()[0] for c in BOXES.split(", ")]
        for b in batches:
            rows, own = [], []
            for i, x in enumerate(b.column("content")):
                found = boxes_of(x.as_py() or b"")
                rows += found
                own += [i] * len(found)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(own)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=["key", *names])

    return df.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, {BOXES}").withColumnRenamed("key", key)


def read_manifests(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, status, manifests, claim_generator, title, n_assertions and claims_ai of each row: those of the active
    manifest, the last one of the store. A store with any box that is truncated or malformed, or whose claim isn't
    readable, is invalid and claims nothing; without a store the status is absent."""
    boxes = cut(read_boxes(df, key, content), "boxes")  # read once, joined to itself by parent
    faults = boxes.groupBy(key).agg(F.count_if(F.col("status") != OK).alias("faults"), F.count_if((F.col("depth") == 0) & (F.col("label") == STORE)).alias("stores"))
    named = boxes.where("kind = 'jumb'").select(key, "box", "parent", "label")
    up = lambda n: named.select(key, F.col("box").alias(f"box{n}"), F.col("parent").alias(f"parent{n}"), F.col("label").alias(f"label{n}"))
    store = up(0).where((F.col("parent0") == -1) & (F.col("label0") == STORE)).select(key, "box0")
    manifest = up(1).join(store, key).where("parent1 = box0")
    active = manifest.groupBy(key).agg(F.count("*").alias("manifests"), F.max("box1").alias("active"))
    part = up(2).join(active, key).where("parent2 = active")  # claim and assertion store
    leaf = boxes.where("kind = 'json' AND data IS NOT NULL").select(key, F.col("parent").alias("holder"), F.col("data").cast("string").alias("json"))
    claim = part.where(F.col("label2").startswith(CLAIM)).join(leaf, key).where("holder = box2")
    first = Window.partitionBy(key).orderBy("box2")
    claim = claim.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select(key, F.from_json("json", "claim_generator string, title string").alias("c"))
    inside = up(3).join(part.where(F.col("label2") == ASSERTIONS).select(key, "box2"), key).where("parent3 = box2")
    counted = inside.groupBy(key).agg(F.count("*").alias("n_assertions"))
    actions = inside.where(F.col("label3") == ACTIONS).join(leaf, key).where("holder = box3")
    read = F.from_json("json", "actions array<struct<action:string,digitalSourceType:string>>")["actions"]
    claims = actions.groupBy(key).agg(F.min_by(ai_claim(read), F.when(ai_claim(read).isNotNull(), F.col("box3"))).alias("claims_ai"))
    out = df.select(key).join(faults, key, "left").join(active.select(key, "manifests"), key, "left").join(claim, key, "left").join(counted, key, "left").join(claims, key, "left")
    status = F.when(F.coalesce("faults", F.lit(0)) > 0, INVALID).when(F.coalesce("stores", F.lit(0)) == 0, ABSENT).when(F.col("manifests").isNull() | F.col("c").isNull(), INVALID).otherwise(PRESENT)
    good = F.col("status") == PRESENT
    return out.withColumn("status", status).select(
        key, "status", F.when(good, F.col("manifests")).alias("manifests"), F.when(good, F.col("c.claim_generator")).alias("claim_generator"), F.when(good, F.col("c.title")).alias("title"),
        F.when(good, F.coalesce("n_assertions", F.lit(0))).alias("n_assertions"), F.when(good, F.col("claims_ai")).alias("claims_ai"),
    )
