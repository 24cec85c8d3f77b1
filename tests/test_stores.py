"""Stores and streams: registry upserts, appended ledgers, keyed stream state; trees and quantiles of large groups."""

import hashlib
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import audit, ledger, merkle, models, quantiles, registry, sequences, triage
from attestra.sources.versions import Conflict, Versions
from attestra.streaming import registry_stream


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


# Registry


def test_registry_upserts(spark, tmp_path):
    store = registry.StoredRegistry(spark, f"file://{tmp_path}/r", "sha string, seq long, note string", "sha", "seq", 8)
    rows = lambda x: spark.createDataFrame(x, "sha string, seq long, note string")
    assert store.read().count() == 0 and store.upsert(rows([])) == 0
    assert store.upsert(rows([(f"k{i}", 1, "a") for i in range(100)] + [(None, 5, "lost")])) == 1
    before, old = files(tmp_path), store.read()
    assert store.upsert(rows([("k3", 2, "b"), ("k3", 3, "c"), ("new", 1, "n"), ("k4", 0, "older"), ("k5", 1, "zz equal seq")])) == 2
    got = {r.sha: (r.seq, r.note) for r in store.read().collect()}
    assert len(got) == 101 and got["k3"] == (3, "c") and got["new"] == (1, "n") and got["k4"] == (1, "a") and got["k5"] == (1, "a")
    assert {p: t for p, t in files(tmp_path).items() if p in before} == before  # nothing is rewritten in place
    assert {r.sha: r.note for r in old.collect()}["k3"] == "a"  # a reader of version 1
    one, two = store.store.manifest(1), store.store.manifest(2)
    same = [b for b in one if one[b] == two[b]]
    assert len(same) >= 3  # untouched buckets are the same folders
    assert store.upsert(rows([("k3", 3, "c")])) == 3 and store.read().where("sha = 'k3'").first().note == "c"
    assert store.lookup(rows([("k3", 9, "x"), ("none", 9, "x")]).select("sha")).where("note IS NULL").count() == 1


def test_registry_conflict_leaves_nothing(spark, tmp_path):
    store = registry.StoredRegistry(spark, f"file://{tmp_path}/r", "sha string, seq long", "sha", "seq", 4)
    rows = spark.createDataFrame([("a", 1)], "sha string, seq long")
    store.upsert(rows)
    folders = set(os.listdir(tmp_path / "r"))
    with pytest.raises(Conflict):
        store.upsert(rows.withColumn("seq", F.lit(2).cast("long")), base=0)
    assert set(os.listdir(tmp_path / "r")) == folders and store.read().first().seq == 1


def test_versions_one_of_many_writers_wins(spark, tmp_path):
    won, lost = [], []

    def write(i):
        try:
            Versions(spark, f"file://{tmp_path}/v").commit(1, {"who": i})
            won.append(i)
        except Conflict:
            lost.append(i)

    os.makedirs(tmp_path / "v")
    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) >= 1 and len(won) + len(lost) == 6 and Versions(spark, f"file://{tmp_path}/v").manifest()["who"] in won


# Ledger


def chained(bodies):
    out, prev = [], "0" * 64
    for i, b in enumerate(bodies):
        h = hashlib.sha256(f"{i}|{prev}|{b}".encode()).hexdigest()
        out.append((i, prev, b, h))
        prev = h
    return out


def test_ledger_appends_and_stale_head(spark, tmp_path):
    store = ledger.StoredLedger(spark, f"file://{tmp_path}/l")
    rows = lambda x: spark.createDataFrame(x, "chain long, seq long, body string")
    assert store.append(rows([(1, i, f"b{i}") for i in range(5)]), "seq", "body") == 1
    assert store.append(rows([(1, 5, None), (2, 0, "é|x")]), "seq", "body", seen=1) == 2
    folders = set(os.listdir(tmp_path / "l"))
    with pytest.raises(ledger.StaleHead):
        store.append(rows([(1, 6, "late")]), "seq", "body", seen=1)
    with pytest.raises(Exception, match="an entry needs a chain"):
        store.append(rows([(None, 6, "x")]), "seq", "body")
    assert set(os.listdir(tmp_path / "l")) == folders
    assert store.append(rows([]), "seq", "body") == 3 and store.append(rows([(2, 1, "y"), (1, 7, "z")]), "seq", "body") == 4
    got = {c: sorted((r["index"], r.prev_hash, r.payload, r.entry_hash) for r in store.read().where(f"chain = {c}").collect()) for c in (1, 2)}
    assert got == {1: chained(["b0", "b1", "b2", "b3", "b4", "", "z"]), 2: chained(["é|x", "y"])}
    assert {r.chain: (r.length, r.head) for r in store.heads().collect()} == {c: (len(g), g[-1][3]) for c, g in got.items()}
    assert store.read(1).count() == 5


def test_ledger_race_between_look_and_commit(spark, tmp_path, monkeypatch):
    store, other = (ledger.StoredLedger(spark, f"file://{tmp_path}/l") for _ in range(2))
    rows = spark.createDataFrame([(1, 0, "x")], "chain long, seq long, body string")
    commit = store.store.commit

    def slow(version, manifest):
        other.append(rows, "seq", "body")
        commit(version, manifest)

    monkeypatch.setattr(store.store, "commit", slow)
    with pytest.raises(ledger.StaleHead):
        store.append(rows, "seq", "body")
    assert store.read().count() == 1


def test_ledger_of_a_million(spark):
    rows = spark.range(1_000_000).select(F.lit("c").alias("chain"), F.col("id").alias("seq"), F.lit("x").alias("body"))
    top = ledger.fold(rows, "chain", "seq", "body").agg(F.count("*").alias("n"), F.max_by("entry_hash", "index").alias("head")).first()
    prev = "0" * 64
    for i in range(1_000_000):
        prev = hashlib.sha256(f"{i}|{prev}|x".encode()).hexdigest()
    assert (top.n, top.head) == (1_000_000, prev)


# Merkle


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([hashlib.sha256(b"\x01" + bytes.fromhex(a[i]) + bytes.fromhex(a[min(i + 1, len(a) - 1)])).hexdigest() for i in range(0, len(a), 2)])
    return levels


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_merkle_rounds(spark, bits):
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 9, 7: 31, 8: 33, 9: 100}
    rows = [(t, i, hashlib.sha256(f"{t} {i}".encode()).hexdigest()) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "t long, i long, h string").repartition(3)
    trees = {t: tree([h for u, _, h in rows if u == t]) for t in sizes}
    assert {r.t: (r.n_leaves, r.root) for r in merkle.roots(df, "t", "i", "h", bits).collect()} == {t: (n, trees[t][-1][0]) for t, n in sizes.items()}
    got = merkle.proofs(df, "t", "i", "h", bits).collect()
    assert len(got) == len(rows)
    for r in got:
        levels, at, want = trees[r.t], r.i, []
        for level in levels[:-1]:
            other = at ^ 1
            want.append((level[min(other, len(level) - 1)], "right" if other > at else "left"))
            at //= 2
        assert [(p.hash, p.side) for p in r.path] == want and r.root == levels[-1][0] and r.leaf == levels[0][r.i]
    assert merkle.roots(df.where("false"), "t", "i", "h").collect() == []


def test_merkle_of_many_leaves(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("t"), F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert merkle.roots(df, "t", "i", "h").first().root == tree([hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)])[-1][0]


# Streams


def test_stream_state_and_restart(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"h{r.randrange(30)}", i) for i in range(200)]
    home = f"file://{tmp_path}"
    got = lambda: sorted((x.seq, x.sha, x.first_seq, x.action) for x in spark.read.schema(registry_stream.OUT).parquet(f"{home}/out").collect())
    for part in range(3):
        spark.createDataFrame(rows[part * 70 : part * 70 + 70], "sha string, seq long").coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = registry_stream.triage_stream(registry_stream.stream_of(spark, f"{home}/in", "sha string, seq long"))
        registry_stream.run_available(stream, f"{home}/out", f"{home}/check")
    first = {}
    want = []
    for sha, seq in rows:
        want.append((seq, sha, first.setdefault(sha, seq), "miss" if first[sha] == seq else "exact_hit"))
    assert got() == sorted(want)


def test_stream_of_new_clips(spark, tmp_path):
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    home = f"file://{tmp_path}"
    for part in ([("a", 0), ("a", 1), ("b", 2)], [("a", 3), ("c", 4)]):
        spark.createDataFrame([(s, begin + timedelta(minutes=m)) for s, m in part], "sha string, at timestamp").coalesce(1).write.mode("append").parquet(f"{home}/in")
    fresh = registry_stream.new_clips(registry_stream.stream_of(spark, f"{home}/in", "sha string, at timestamp"), "at", "1 hour")
    registry_stream.run_available(fresh, f"{home}/out", f"{home}/check")
    assert sorted(r.sha for r in spark.read.parquet(f"{home}/out").collect()) == ["a", "b", "c"]


# Quantiles


@pytest.mark.parametrize("limit", [7, 100_000])
def test_quantiles_by_ranges(spark, limit):
    r = np.random.default_rng(3)
    data = {"a": r.normal(size=900), "b": np.repeat([1.0, 2.0, 5.0], 100), "c": np.array([4.0]), "d": np.r_[np.zeros(500), r.random(50)], "e": r.integers(0, 40, 700).astype(float)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("n", None)]
    points = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = {x.k: x.quantiles for x in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", points, ["k"], limit=limit, fan=8).collect()}
    assert got.pop("n") is None
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(float(x), 9) for x in np.quantile(v, points)] for k, v in data.items()}


def test_quantiles_of_one_large_group(spark, monkeypatch):
    df = spark.range(2_000_000).select(((F.col("id") * 7919) % 2_000_003).cast("double").alias("x"))
    ranked = []
    select = quantiles.select_ranks
    monkeypatch.setattr(quantiles, "select_ranks", lambda *a: ranked.append(a[3]) or select(*a))
    got = quantiles.quantiles(df, "x", [0.001, 0.5, 0.999], limit=20_000).first().quantiles
    x = (np.arange(2_000_000) * 7919) % 2_000_003
    assert [round(v, 6) for v in got] == [round(float(v), 6) for v in np.quantile(x, [0.001, 0.5, 0.999])] and ranked == [20_000]


def test_quantiles_empty(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles.quantiles(none, "v", [0.5], ["k"]).collect() == [] and quantiles.quantiles(none, "v", [0.5]).first().quantiles is None
    scores = spark.createDataFrame([], "id long, score double, label boolean")
    assert audit.roc_auc(scores).first().auc == 0.5 and audit.recall_at_fpr(scores, 0.01).first().recall == 0.0
    mean, cov = models.covariance(spark.createDataFrame([], "v array<double>"), "v")
    assert mean.shape == (0,) and cov.shape == (0, 0)


# Sequences


def test_information_in_bits(spark):
    rows = [("fair", i, float(i % 2), float(i % 2)) for i in range(64)] + [("apart", i, float(i % 2), float(i // 2 % 2)) for i in range(64)] + [("short", i, float(i % 2), float(i % 2)) for i in range(15)]
    got = {r.clip: r.mi for r in sequences.mutual_information(spark.createDataFrame(rows, "clip string, t int, a double, b double"), "clip", "a", "b").collect()}
    assert got["fair"] == pytest.approx(1) and got["apart"] == pytest.approx(0) and got["short"] == 0


def test_windows_of_short_clips(spark):
    rows = [(n, t, 1.0) for n in (7, 8, 20, 25, 40) for t in range(n)]
    got = {}
    for r in sequences.hopping(spark.createDataFrame(rows, "clip long, t long, x double"), "clip", "t", 25, 6).groupBy("clip", "start").count().collect():
        got.setdefault(r.clip, {})[r.start] = r["count"]
    assert got == {8: {0: 8}, 20: {0: 20}, 25: {0: 25}, 40: {0: 25, 6: 25, 12: 25}}


def test_window_correlation_by_running_sums(spark):
    r = np.random.default_rng(9)
    clips = {"long": (r.normal(5, 2, 300), r.normal(1e6, 3, 300)), "short": (r.random(20), r.random(20)), "seven": (r.random(7), r.random(7)), "flat": (np.r_[np.full(60, 3.1), r.random(40)], np.r_[r.random(70), np.full(30, 0.7)])}
    clips["shifted"] = (clips["long"][0], np.roll(clips["long"][0], 3))
    rows = [(k, t, float(a[t]), float(b[t])) for k, (a, b) in clips.items() for t in range(len(a))]
    got = {(x.clip, x.start, x.lag): x["corr"] for x in sequences.window_correlation(spark.createDataFrame(rows, "clip string, t long, a double, b double"), "clip", "t", "a", "b", 25, 6, 4).collect()}
    want = {}
    for k, (a, b) in clips.items():
        n = len(a)
        for s in range(0, max(1, n - 25 + 1), 6):
            x, y = a[s : s + 25], b[s : s + 25]
            if len(x) < 8:
                continue
            for lag in range(-4, 5):
                p, q = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])
                want[k, s, lag] = 0.0 if len(p) < 4 or p.std() <= 1e-12 or q.std() <= 1e-12 else float(np.corrcoef(p, q)[0, 1])
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-7


# Prediction


def test_prediction_is_calibrated(spark):
    row = spark.createDataFrame([(1, [0.6, 0.8], None, 10.0, True, None), (2, [0.6, 0.8], None, 10.0, False, "none")], "i int, m array<double>, x array<double>, pct double, ok boolean, why string")
    got = {r.i: r for r in models.predict(row, "m", "x", "pct", "ok", "why", (2.0, 0.5)).collect()}
    z = 2 * np.log(0.7 / 0.3) + 0.5
    assert got[1].p_fake == pytest.approx(1 / (1 + np.exp(-z))) and got[1].llr == pytest.approx(z)
    assert got[1].vacuity == pytest.approx(2 / (0.7 * 0.3 / 0.01 - 1 + 2))  # of the members, not calibrated
    assert got[2].p_fake == 0.5 and got[2].llr == 0 and got[2].vacuity == 1


# Similarity join


def test_crowded_quarters_lose_no_pair(spark):
    r = random.Random(2)
    hashes = [r.getrandbits(48) for _ in range(150)]  # one quarter is 0 in all
    hashes += [h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for h in hashes]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    want = {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if bin(a ^ b).count("1") <= 6}
    for heavy in (20, 10_000):
        got = triage.hamming_join(df, df.withColumnRenamed("id", "other"), 6, heavy=heavy)
        assert {(x.id, x.other, x.bits) for x in got.collect()} == want


def test_equal_hashes_are_one_group(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") < 99_990, 5).otherwise(F.col("id") * 1_000_003).alias("h")).unionByName(spark.createDataFrame([(200_000, 7), (200_001, None)], "id long, h long"))
    membership, pairs = triage.hamming_groups(df, 6)
    assert membership.count() == 100_001 and membership.where("representative = 0").first().members == 99_990
    assert [(x.low, x.high, x.bits) for x in pairs.where("low = 0 AND high = 200000").collect()] == [(0, 200_000, 1)] and pairs.count() < 60


# Self-similarity


def test_self_similarity_of_a_long_clip(spark):
    r = np.random.default_rng(5)
    v = np.cumsum(r.normal(size=(900, 6)), axis=0)
    v[40] = 0
    t = np.cumsum(r.integers(1, 4, 900))
    rows = [("long", int(t[i]), v[i].tolist()) for i in range(900)] + [("two", 0, [1.0, 0.0]), ("two", 1, [1.0, 0.0]), ("one", 3, [1.0])]
    df = spark.createDataFrame(rows, "clip string, t int, v array<double>").repartition(3)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    i, j = np.triu_indices(900, 1)
    keep = t[j] - t[i] >= 2
    cos, gap = (u @ u.T)[i, j][keep], (t[j] - t[i])[keep].astype(float)
    got = {x.clip: x for x in sequences.self_similarity(df, "clip", "t", "v").collect()}
    assert set(got) == {"long"} and got["long"].pairs == len(cos)
    assert got["long"].mean_cos == pytest.approx(cos.mean(), rel=1e-9) and got["long"].slope == pytest.approx(np.polyfit(gap, cos, 1)[0], rel=1e-6)
    h = np.bincount(np.clip(np.floor((np.round(cos, 12) + 1) * 8), 0, 15).astype(int), minlength=16) / len(cos)
    want = -sum(p * np.log2(p) for p in h if p) / 4
    found = {x.clip: x.entropy for x in sequences.similarity_entropy(df, "clip", "t", "v", block=100).collect()}
    assert set(found) == {"long"} and found["long"] == pytest.approx(want, abs=1e-9)


# Acquisition


def test_members_that_match_come_first(spark):
    from attestra.sources import acquire

    index = spark.createDataFrame([("z", f"m{i}.mp4", 10, "real", f"scene{i % 5}") for i in range(30)] + [("z", "big.mp4", 10_000, "real", "scene1")], "archive string, member string, size long, kind string, scene string")
    match = spark.createDataFrame([("scene1",), ("scene3",)], "scene string")
    none = spark.createDataFrame([], "archive string, member string")
    picked = acquire.select_members(index, none, "kind", 15, 100, ["mp4"], match, "scene").collect()
    assert len(picked) == 15 and sum(r.scene in ("scene1", "scene3") for r in picked) == 12 and "big.mp4" not in {r.member for r in picked}
    done = spark.createDataFrame([("z", picked[0].member)], "archive string, member string")
    assert acquire.select_members(index, done, "kind", 15, 100, ["mp4"], match, "scene").count() == 14


# Resampling


def test_grouped_resampling_agrees_with_rows(spark):
    r = random.Random(11)
    rows = [(i, round(r.random() * (1.3 if i % 3 else 1), 2), bool(i % 3)) for i in range(600)] + [(1000, None, True)]
    scores = spark.createDataFrame(rows, "id long, score double, label boolean").repartition(3)
    one = audit.bootstrap_auc(scores.where("score IS NOT NULL"), replicates=400).first()
    many = audit.bootstrap_auc_grouped(scores.where("score IS NOT NULL"), replicates=400).first()
    assert many.auc == pytest.approx(one.auc) and many.replicates == 400
    width = one.high - one.low
    assert abs(many.low - one.low) < 0.25 * width and abs(many.high - one.high) < 0.25 * width
    again = audit.bootstrap_auc_grouped(scores.where("score IS NOT NULL").repartition(7), replicates=400, parts=5).first()
    assert (again.low, again.high) == (pytest.approx(many.low), pytest.approx(many.high))
    alone = audit.bootstrap_auc_grouped(scores.where("label"), replicates=20).first()
    assert alone.replicates == 0 and alone.low is None and alone.auc == 0.5


# Manifest boxes


def box(kind, body):
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def holder(label, *parts):
    return box(b"jumb", box(b"jumd", bytes(16) + b"\x03" + label + b"\0") + b"".join(parts))


def test_boxes_within_bounds():
    from attestra.operators.boxes import boxes_of

    whole = holder(b"c2pa", holder(b"m", box(b"json", b"{}")), box(b"bidb", b"xyz"))
    rows = boxes_of(whole)
    assert [(r[1], r[2], r[3], r[4], r[7]) for r in rows] == [(-1, 0, "jumb", "c2pa", "ok"), (0, 1, "jumd", None, "ok"), (0, 1, "jumb", "m", "ok"), (2, 2, "jumd", None, "ok"), (2, 2, "json", None, "ok"), (0, 1, "bidb", None, "ok")]
    assert rows[4][8] == b"{}" and rows[5][8] == b"xyz" and boxes_of(b"") == []
    for n in range(1, len(whole)):
        cut = boxes_of(whole[:n])
        assert any(r[7] != "ok" for r in cut) and all(r[5] + len(r[8] or b"") <= n for r in cut)
    long_ = (1).to_bytes(4, "big") + b"bidb" + (19).to_bytes(8, "big") + b"abc"
    assert boxes_of(long_)[0][8] == b"abc" and boxes_of((0).to_bytes(4, "big") + b"bidbrest")[0][8] == b"rest"
    assert boxes_of((3).to_bytes(4, "big") + b"bidb....")[0][7] == "malformed"
    deep = b""
    for _ in range(60):
        deep = holder(b"d", deep)
    assert any(r[7] == "malformed" for r in boxes_of(deep))


def test_manifests_are_read(spark):
    from attestra.operators.boxes import read_manifests

    actions = lambda kind: holder(b"c2pa.assertions", holder(b"c2pa.actions", box(b"json", b'{"actions": [{"action": "x"}, {"action": "c", "digitalSourceType": "http://cv/%s"}]}' % kind)), holder(b"other"))
    claim = holder(b"c2pa.claim.v2", box(b"json", b'{"claim_generator": "g", "title": "t"}'))
    good = holder(b"c2pa", holder(b"old", actions(b"digitalCapture"), claim), holder(b"new", actions(b"trainedAlgorithmicMedia"), claim))
    rows = [(1, good), (2, good[:-1]), (3, b""), (4, None), (5, holder(b"c2pa", holder(b"m", actions(b"none")))), (6, holder(b"else", claim)), (7, holder(b"c2pa", holder(b"m", claim))), (8, b"\0\0")]
    got = {r.i: (r.status, r.manifests, r.claim_generator, r.title, r.n_assertions, r.claims_ai) for r in read_manifests(spark.createDataFrame(rows, "i int, c binary"), "i", "c").collect()}
    none = (None,) * 5
    assert got == {1: ("present", 2, "g", "t", 2, True), 2: ("invalid", *none), 3: ("absent", *none), 4: ("absent", *none), 5: ("invalid", *none), 6: ("absent", *none), 7: ("present", 1, "g", "t", 0, None), 8: ("invalid", *none)}


# Running sums


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_tied_scores(spark, descending):
    r = random.Random(21)
    rows = [(i, "g" if i % 5 else "h", r.choice([0.0, 0.0, 0.0, 0.5, 0.5, r.random()]), r.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, score double, n long").repartition(4)
    got = {x.id: x.total for x in audit.running(df, {"total": F.col("n")}, ["g"], descending, ["id"], parts=16).collect()}
    want, total = {}, {"g": 0, "h": 0}
    for i, g, s, n in sorted(rows, key=lambda x: (-x[2] if descending else x[2], x[0])):
        total[g] += n
        want[i] = total[g]
    assert got == want
    plan = audit.running(df, {"total": F.col("n")}, ["g"], descending, ["id"], parts=16)
    sizes = plan.groupBy("g").count().collect()
    assert sum(x["count"] for x in sizes) == 3000


# Detectors


def test_detectors_in_batches(spark):
    import pandas as pd

    from attestra.operators import provenance

    calls = spark.sparkContext.accumulator(0)

    def long_(batch):
        calls.add(1)
        if (batch["x"] == 7).any():
            raise ValueError("seven")
        return pd.DataFrame({"found": (batch["x"] > 3).astype(object).where(batch["x"] != 5, None), "confidence": batch["x"] / 10})

    def short(batch):
        return pd.DataFrame({"found": [True]})

    rows = spark.range(6).select("id", F.col("id").alias("x")).coalesce(1)
    got = {(r.id, r.detector): (r.status, r.confidence) for r in provenance.run_detectors(rows, {"long": long_, "short": short, "row": lambda r: {"found": r["x"] == 1}}, ["long", "none", "row"], "id", ("long",)).collect()}
    assert calls.value == 1 and got[4, "long"] == ("detected", 0.4) and got[5, "long"] == ("error", None) and got[0, "none"] == ("unavailable", None) and got[1, "row"][0] == "detected" and len(got) == 18
    bad = provenance.run_detectors(spark.range(10).select("id", F.col("id").alias("x")).coalesce(1), {"long": long_}, ["long"], "id", ("long",)).collect()
    assert {r.id: r.status for r in bad}[7] == "error" and "seven" in {r.id: r.detail for r in bad}[7] and sum(r.status == "error" for r in bad) == 2
    wrong = provenance.run_detectors(rows, {"short": short}, ["short"], "id", ("short",)).collect()
    assert all(r.status == "detected" for r in wrong)  # a row at a time it is right
