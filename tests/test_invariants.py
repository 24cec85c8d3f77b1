"""Behavioural invariants of operators, sources and kernels."""

import hashlib
import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import expressions as X
from attestra.kernels import audio, av, phash, visual
from attestra.operators import audit, clips, custody, fusion, models, provenance, triage
from attestra.operators import sequences as Q
from attestra.sources import remote_zip
from attestra.sources import text as S
from attestra.streaming import triage_stream

# custody


def node(a, b):
    return hashlib.sha256(b"\1" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def root_of(leaves):
    while len(leaves) > 1:
        leaves = [node(leaves[i], leaves[min(i + 1, len(leaves) - 1)]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def test_merkle_sizes_and_proofs(spark):
    sizes = [0, 1, 2, 3, 4, 5, 8, 9, 17, 64]
    df = spark.createDataFrame([(n, [format(i, "064x") for i in range(n)]) for n in sizes], "n int, leaves array<string>")
    got = {r.n: r.root for r in df.select("n", custody.merkle_root("leaves").alias("root")).collect()}
    assert got == {n: root_of([format(i, "064x") for i in range(n)]) for n in sizes}
    p = df.where("n > 0").withColumn("levels", custody.merkle_levels("leaves")).select("n", "levels", F.posexplode("leaves").alias("i", "leaf"))
    p = p.select("n", "leaf", custody.inclusion_proof("levels", "i").alias("path"))
    assert all(r.h == got[r.n] for r in p.select("n", custody.proof_root("leaf", "path").alias("h")).collect())
    altered = p.select("n", custody.proof_root("leaf", "transform(path, s -> named_struct('hash', sha2(s.hash, 256), 'side', s.side))").alias("h")).where("n > 1")
    assert all(r.h != got[r.n] for r in altered.collect())


def test_chain_tampering(spark):
    rows = spark.createDataFrame([(1, i, f"body {i}") for i in range(5)], "c int, s int, b string")
    whole = custody.build_chain(rows, "c", "s", "b").withColumn("pos", F.col("index"))
    check = lambda df: custody.check_chain(df, "c").first()
    assert check(whole).valid
    assert (check(custody.tampered(whole, "modify", 2)).broken_at, check(custody.tampered(whole, "modify", 2)).reason) == (2, "digest")
    assert check(custody.tampered(whole, "delete", 2)).reason == "index" and not check(custody.tampered(whole, "reorder", 2)).valid


def test_commitments_localise(spark):
    f, x = av.talking_clip(1)
    one = lambda f, x: spark.createDataFrame([(1, f.tobytes(), list(f.shape), 25.0, x.tobytes(), 16000)], clips.CLIP)
    f2, x2 = f.copy(), x.copy()
    f2[60, 0, 0, 0] ^= 1
    x2[16000:32000] = x2[16000:32000][::-1]
    leaves = lambda df: clips.commitments(df).select("clip_id", "track", F.posexplode("leaves").alias("i", "leaf"))
    got = {(r.track, r.i) for r in custody.changed_leaves(leaves(one(f, x)), leaves(one(f2, x2)), ["clip_id", "track", "i"]).collect()}
    assert got == {("video", 2), ("audio", 1)}


# fusion


def verdicts(spark, rows, table=(0.02, 0.76, 0.64, 0.58)):
    df = spark.createDataFrame(rows, "v double, a double, s double, vac double, va boolean, aa boolean")
    b = lambda p, ok=None: fusion.branch(F.col(p), F.col("vac"), None if ok is None else F.col(ok))
    return fusion.fuse(df.select(b("v", "va").alias("video"), b("a", "aa").alias("audio"), b("s").alias("sync")), list(table)).collect()


def test_verdicts_reachable(spark):
    got = verdicts(spark, [(0.02, 0.02, 0.05, 0.05, True, True), (0.98, 0.02, 0.95, 0.05, True, True), (0.02, 0.98, 0.95, 0.05, True, True), (0.98, 0.98, 0.60, 0.05, True, True), (0.5, 0.5, 0.5, 0.5, True, True)])
    assert [r.verdict for r in got] == ["REAL", "VIDEO_FAKE", "AUDIO_FAKE", "BOTH_FAKE", "UNKNOWN"]
    assert all(abs(sum(r.post) - 1) < 1e-12 for r in got)


def test_missing_never_votes_real(spark):
    got = verdicts(spark, [(0.02, 0.02, 0.05, 0.05, False, True), (0.02, 0.02, 0.05, 0.05, None, None)])
    assert got[0].video_verdict == "UNKNOWN" and {r.verdict for r in got} == {"UNKNOWN"} and "video_unavailable" in got[0].flags


def test_conflict_flagged(spark):
    got = verdicts(spark, [(0.85, 0.02, 0.02, 0.02, True, True)], (0.01, 0.99, 0.99, 0.01))[0]
    assert got.verdict == "UNKNOWN" and any(f.endswith("conflict") for f in got.flags)


def test_coupling_covers_empty_cells(spark):
    t = {r.cell: r.p_desync for r in fusion.coupling(spark.createDataFrame([(True, True, True)], "v boolean, a boolean, d boolean"), "v", "a", "d").collect()}
    assert t["RR"] == 0.5 and t["FF"] == pytest.approx(3 / 5)


# provenance


def test_absent_is_not_negative(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    m = spark.createDataFrame([(1, False, True), (2, True, True)], "id int, claims_ai boolean, valid boolean")
    w = spark.createDataFrame([(1, True), (2, False)], "id int, found boolean")
    j = provenance.with_sidecars(c, m, w, "id").withColumn("clash", provenance.integrity_clash(F.col("claims_ai"), F.col("watermark_status")))
    got = {r.id: r for r in j.collect()}
    assert got[1].clash and got[2].clash and not got[3].clash
    assert (got[3].claims_ai, got[3].manifest_status, got[3].watermark_status) == (None, "absent", "unavailable")


# triage and hashes


def test_banded_join_loses_no_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    flipped = [int(np.int64(np.uint64(h.view(np.uint64)) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))))) for h, k in zip(base, rng.integers(0, 10, 60), strict=True)]
    a = spark.createDataFrame([(i, int(h)) for i, h in enumerate(flipped)], "id int, h long")
    b = spark.createDataFrame([(i, int(h)) for i, h in enumerate(base)], "other int, h long")
    got = {(r.id, r.other, r.bits) for r in triage.hamming_join(a, b, 6).collect()}
    u = lambda x: int(x) & (2**64 - 1)
    want = {(i, j, n) for i, x in enumerate(flipped) for j, y in enumerate(base) if (n := (u(x) ^ u(y)).bit_count()) <= 6}
    assert got == want and len(want) > 20


def test_hash_hex_and_sequence_distance(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, -(2**63), -1)], "h long").withColumn("x", X.hash_hex("h"))
    assert [r.x for r in df.collect()] == ["0" * 16, "0" * 15 + "1", "8" + "0" * 15, "f" * 16]
    assert all(r.b == r.h for r in df.withColumn("b", X.hex_hash("x")).collect())
    d = spark.createDataFrame([([1, 2], [1, 2]), ([], [5]), ([0], [3, 255]), ([7, 7, 7], [7])], "a array<long>, b array<long>").select(X.sequence_distance("a", "b").alias("d"))
    assert [r.d for r in d.collect()] == [0.0, 1.0, 2 / 64, 0.0]


def test_phash_noise_and_tones():
    rng = np.random.default_rng(1)
    f = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    noisy = np.clip(f + rng.normal(0, 2, f.shape), 0, 255).astype(np.uint8)
    assert ((phash.frame_hash(f) ^ phash.frame_hash(noisy)) & (2**64 - 1)).bit_count() <= 8
    t = np.arange(32000) / 16000
    assert phash.audio_hashes(np.sin(2 * np.pi * 220 * t)) != phash.audio_hashes(np.sin(2 * np.pi * 880 * t)) and phash.audio_hashes(np.zeros(10)) == []


# kernels


def test_visual_responds():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 255, (30, 64, 64, 3)).astype(np.uint8)
    sharp, soft = visual.features(f), visual.features(np.repeat(np.repeat(f[:, ::4, ::4], 4, 1), 4, 2))
    assert sharp["hf_energy_mean"] > soft["hf_energy_mean"] and len(sharp) == 28 and len(visual.region_features(f)) == 140
    flicker = np.clip(f * (1 + 0.3 * (np.arange(30) % 2))[:, None, None, None], 0, 255).astype(np.uint8)
    assert visual.features(flicker)["flicker_index"] > sharp["flicker_index"]
    assert visual.features(np.repeat(f[::2], 2, 0))["duplicate_frame_rate"] > 0.4 and sharp["duplicate_frame_rate"] == 0
    assert all(np.isfinite(list(visual.features(f[:2]).values())))
    with pytest.raises(ValueError):
        visual.features(f[:0])


def test_audio_pitch_and_limits():
    t = np.arange(48000) / 16000
    x = sum(np.sin(2 * np.pi * 140 * k * t) / k for k in range(1, 8)) * 0.2
    g = audio.features(x)
    assert len(g) == 71 and abs(g["f0_mean"] - 140) < 5 and g["voiced_fraction"] > 0.75
    assert audio.features(np.zeros(10)) is None and all(np.isfinite(list(audio.features(np.zeros(8000)).values())))


@pytest.mark.parametrize("shift", [0, 200, -240, 320])
def test_offset_recovered(spark, shift):
    curve = clips.activity_curves(clips.generate(spark, 1, shift_ms=shift))
    lag = Q.peak(Q.cross_correlation(curve, "clip_id", "t", "a", "b", 12), "clip_id").first().lag
    assert abs(lag * 40 - shift) <= 45


def test_unavailable_clips(spark):
    df = spark.createDataFrame([(1, None, None, 25.0, None, 16000), (2, b"", [0, 8, 8, 3], 25.0, np.zeros(10, np.float32).tobytes(), 16000)], clips.CLIP)
    for found in (clips.visual_features(df), clips.audio_features(df)):
        assert all(not r.available and r.reason and r.features is None for r in found.collect())


# models and audit


def test_bagged_model_learns(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 480)
    v = rng.normal(size=(480, 12))
    v[:, 0] += 2 * y
    v[:, 1] += 1.2 * y
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(v, y, strict=True))], "id int, v array<double>, y int")
    model = models.fit_bagged(df.where("id < 336"), "v", "y").agg(F.collect_list("coefs").alias("coefs"))
    s = df.where("id >= 336").crossJoin(model).withColumn("members", models.member_probabilities(F.col("v"), F.col("coefs")))
    s = s.select("id", models.vacuity(F.col("members"))["mean"].alias("score"), (F.col("y") == 1).alias("label"))
    assert audit.roc_auc(s).first().auc > 0.85 and audit.ece(s).first().ece < 0.25
    ci = audit.bootstrap_auc(s, 50).first()
    assert ci.low <= audit.roc_auc(s).first().auc <= ci.high


def test_logistic_objective():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 3))
    y = (x[:, 0] + rng.normal(size=100) > 0.5).astype(float)
    w = models.solve_logistic(x, y)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(np.append(x.T @ (weight * (p - y)) + w[:-1] / models.C_VALUE, (weight * (p - y)).sum())).max() < 1e-6


@pytest.mark.parametrize(("scores", "labels", "want"), [([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), ([0.1, 0.2, 0.8, 0.9], [1, 1, 0, 0], 0.0), ([0.5] * 4, [0, 1, 0, 1], 0.5), ([0.1, 0.9], [1, 1], 0.5)])
def test_auc_extremes(spark, scores, labels, want):
    df = spark.createDataFrame([(i, s, bool(v)) for i, (s, v) in enumerate(zip(scores, labels, strict=True))], "id int, score double, label boolean")
    assert audit.roc_auc(df).first().auc == want


# sources and streams


class Ranges(BaseHTTPRequestHandler):
    data, ranges, sent = b"", True, 0

    def do_GET(self):
        span = self.headers.get("Range")
        if not (span and Ranges.ranges):
            self.send_response(200)
            self.send_header("Content-Length", str(len(Ranges.data)))
            self.end_headers()
            return
        a, z = (int(x) for x in span[6:].split("-"))
        part = Ranges.data[a : z + 1]
        Ranges.sent += len(part)
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{z}/{len(Ranges.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *a):
        pass


def test_remote_zip(spark):
    rng, z = np.random.default_rng(0), io.BytesIO()
    members = {f"clip/{i:02d}.bin": rng.bytes(40_000) for i in range(60)}
    with zipfile.ZipFile(z, "w") as f:
        for n, x in members.items():
            f.writestr(n, x)
        f.writestr("dir/meta.txt", "meta")
    Ranges.data, Ranges.ranges, Ranges.sent = z.getvalue(), True, 0
    server = HTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.zip"
    try:
        spark.dataSource.register(remote_zip.RemoteZip)
        read = spark.read.format("remote_zip").option("url", url)
        few = read.option("prefix", "clip/0").option("block", 4096).load()
        assert {r.name: bytes(r.content) for r in few.collect()} == {n: x for n, x in members.items() if n.startswith("clip/0")}
        assert Ranges.sent < len(Ranges.data) / 2
        every = spark.read.format("remote_zip").option("url", url).option("membersPerPartition", 20).load()
        assert {r.name: r.size for r in every.collect()} == {n: len(x) for n, x in members.items()} | {"dir/meta.txt": 4}
        Ranges.ranges = False
        with pytest.raises(OSError, match="no range support"):
            remote_zip.RangeFile(url)
    finally:
        server.shutdown()


def test_text_sources(spark, tmp_path):
    lines = spark.createDataFrame([(" a u1 - A01 spoof ",), ("garbage line",), ("b u2 - - bonafide extra",), ("",)], "value string")
    assert [tuple(r) for r in S.parse_protocol(lines).collect()] == [("a", "u1", "A01", "spoof"), ("b", "u2", "-", "bonafide")]
    rows = spark.createDataFrame([(1, 0, "x|y"), (1, 1, 'q"z')], "c int, s int, b string")
    chain = custody.build_chain(rows, "c", "s", "b")
    S.write_ledger(chain, f"{tmp_path}/ledger")
    back = S.read_ledger(spark, f"{tmp_path}/ledger").withColumn("c", F.lit(1))
    assert custody.check_chain(back, "c").first().valid and back.count() == 2
    m = spark.createDataFrame([("k", ["a", 'b"c']), ("l", [])], "clip_id string, ops array<string>")
    S.write_manifest(m, f"{tmp_path}/manifest")
    read = S.read_manifest(spark, f"{tmp_path}/manifest", "clip_id string, ops string").withColumn("ops", S.json_list(F.col("ops")))
    assert {(r.clip_id, tuple(r.ops)) for r in read.collect()} == {("k", ("a", 'b"c')), ("l", ())}


def test_stream_triage_is_idempotent(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(list(r), "sha string, seq long")
    path = f"file://{tmp_path}/reg"
    for _ in range(2):
        triage_stream.triage_batch(df(("a", 1), ("a", 2), ("b", 3)), 0, path)
    triage_stream.triage_batch(df(("a", 9), ("c", 10)), 1, path)
    assert sorted(tuple(r) for r in triage_stream.registered(spark, path).collect()) == [("a", 1, 0), ("b", 3, 0), ("c", 10, 1)]
    df(("d", 20)).write.parquet(f"{tmp_path}/in")
    triage_stream.start(spark.readStream.schema("sha string, seq long").parquet(f"{tmp_path}/in"), f"file://{tmp_path}/reg2", f"{tmp_path}/ck").awaitTermination(60)
    assert triage_stream.registered(spark, f"file://{tmp_path}/reg2").count() == 1


def test_intervals_and_windows(spark):
    i = spark.createDataFrame([(1, 0.0, 1.0, 0.3, 2, 1.0), (1, 1.0, 2.0, 0.1, -5, 3.0), (1, 3.0, 4.0, 0.2, 1, 1.0)], "clip int, start_s double, end_s double, corr double, lag int, severity double")
    assert sorted(tuple(r) for r in Q.merge_intervals(i, "clip").collect()) == [(1, 0.0, 2.0, 0.1, -5, 3.0), (1, 3.0, 4.0, 0.2, 1, 1.0)]
    t = spark.range(20).select(F.lit(1).alias("clip"), F.col("id").alias("t"))
    got = {r.start: r.n for r in Q.hopping(t, "clip", "t", 8, 5).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 8, 5: 8, 10: 8} and Q.hopping(t.where("t < 5"), "clip", "t", 8, 5).count() == 0


def test_mahalanobis_uses_all_rows(spark):
    # One vector 20,000 times over, beside 500 others.
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(rng.normal(size=4), (20_000, 1)), rng.normal(size=(500, 4)) * [1, 2, 3, 4]])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "i long, v array<double>").repartition(7)
    c = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.pinv(models.shrunk_covariance(x)), c))
    got = models.mahalanobis(df, "v").toPandas().sort_values("i")["distance"].to_numpy()
    assert np.allclose(got, want)


def test_matched_readout_refits(spark):
    rng = np.random.default_rng(4)
    y = rng.random(400) < 0.4
    v = rng.normal(size=(400, 3)) * [1, 5, 0.1] + 2
    v[:, 1] += 12 * y
    df = spark.createDataFrame([(i, a.tolist(), bool(b)) for i, (a, b) in enumerate(zip(v, y, strict=True))], "id long, v array<double>, label boolean").repartition(3)
    train = np.arange(400) % 10 < 7
    rows = df.select("v", F.array(F.col("id") % 10 < 7).alias("train"), F.array("label").alias("y"))
    got = sorted(r.score for r in audit.matched_readout(rows, [9]).collect())
    z = (v - v[train].mean(0)) / v[train].std(0)
    w = models.solve_logistic(z[train], y[train].astype(float))
    assert np.allclose(got, np.sort(1 / (1 + np.exp(-(z[~train] @ w[:-1] + w[-1])))))
    five = audit.multiseed(df, list(range(5))).first()
    assert five.passed and five.n_seeds == 5 and five.low <= five.mean_auc <= five.high and five.std_auc > 0 and five.mean_auc > 0.8
    floor = audit.coherence_floor(df, list(range(5))).first()
    assert floor.n_seeds == 5 and 0.3 < floor.mean_auc < 0.7
    ci = audit.bootstrap_auc(df.select("id", F.element_at("v", 2).alias("score"), "label")).first()
    assert ci.replicates == 1000 and ci.low < ci.auc < ci.high


def test_curves_reach_the_last_hour(spark, tmp_path):
    from attestra.queries import QUERIES

    times = [(h, h % 3, "view", 1.0 + h) for h in (0, 10, 250, 719)]
    df = spark.createDataFrame(times, "h long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600)).drop("h").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["time_shift"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 * 720 and {(r.t, r.shifted) for r in rows if r.shifted} == {(3, 1.0), (13, 11.0), (253, 251.0)}
    windows = QUERIES["hopping_windows"](spark, str(tmp_path)).collect()
    assert max(r.start for r in windows) == 690 and sum(r.total for r in windows if r.start == 690) == 0


def test_all_features(spark, sf):
    from attestra.queries import QUERIES

    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    z = QUERIES["standardise"](spark, sf)
    assert z.count() == 64 * n and abs(z.where("j = 63").agg(F.avg("z")).first()[0]) < 1e-5
    cov = {(r.i, r.j): r["cov"] for r in QUERIES["feature_covariance"](spark, sf).collect()}
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    want = np.cov(v, rowvar=False)
    assert len(cov) == 64 * 64 and all(abs(want[k] - x) < 2e-6 for k, x in cov.items())
