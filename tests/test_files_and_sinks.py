"""Byte scans, configuration, open media, archives, corpus builds, sinks and model tables."""

import io
import json
import zipfile

import numpy as np
import pytest

from attestra import sinks
from attestra.operators import corpus, seal
from attestra.sources import files


def tone(rate=8000, seconds=0.5, channels=2):
    import wave

    t = np.arange(int(rate * seconds)) / rate
    x = (np.sin(2 * np.pi * 440 * t) * 20000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def frames(dtype=np.uint8):
    out = io.BytesIO()
    np.save(out, np.arange(10 * 8 * 8 * 3).reshape(10, 8, 8, 3).astype(dtype))
    return out.getvalue()


def test_ingest_of_open_media(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name, data in (("a.wav", tone()), ("b.npy", frames()), ("c.bin", b"neither"), ("short.wav", b"RIFF")):
        (tmp_path / "in" / name).write_bytes(data)
    scanned = files.scan(spark, str(tmp_path / "in"))
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in scanned.collect()}["a.wav"] == hashlib.sha256(tone()).hexdigest()
    got = {r.path.rsplit("/", 1)[1]: r for r in files.ingest(scanned).collect()}
    a, b = got["a.wav"], got["b.npy"]
    assert a.transforms == ["strip_metadata", "resample", "downmix"] and a.sample_rate == 16000 and len(a.audio) == 8000 * 4
    assert json.loads(a.probe)["streams"][0]["channels"] == "2" and a.canonical_sha256 != a.source_sha256
    spectrum = np.abs(np.fft.rfft(np.frombuffer(bytes(a.audio), np.float32)))
    assert abs(spectrum.argmax() * 2 - 440) <= 4
    assert b.shape == [10, 8, 8, 3] and bytes(b.frames) == np.load(io.BytesIO(frames())).tobytes() and b.canonical_sha256 == b.source_sha256
    assert got["c.bin"].error.startswith("ValueError") and got["short.wav"].error and got["c.bin"].canonical_sha256 is None
    # The canonical form is its own canonical form.
    plain, done = files.canonical(files.canonical(tone())[0])
    assert plain == files.canonical(tone())[0] and done == ["strip_metadata"]


def test_config_overlay_and_tiers(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"fusion": {"vacuity_penalty": 1.0}}))
    c = files.load_config(spark, str(p))
    assert c["fusion"] == {"vacuity_penalty": 1.0} and c["triage"] == files.DEFAULTS["triage"]
    for bad in ({"nope": 1}, {"fusion": {"nope": 1}}):
        with pytest.raises(KeyError):
            files.overlay(bad)
    edge = files.apply_tier(c, "edge")
    assert (edge["device_tier"], edge["detection"]["tier2_enabled"], edge["detection"]["visual_frames"]) == ("edge", False, 16)
    with pytest.raises(ValueError):
        files.apply_tier(c, "toaster")
    assert seal.digest({"b": 1, "a": 2}) == seal.digest({"a": 2, "b": 1}) != seal.digest({"a": 2})


def test_read_json_keeps_unparsable_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": 1}')
    (tmp_path / "b.json").write_text("{nope")
    assert sorted(r.x or 0 for r in files.read_json(spark, str(tmp_path), "x int").collect()) == [0, 1]


def test_archives_failures_and_sink(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("m1", b"one")
        f.writestr("m2", b"two2")
    archives = spark.createDataFrame([("ok", bytearray(z.getvalue())), ("bad", bytearray(b"no zip"))], "archive string, content binary")
    wanted = spark.createDataFrame([("ok", "m1"), ("ok", "m2"), ("ok", "gone"), ("bad", "x"), ("absent", "y")], "archive string, member string")
    got = files.extract(archives, wanted)
    rows = {(r.archive, r.member): r for r in got.collect()}
    assert bytes(rows["ok", "m2"].data) == b"two2" and rows["ok", "gone"].error.startswith("KeyError") and rows["bad", "x"].error and rows["absent", "y"].error
    stats = {r.archive: (r.n, r.failed, r.bytes) for r in files.transfer_stats(got).collect()}
    assert stats == {"ok": (2, 1, 7), "bad": (0, 1, 0), "absent": (0, 1, 0)}
    assert {r.result for r in files.sink(got, lambda a, m, d: len(d)).collect()} == {"3", "4"}


def test_failed_clips_stay_as_rows(spark):
    def make(row):
        if row["clip_id"] == "b":
            raise RuntimeError("renderer broke")
        return {"clip_id": row["clip_id"], "n": 3}

    plan = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    got = {r.clip_id: (r.n, r.error) for r in corpus.build(plan, make, "clip_id string, n long").collect()}
    assert got["a"] == (3, None) and got["b"][1] == "RuntimeError: renderer broke"


def test_sinks_and_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 0.123456, None), ("r2", 12345.67, "x|y")], "record_id string, score double, note string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_records(df, str(tmp_path / "r"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "id=r2")).orderBy("value").collect())
    assert '"record_id" : "r2"' in text
    sinks.write_table(df, str(tmp_path / "t"))
    assert {r.score for r in spark.read.csv(str(tmp_path / "t"), header=True).collect()} == {"0.1235", "12345.7"}
    lines = [r.line for r in sinks.markdown(df).orderBy("line_no", "line").collect()]
    assert lines[:2] == ["| record_id | score | note |", "|---|---|---|"] and "| r2 | 12345.7 | x\\|y |" in lines
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    model = spark.createDataFrame([("visual", [0.1, -0.2], 1e-17)], "branch string, coef array<double>, bias double")
    sinks.save_model(model, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")).collect() == model.collect()


def test_environment_device_and_stamp(spark):
    env = seal.environment(spark).first().environment
    assert env["spark"] == spark.version and set(env) >= {"python", "numpy"}
    assert seal.device(spark).first().tier in ("cloud", "consumer", "edge")
    from pyspark.sql import functions as F

    stamp = spark.range(1).select(seal.timestamp(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("t")).first().t
    assert stamp.is_qualified is False and stamp.authority == "local_nonqualified" and stamp.utc_iso.startswith("2024-05-06T07:08:09.000")


def test_seal_does_not_depend_on_time_and_marks_missing_tracks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("r", "c", "s", "v", None, "cfg", "{}", "f", "REAL"), ("r", "c", "s", "v", "a", "cfg", "{}", "f", "REAL")], "record_id string, clip_id string, canonical_sha256 string, video_root string, audio_root string, config_digest string, models string, feature_schema string, verdict string")
    roots = [[r.combined_root for r in seal.seal(rows, F.lit(t).cast("timestamp")).collect()] for t in ("2024-01-01 00:00:00", "2030-01-01 00:00:00")]
    assert roots[0] == roots[1] and roots[0][0] != roots[0][1]
    changed = rows.withColumn("verdict", F.lit("UNKNOWN"))
    assert seal.seal(changed, F.current_timestamp()).first().combined_root not in roots[0]


def test_ledgers_of_several_chains_stay_apart(spark, tmp_path):
    from attestra.operators import custody
    from attestra.sources import text

    rows = spark.createDataFrame([(c, i, f"{c}{i}") for c in "ab" for i in range(20)], "chain string, seq int, body string")
    chains = custody.build_chain(rows, "chain", "seq", "body")
    text.write_ledger(chains, str(tmp_path / "l"), "chain")
    for c in "ab":
        back = text.read_ledger(spark, str(tmp_path / "l" / f"chain={c}")).orderBy("pos").collect()
        assert [r["index"] for r in back] == list(range(20)) and [r.payload for r in back] == [f"{c}{i}" for i in range(20)]
        assert all(b.prev_hash == a.entry_hash for a, b in zip(back, back[1:], strict=False))


def test_ledger_in_many_files_and_splits(spark, tmp_path):
    from pyspark.sql import functions as F

    from attestra.operators import custody
    from attestra.sources import text

    rows = spark.range(3000).select(F.lit(1).alias("chain"), F.col("id").alias("seq"), F.format_string("entry %d \u00e9", "id").alias("body"))
    chain = custody.build_chain(rows, "chain", "seq", "body").repartition(7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        text.write_ledger(chain, str(tmp_path / "l"))
        assert len(list((tmp_path / "l").glob("part-*.txt"))) > 1
        first = sorted((tmp_path / "l").glob("part-*.txt"))[0]
        first.write_text("\n" + first.read_text())  # a blank line
        for p in (tmp_path / "l").glob(".*.crc"):
            p.unlink()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        back = text.read_ledger(spark, str(tmp_path / "l"))
        got = [(r.pos, r["index"]) for r in back.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert got == [(i + 1, i) for i in range(3000)]
    assert custody.check_chain(back.withColumn("chain", F.lit(1)), "chain").first().valid
