"""Acquisition chain over a local range server, directories, and the record of what failed."""

import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from attestra.sources import acquire, remote_zip


class Kept(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    data, links, broken = b"", set(), 0

    def do_GET(self):
        Kept.links.add(self.client_address)
        if Kept.broken:
            Kept.broken -= 1
            self.close_connection = True
            return
        a, z = (int(x) for x in self.headers["Range"][6:].split("-"))
        part = Kept.data[a : z + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{z}/{len(Kept.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def archive():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for i in range(12):
            f.writestr(f"gen{i % 2}/clip{i:02d}.mp4", bytes([i]) * (1000 + i))
        f.writestr("gen0/notes.txt", "no media")
    Kept.data = z.getvalue()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Kept)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/a.zip"
    server.shutdown()


def test_one_connection_is_kept_and_made_anew(archive):
    Kept.links.clear()
    f = remote_zip.RangeFile(archive, block=512)
    for i in range(10):
        f.seek(i * 600)
        assert f.read(300) == Kept.data[i * 600 : i * 600 + 300]
    assert len(Kept.links) == 1
    Kept.broken = 2
    f.cache.clear()
    f.seek(100)
    assert f.read(50) == Kept.data[100:150]


def test_pick_skip_fetch_and_tell(spark, archive, tmp_path):
    with zipfile.ZipFile(io.BytesIO(Kept.data)) as z:
        rows = [(archive, i.filename, i.file_size, i.filename.split("/")[0]) for i in z.infolist()]
    index = spark.createDataFrame([*rows, (archive, "gen0/gone.mp4", 10, "gen0"), (archive, "gen1/huge.mp4", 10**9, "gen1")], "archive string, member string, size long, generator string")
    none = index.where("false")
    picked = acquire.select_members(index, none, "generator", 100, 5000)
    members = {r.member for r in picked.collect()}
    assert "gen0/notes.txt" not in members and "gen1/huge.mp4" not in members and "gen0/gone.mp4" in members
    few = acquire.select_members(index, none, "generator", 3, 5000)
    done = few.limit(2)
    assert few.count() == 6 and acquire.select_members(index, done, "generator", 3, 5000).count() == 4

    out = str(tmp_path)

    def sink(url, member, data):
        with open(f"{out}/{member.replace('/', '_')}", "wb") as f:
            f.write(data)
        return len(data)

    wanted = picked.select("archive", "member").unionByName(spark.createDataFrame([("http://127.0.0.1:9/x.zip", "m")], "archive string, member string"))
    got = {(r.archive == archive, r.member): r for r in acquire.fetch_remote(wanted, sink, 2).cache().collect()}
    assert sum(r.status == "ok" for r in got.values()) == 12 and got[True, "gen0/gone.mp4"].reason.startswith("KeyError") and got[False, "m"].status == "fail"
    assert (tmp_path / "gen1_clip03.mp4").read_bytes() == b"\x03" * 1003 and got[True, "gen1/clip03.mp4"].result == "1003"


def test_local_archives_give_the_same_attempts(spark, archive):
    archives = spark.createDataFrame([("a.zip", bytearray(Kept.data))], "archive string, content binary")
    wanted = spark.createDataFrame([("a.zip", "gen0/clip00.mp4"), ("a.zip", "gen0/gone.mp4")], "archive string, member string")
    got = acquire.fetch_local(wanted, archives, lambda a, m, d: len(d)).cache()
    assert {(r.member, r.status, r.bytes, r.result) for r in got.collect()} == {("gen0/clip00.mp4", "ok", 1000, "1000"), ("gen0/gone.mp4", "fail", 0, None)}
    assert [tuple(r) for r in acquire.summary(got).collect()] == [("a.zip", 1, 1, 1000)]


def test_directory_manifest(spark, tmp_path):
    from attestra.sources import files

    for c in ("RealVideo-RealAudio", "FakeVideo-RealAudio"):
        for i in range(6):
            p = tmp_path / c / "g" / f"id{i}"
            p.mkdir(parents=True)
            (p / "0.mp4").write_bytes(b"x" * (i + 1))
    m = acquire.directory_manifest(files.scan(spark, str(tmp_path), "*.mp4").drop("content"), 4, [("train", 0.5), ("test", 0.5)])
    rows = m.collect()
    assert len(rows) == 8 and {(r.condition, r.label_video) for r in rows} == {("RealVideo-RealAudio", "real"), ("FakeVideo-RealAudio", "fake")}
    assert sum(r.split == "train" for r in rows) == 4 and all(len(r.sha256) == 64 for r in rows)


# Runs that end early


def test_run_broken_off_is_resumed(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for i in range(100):
            f.writestr(f"v/clip{i:03d}.mp4", bytes([i]) * 500)
    before, Kept.data = Kept.data, z.getvalue()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Kept)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, media, log = f"http://127.0.0.1:{server.server_port}/b.zip", tmp_path / "media", str(tmp_path / "log")
    media.mkdir()
    out = str(media)
    try:
        wanted = spark.createDataFrame([(url, f"v/clip{i:03d}.mp4", f"clip{i:03d}.mp4") for i in range(100)], "archive string, member string, place string")
        listing = lambda: spark.createDataFrame([(str(p), p.stat().st_size) for p in media.iterdir()] or [("", 0)], "path string, length long")

        def sink(last):
            def put(archive, member, data):
                import os

                if len(os.listdir(out)) == last:
                    raise KeyboardInterrupt("broken off")
                with open(f"{out}/{member[2:]}", "wb") as f:
                    f.write(data)
                return member[2:]

            return put

        with pytest.raises(Exception):  # noqa: B017
            acquire.fetch_remote(wanted, sink(40), 1, log).collect()
        assert len(list(media.iterdir())) == 40
        (tmp_path / "log" / "attempts-spoiled.json").write_text('{"archive": "x", "mem\n{"archive": 3')
        done, rest = acquire.resume(wanted, listing(), log)
        kinds = [r.reason for r in done.collect()]
        assert len(kinds) == 40 and kinds.count("resumed_from_disk") == 15 and rest.count() == 60  # 25 by the log
        assert {r.status for r in acquire.fetch_remote(rest, sink(-1), 2, log).collect()} == {"ok"}
        done, rest = acquire.resume(wanted, listing(), log)
        assert done.count() == 100 and rest.count() == 0 and len(list(media.iterdir())) == 100
        (media / "clip000.mp4").write_bytes(b"")
        lost = acquire.resume(wanted, listing(), str(tmp_path / "nowhere"))
        assert lost[0].count() == 99 and [r.place for r in lost[1].collect()] == ["clip000.mp4"]
    finally:
        server.shutdown()
        Kept.data = before


def test_filters_are_answered_by_the_directory(spark, archive):
    remote_zip.register(spark)
    read = lambda: spark.read.format("remote_zip").option("url", archive).option("block", 512).option("membersPerPartition", 2).load()
    few = read().where("size > 1008 AND name LIKE 'gen0/%'").where("name LIKE '%.mp4'")
    assert sorted(r.name for r in few.collect()) == ["gen0/clip10.mp4"]
    assert few.rdd.getNumPartitions() == 1 and read().rdd.getNumPartitions() == 7
    assert sorted(r.name for r in read().where("name IN ('gen0/clip00.mp4', 'none') OR size = 1003").collect()) == ["gen0/clip00.mp4", "gen1/clip03.mp4"]  # not pushed: still right
    assert read().where("name = 'gen0/clip02.mp4'").select(remote_zip_length()).first()[0] == 1002


def remote_zip_length():
    from pyspark.sql import functions as F

    return F.length("content")


def test_archives_are_written_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    from attestra.sources import packed

    remote_zip.register(spark, packed.Packed)
    path = f"file://{tmp_path}/out"
    rows = spark.range(50).repartition(4).select(F.format_string("r%02d/record.json", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    read = lambda: spark.read.format("packed").load(path)
    assert read().count() == 0
    rows.write.format("packed").mode("append").save(path)
    assert len(list((tmp_path / "out").glob("part-*.zip"))) == 4 and read().count() == 50
    assert {(r.name, bytes(r.content)) for r in read().where("name LIKE 'r1%'").collect()} == {(f"r{i}/record.json", str(i).encode()) for i in range(10, 20)}
    assert read().where("name = 'r07/record.json'").rdd.getNumPartitions() == 1
    bad = rows.unionByName(rows.limit(1).withColumn("name", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="a record needs a name"):
        bad.write.format("packed").mode("append").save(path)
    assert len(list((tmp_path / "out").glob("manifest-*"))) == 1 and read().count() == 50
    rows.limit(3).write.format("packed").mode("overwrite").save(path)
    assert read().count() == 3
