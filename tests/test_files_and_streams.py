from __future__ import annotations

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators.checks import InvalidInput
from sightline.operators.clusters import scene_clusters
from sightline.operators.frames import select_interval
from sightline.sources import files
from sightline.storage import filesystem_of
from sightline.streaming import live


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(pixels: np.ndarray, kinds: list[int]) -> bytes:
    h, w, _ = pixels.shape
    raw, above = b"", np.zeros(3 * w, int)
    for y in range(h):
        line = pixels[y].reshape(-1).astype(int)
        left = np.concatenate((np.zeros(3, int), line[:-3]))
        corner = np.concatenate((np.zeros(3, int), above[:-3]))
        paeth = [min((a, b, c), key=lambda v, p=a + b - c: abs(p - v)) for a, b, c in zip(left, above, corner, strict=True)]
        guess = [np.zeros(3 * w, int), left, above, (left + above) // 2, np.array(paeth)][kinds[y]]
        raw += bytes([kinds[y]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"sRGB", b"\x00") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_filters_and_damage(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    data = png(pixels, [0, 1, 2, 3, 4])
    assert (files.png_pixels(data) == pixels).all()
    for bad in (data[:-20], data.replace(b"sRGB", b"sXGB"), b"x" + data):
        with pytest.raises(files.InvalidFile):
            files.png_pixels(bad)
    (tmp_path / "a.png").write_bytes(data)
    row = files.read_png(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (row.width, row.height, bytes(row.rgb)) == (4, 5, pixels.tobytes())


def test_hashes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    data = {"f": b"abc" * 1000, "d/ü g.bin": b"", "d/h": bytes(range(256)) * 5000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    for block in (7, 1 << 20):
        found = {(r.sha256, r.byte_length) for r in files.content_hashes(spark, str(tmp_path), block=block).collect()}
        assert found == {(hashlib.sha256(x).hexdigest(), len(x)) for x in data.values()}
    assert files.content_hashes(spark, str(tmp_path / "d" / "h")).count() == 1
    blob = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary").select(files.git_blob_sha1(F.col("c")).alias("s")).first().s
    assert blob == hashlib.sha1(b"blob 6\x00hello\n").hexdigest()


def tiff(order: str) -> bytes:
    def field(tag, kind, n, value):
        return struct.pack(order + "HHI", tag, kind, n) + value

    gps_at, text_at, lat_at = 8 + 2 + 2 * 12 + 4, 100, 120
    body = struct.pack(order + "H", 2) + field(0x0110, 2, 8, struct.pack(order + "I", text_at)) + field(0x8825, 4, 1, struct.pack(order + "I", gps_at)) + b"\0\0\0\0"
    gps = struct.pack(order + "H", 2) + field(1, 2, 2, b"N\0\0\0") + field(2, 5, 3, struct.pack(order + "I", lat_at)) + b"\0\0\0\0"
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + gps
    out = out.ljust(text_at, b"\0") + b"Camera5\0"
    return out.ljust(lat_at, b"\0") + struct.pack(order + "IIIIII", 10, 1, 30, 1, 73, 2)


@pytest.mark.parametrize("order", "<>")
def test_exif(spark, tmp_path, order):
    want = [("GPS GPSLatitude", "[10, 30, 73/2]"), ("GPS GPSLatitudeRef", "N"), ("Image Model", "Camera5")]
    block = b"Exif\0\0" + tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"
    assert files.exif_entries(tiff(order)) == files.exif_entries(jpeg) == want
    assert files.exif_entries(b"\xff\xd8\xff\xd9") == files.exif_entries(b"") == []
    (tmp_path / "a.jpg").write_bytes(jpeg)
    rows = files.read_exif(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("position").collect()
    assert [(r.key, r.value) for r in rows] == want


def test_ply():
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nend_header\n".encode()
    data = head + np.array([1, 2, 3, 4], "<f4").tobytes()
    assert files.ply_records(data, ["x", "y"]).tolist() == [[1, 2], [3, 4]]
    for bad in (data[:-1], data.replace(b"float y", b"float z"), head + np.array([1, 2, 3, np.nan], "<f4").tobytes()):
        with pytest.raises(files.InvalidFile):
            files.ply_records(bad, ["x", "y"])


def test_fixtures(spark, tmp_path):
    good = {"schema_version": 1, "fixture_id": "f", "kind": "synthetic", "lane": "fast", "deterministic": True, "input_files": ["a.json"], "expectations": [{"metric": "m", "comparator": "eq", "target": 1.0, "abs_tolerance": 0.1}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert files.expectations_of(files.load_fixtures(spark, str(tmp_path))).first().metric == "m"
    (tmp_path / "a.json").write_text(json.dumps(good | {"input_files": ["../a"]}))
    with pytest.raises(InvalidInput):
        files.load_fixtures(spark, str(tmp_path))


REL = "id1 string, id2 string, disposition string, evidence array<struct<kind:string,id:string>>"


def feed(spark, tmp_path, rows, name, at):
    spark.createDataFrame(rows, name).coalesce(1).write.parquet(str(tmp_path / "in" / f"{at}"))


def run_stream(spark, tmp_path, schema, start):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start(stream)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_relation_stream_equals_batch(spark, tmp_path):
    rows = [("a", "b", "SUPPORTED", [("k", "1")]), ("b", "c", "SUPPORTED", [("k", "2")]), ("d", "e", "UNRESOLVED", [])]
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    start = lambda stream: live.stream_relations(stream, live.RelationLog(spark, folder), checkpoint)
    feed(spark, tmp_path, rows[:1], REL, 0)
    run_stream(spark, tmp_path, REL, start)
    # a restart from the checkpoint, with a new log over the same folder
    feed(spark, tmp_path, rows[1:], REL, 1)
    run_stream(spark, tmp_path, REL, start)
    log = live.RelationLog(spark, folder)
    obs = spark.createDataFrame([(x,) for x in "abcde"], "observation_id string")
    got, want = (sorted(tuple(r.members) for r in scene_clusters(obs, x).collect()) for x in (log.rows, spark.createDataFrame(rows, REL)))
    assert got == want
    assert log.table.marked() == [0, 1]
    # the last batch again adds nothing; a new one must rise
    log.add(spark.createDataFrame(rows[1:], REL), 1)
    assert live.RelationLog(spark, folder).rows.count() == 3
    for bad in (rows[:1], [("x", "y", "SUPPORTED", [])] * 2, [("z", "y", "SUPPORTED", [])]):
        with pytest.raises(InvalidInput):
            log.add(spark.createDataFrame(bad, REL), 2)
    log.add(spark.createDataFrame([], REL), 2)
    with pytest.raises(InvalidInput):
        live.RelationLog(spark, folder).add(spark.createDataFrame(rows[1:], REL), 3)
    log.add(spark.createDataFrame([("d", "f", "SUPPORTED", [])], REL), 3)
    assert log.rows.count() == 4


def test_a_batch_without_its_mark_is_written_anew(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = live.RelationLog(spark, folder)
    log.add(spark.createDataFrame([("a", "b", "SUPPORTED", [])], REL), 0)
    log.add(spark.createDataFrame([("b", "c", "SUPPORTED", []), ("b", "d", "SUPPORTED", [])], REL), 1)
    (tmp_path / "log" / "marks" / f"{1:012d}" / "_SUCCESS").unlink()  # as if the driver had died before
    assert log.rows.count() == 1
    log.add(spark.createDataFrame([("b", "c", "SUPPORTED", []), ("b", "d", "SUPPORTED", [])], REL), 1)
    assert sorted((r.id1, r.id2) for r in log.rows.collect()) == [("a", "b"), ("b", "c"), ("b", "d")]


def test_record_table(spark, tmp_path):
    schema = "record_type string, record_id string, payload string"
    folder = str(tmp_path / "records")
    table = live.RecordTable(spark, folder)
    table.add(spark.createDataFrame([("t", "1", "a")], schema), 0)
    table.add(spark.createDataFrame([("t", "1", "a"), ("t", "2", "b")], schema), 1)
    again = live.RecordTable(spark, folder)
    again.add(spark.createDataFrame([("t", "1", "a"), ("t", "2", "b")], schema), 1)
    assert again.rows.count() == 2
    assert again.marks.numbers() == [0, 1] and again.touched["added"] == 1
    with pytest.raises(InvalidInput):
        again.add(spark.createDataFrame([("t", "1", "z"), ("t", "3", "c")], schema), 2)
    assert live.RecordTable(spark, folder).rows.count() == 2


def test_record_stream(spark, tmp_path):
    schema = "record_type string, record_id string, payload string"
    folder, checkpoint = str(tmp_path / "records"), str(tmp_path / "cp")
    start = lambda stream: live.stream_records(stream, live.RecordTable(spark, folder), checkpoint)
    for at, rows in enumerate(([("t", "1", "a")], [("t", "1", "a"), ("t", "2", "b")], [("u", "1", "c")])):
        feed(spark, tmp_path, rows, schema, at)
        run_stream(spark, tmp_path, schema, start)
    assert sorted(map(tuple, live.RecordTable(spark, folder).rows.collect())) == [("t", "1", "a"), ("t", "2", "b"), ("u", "1", "c")]


def test_interval_stream_equals_batch(spark, tmp_path):
    schema = "video_id string, frame_index bigint, frame_time_us bigint"
    rows = [("v", i, t) for i, t in enumerate([0, 400, 500, 900, 1000, 1500])]
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stream_interval(stream, 500).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = select_interval(spark.createDataFrame(rows, schema), 500)
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, want.collect()))


FRAMES = "video_id string, frame_index bigint, frame_time_us bigint"


def interval_stream(spark, tmp_path, batches, interval, delay):
    """A batch and a restart for each of the batches; all that came out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(FRAMES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = live.stream_interval(stream, interval, delay_us=delay).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return sorted(map(tuple, spark.read.schema(FRAMES).parquet(str(tmp_path / "out")).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_interval_stream_puts_frames_in_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(v, i, i * 100 + rng.randint(0, 40)) for v in "ab" for i in range(50)]
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 290))
    cuts = sorted(rng.sample(range(1, 100), 3))
    batches = [late[a:b] for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
    got = interval_stream(spark, tmp_path, [*batches, [("a", None, None), ("b", None, None)]], 250, 300)
    assert got == sorted(map(tuple, select_interval(spark.createDataFrame(rows, FRAMES), 250).collect()))


def test_a_frame_that_comes_too_late_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="100 us late"):
        interval_stream(spark, tmp_path, [[("a", 0, 0), ("a", 2, 500), ("b", 0, 0)], [("b", 1, 10), ("a", 1, 399)]], 50, 100)


def test_stores_by_their_names(tmp_path):
    import pyarrow.fs

    for uri in (f"{tmp_path}/ü a:b", f"file:{tmp_path}/ü a:b", f"file://{tmp_path}/ü a:b"):
        store, place = filesystem_of(uri)
        assert isinstance(store, pyarrow.fs.LocalFileSystem) and place == f"{tmp_path}/ü a:b"
    for scheme in ("s3", "s3a", "s3n"):
        store, place = filesystem_of(f"{scheme}://bucket/a/ü b?region=us-east-1")
        assert isinstance(store, pyarrow.fs.S3FileSystem) and place.startswith("bucket/a/")
    with pytest.raises((ValueError, OSError)):
        filesystem_of("unheard-of://x/y")


def test_staging_checks_what_it_copies(spark, tmp_path):
    (tmp_path / "a" / "d").mkdir(parents=True)
    (tmp_path / "a" / "d" / "f").write_bytes(b"x" * 5000)
    good = ("d/f", hashlib.sha256(b"x" * 5000).hexdigest(), 5000)
    manifest = lambda *rows: spark.createDataFrame(rows, files.FILE)
    found = files.stage_files(manifest(good), str(tmp_path / "a"), str(tmp_path / "b"), block=100)
    assert [tuple(r) for r in found.collect()] == [good] and (tmp_path / "b" / "d" / "f").read_bytes() == b"x" * 5000
    for bad in (("d/f", good[1], 4999), ("d/f", "0" * 64, 5000), ("../a/d/f", *good[1:])):
        with pytest.raises(Exception, match="InvalidFile"):
            files.stage_files(manifest(bad), str(tmp_path / "a"), str(tmp_path / "c")).collect()
    assert not [p for p in (tmp_path / "c").rglob("*") if p.is_file()]
    assert files.stage_files(manifest(), str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
