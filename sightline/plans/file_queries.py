"""Queries over files and streams that are made from the tables' rows, with the SQL that says the same."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, records
from ..operators.metadata import interpret_metadata
from ..scratch import scratch, shared_path
from ..shipping import ship_package
from ..sources import datasource, files
from ..streaming import live, scenes
from .bindings import bound, duck


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table that one task makes files of.
BUILD_ROWS = 2_000


def _built(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """Files (path, content) that build makes of rows with a path. Rows are dealt out first, as a small table is one task's."""
    ship_package(rows.sparkSession)
    rows = rows.repartition(max(1, -(-rows.count() // BUILD_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _directory(entries: list[tuple[int, int, bytes]], at: int) -> bytes:
    """A TIFF directory (tag, type, data) that lies at a place, with its data behind it; little-endian."""
    sizes = {2: 1, 3: 2, 4: 4, 5: 8}
    beyond = at + 2 + 12 * len(entries) + 4
    head, tail = struct.pack("<H", len(entries)), b""
    for tag, kind, data in sorted(entries):
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", beyond + len(tail))
        head += struct.pack("<HHI", tag, kind, len(data) // sizes[kind]) + place
        tail += data if len(data) > 4 else b""
    return head + b"\0\0\0\0" + tail


def _photo(row: dict) -> bytes:
    """An image file with the EXIF entries that the row's number gives: TIFF if it is even, else JPEG."""
    k = row["k"]
    text = lambda x: x.encode() + b"\0"
    place = lambda a, b, c, d: struct.pack("<6I", a, 1, b, 1, c, d)
    gps = [(1, 2, text("S" if k % 2 else "N")), (2, 5, place(k % 90, k % 60, k % 119, 2)), (18, 2, text("WGS-84"))]
    if k % 5:
        gps += [(3, 2, text("E" if k % 3 else "W")), (4, 5, place(k % 180, k % 60, k % 60, 1))]
    exif = [(0x8827, 3, struct.pack("<H", k % 400 + 100)), (0x9003, 2, text("2024:01:05 10:20:30"))]
    if k % 7:
        exif.append((0x9011, 2, text("+02:00" if k % 2 else "-05:30")))
    main = [(0x0110, 2, text(f"Model {k % 7}")), (0x8769, 4, b"\0" * 4), (0x8825, 4, b"\0" * 4)]
    exif_at = 8 + len(_directory(main, 8))
    gps_at = exif_at + len(_directory(exif, exif_at))
    main[1:] = [(0x8769, 4, struct.pack("<I", exif_at)), (0x8825, 4, struct.pack("<I", gps_at))]
    tiff = b"II" + struct.pack("<HI", 42, 8) + _directory(main, 8) + _directory(exif, exif_at) + _directory(gps, gps_at)
    return tiff if k % 2 == 0 else b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    return _built(_table(spark, sf, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("path"), F.col("p_partkey").alias("k")), _photo)


def io6_exif_entries(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_exif(_photos(spark, sf))


def io7_exif_ingest(spark: SparkSession, sf: str) -> DataFrame:
    found = interpret_metadata(scratch(files.read_exif(_photos(spark, sf)).withColumnRenamed("path", "observation_id"), "exif"))
    return found.withColumns({c: F.round(c, 9) for c in ("latitude_deg", "longitude_deg")})


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _png(row: dict) -> bytes:
    """An image of width k % 5 + 1 and height k % 3 + 1 whose j-th byte is (k + 7 * j) % 256, with the filters none, left and above in turn."""
    k = row["k"]
    width, height = k % 5 + 1, k % 3 + 1
    raw, above = b"", bytes(3 * width)
    for y in range(height):
        line = bytes((k + 7 * (3 * width * y + j)) % 256 for j in range(3 * width))
        guess = (bytes(3 * width), b"\0\0\0" + line[:-3], above)[y % 3]
        raw += bytes([y % 3]) + bytes((a - b) % 256 for a, b in zip(line, guess, strict=True))
        above = line
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"sRGB", b"\0") + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def io31_png_pixels(spark: SparkSession, sf: str) -> DataFrame:
    made = _built(_table(spark, sf, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("k")), _png)
    return files.read_png(made).select("path", "width", "height", F.sha2("rgb", 256).alias("rgb_sha256"))


def _ply(row: dict) -> bytes:
    k = row["k"]
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {k % 4 + 1}\nproperty float x\nproperty float y\nend_header\n"
    return head.encode() + struct.pack("<2f", k % 3, (k + 1) % 3) * (k % 4 + 1)


#: Files of a folder.
FOLDER_FILES = 10_000


def t4_ply_records(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices of a PLY file for each part, written and read again as a data source."""
    made = _built(_table(spark, sf, "part").select(F.concat(F.floor(F.col("p_partkey") / FOLDER_FILES).cast("string"), F.lit("/v"), F.col("p_partkey").cast("string"), F.lit(".ply")).alias("path"), F.col("p_partkey").alias("k")), _ply)
    folder = shared_path(spark, "ply-files")
    files.write_files(made, folder).count()
    datasource.register(spark)
    rows = spark.read.format("sightline_ply").option("properties", "x,y").load(folder)
    return rows.select(F.substring_index("path", "/", -1).alias("path"), "vertex", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def io28_staged_set(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as one data set that appears as a whole, and read again."""
    datasource.register(spark)
    path = shared_path(spark, "staged-set")
    rows = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows.write.format("sightline_set").mode("append").save(path)
    return spark.read.schema(rows.schema).parquet(path)


def io30_ply_audit(spark: SparkSession, sf: str) -> DataFrame:
    made = _built(_table(spark, sf, "part").select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("k")), _ply)
    return files.audit_ply(made, ["x", "y"])


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", F.concat(F.lit("html/p"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))


def io1_file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the shared folder, read as streams."""
    folder = shared_path(spark, "hashed")
    files.write_files(_pages(spark, sf), folder)
    return files.relative_to(files.content_hashes(spark, folder), folder)


def io28_staged_files(spark: SparkSession, sf: str) -> DataFrame:
    """A data set that is copied with its hashes checked, and read again."""
    root, folder = shared_path(spark, "originals"), shared_path(spark, "staged")
    manifest = files.write_files(_pages(spark, sf), root)
    files.stage_files(manifest, root, folder)
    return files.relative_to(files.content_hashes(spark, folder), folder)


def io26_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    def fixture(row: dict) -> bytes:
        k = row["k"]
        expected = [{"metric": f"m{j}", "comparator": ("eq", "lte", "gte")[j % 3], "target": k + j / 4, "abs_tolerance": 0.5} for j in range(k % 3 + 1)]
        return json.dumps({"schema_version": 1, "fixture_id": f"fixture.{k}", "kind": "synthetic", "lane": "fast", "deterministic": True, "input_files": [f"data/{k}.json"], "expectations": expected}).encode()

    folder = shared_path(spark, "fixtures")
    files.write_files(_built(_table(spark, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"), F.col("n_nationkey").alias("k")), fixture), folder)
    return files.expectations_of(files.load_fixtures(spark, folder)).select("fixture_id", "metric", "comparator", "target", "abs_tolerance")


def _cameras(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf, "part").select(F.concat(F.lit("c"), k.cast("string")).alias("camera_id"), F.col("p_brand").alias("manufacturer"), F.when(k % 3 != 0, F.concat(F.col("p_type"), F.lit(' "ü"'))).alias("model"), F.lit(None).cast("string").alias("serial_number"))


def io23_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return records.encode_records(_cameras(spark, sf), "camera")


def io24_json_objects(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 11 == 0, F.lit("{\"k\": ")).otherwise(F.col("props"))
    found = records.json_object(bad)
    return _table(spark, sf, "events").select("event_id", found.isNotNull().alias("is_object"), found["k"].cast("bigint").alias("k"))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    asset = F.struct(F.octet_length(content).cast("bigint").alias("byte_length"), F.lit(None).cast("string").alias("mime_type"), F.sha2(content, 256).alias("sha256"), F.concat(F.lit("store/"), F.col("doc_id").cast("string")).alias("uri"))
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 1_000_001)
    source = F.struct(F.lit(None).cast("string").alias("locator"), F.coalesce("source", F.lit("none")).alias("source_id"))
    return _table(spark, sf, "documents").select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("observation_id"), asset.alias("asset"), F.when(F.col("doc_id") % 2 == 0, at).alias("captured_at"), F.lit("image").alias("kind"), at.alias("received_at"), source.alias("source"))


def io25_record_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    written = scratch(records.encode_records(_observations(spark, sf), "observation"), "records")
    return records.encode_records(records.decode_records(written, "observation"), "observation")


def io22_typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two types in one store, one of them put twice."""
    none = spark.createDataFrame([], "record_type string, record_id string, payload string")
    stored = scratch(records.put_typed(none, _cameras(spark, sf), "camera"), "store")
    stored = scratch(records.put_typed(stored, _observations(spark, sf), "observation"), "store")
    stored = scratch(records.put_typed(stored, _cameras(spark, sf), "camera"), "store")
    return records.get_typed(stored, "camera").unionByName(records.get_typed(stored, "observation").select(F.col("observation_id").alias("camera_id"), F.lit(None).cast("string").alias("manufacturer"), F.col("source.source_id").alias("model"), F.col("asset.sha256").alias("serial_number")))


def io16_get_record(spark: SparkSession, sf: str) -> DataFrame:
    return identity.get_record(records.encode_records(_cameras(spark, sf), "camera"), "camera", "c7")


def sc3_config_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), (F.col("n_nationkey") * 2).alias("neighbors"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(True)).alias("exact"))
    return rows.select("n_nationkey", identity.config_key(rows, ["name", "neighbors", "exact"]).alias("identity"))


def sc19_native_model_ref(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "nation").select(F.col("n_regionkey").alias("model_id"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), F.octet_length("n_name").alias("byte_length"))
    return identity.model_identity(rows).select("model_id", identity.native_model_ref(F.col("identity")).alias("artifact_id"))


PARTS = 4
#: Rows of a file that a stream reads.
FILE_ROWS = 1_000_000


def _streamed(spark: SparkSession, rows: DataFrame, order: list[str], start: Callable[[DataFrame], object]) -> None:
    """Write rows in PARTS parts by rising order, as many files to each as its rows ask for, and run a stream
    over each part as it comes: a batch a part, and a restart between them."""
    folder = shared_path(spark, "stream-in")
    rows = scratch(rows, "stream-rows")
    files = max(1, -(-rows.count() // (PARTS * FILE_ROWS)))
    ranged = scratch(rows.repartitionByRange(PARTS * files, *order).withColumn("_part", F.floor(F.spark_partition_id() / files)), "stream-ranged")
    for k in range(PARTS):
        ranged.where(F.col("_part") == k).drop("_part").coalesce(files).sortWithinPartitions(*order).write.parquet(f"{folder}/{k}")
        query = start(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder))
        try:
            query.processAllAvailable()
        finally:
            query.stop()


def t1_relation_batches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("o"), F.lpad(c.cast("string"), 8, "0"))
    rows = _table(spark, sf, "customer").select(name(k).alias("id1"), name(k + 1 + k % 3).alias("id2"), F.when(k % 4 == 0, "UNRESOLVED").otherwise("SUPPORTED").alias("disposition"), F.array(F.struct(F.lit("geometry").alias("kind"), k.cast("string").alias("id"))).alias("evidence"))
    folder, checkpoint = shared_path(spark, "relation-log"), shared_path(spark, "stream")
    _streamed(spark, rows, ["id1", "id2"], lambda stream: live.stream_relations(stream, live.RelationLog(spark, folder), checkpoint))
    return live.RelationLog(spark, folder).rows.select("id1", "id2", "disposition", F.expr("evidence[0].id").alias("evidence"))


def _scene_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as observations: one is linked to one of the next three of its fifty, and contradicts one fifty on."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("o"), F.lpad(c.cast("string"), 8, "0"))
    rows = _table(spark, sf, "customer").select(k, (k + 1 + k % 3).alias("to"))
    far = rows.groupBy().agg(F.max("c_custkey").alias("most"))
    near = rows.where("floor(c_custkey / 50) = floor(to / 50)").crossJoin(F.broadcast(far)).where("to <= most")
    links = near.select(name(k).alias("id1"), name(F.col("to")).alias("id2"), F.when(k % 4 == 0, "UNRESOLVED").otherwise("SUPPORTED").alias("disposition"), F.array(F.struct(F.lit("geometry").alias("kind"), k.cast("string").alias("id"))).alias("evidence"))
    apart = rows.crossJoin(F.broadcast(far)).where("c_custkey % 7 = 0 and c_custkey + 50 <= most")
    return links.unionByName(apart.select(name(k).alias("id1"), name(k + 50).alias("id2"), F.lit("CONTRADICTED").alias("disposition"), F.array(F.struct(F.lit("geometry").alias("kind"), F.lit("apart").alias("id"))).alias("evidence")))


def _scenes(spark: SparkSession, sf: str) -> scenes.SceneLog:
    observations = _table(spark, sf, "customer").select(F.concat(F.lit("o"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("observation_id"))
    folder = shared_path(spark, "scene-log")
    _streamed(spark, _scene_relations(spark, sf), ["id1", "id2"], lambda stream: scenes.stream_scenes(stream, scenes.SceneLog(spark, folder, observations), f"{folder}/stream"))
    return scenes.SceneLog(spark, folder)


def t1_scene_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _scenes(spark, sf).labels


def t1_scene_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = _scenes(spark, sf).clusters
    return found.select("cluster_id", F.array_join("members", ",").alias("members"), F.array_join(F.transform("evidence", lambda e: e["id"]), ",").alias("evidence"))


def t2_record_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' customers as records: most come in several batches."""
    rows = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), F.lit("customer").alias("record_type"), F.col("o_custkey").cast("string").alias("record_id"), F.concat(F.lit('{"id":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("payload"))
    folder, checkpoint = shared_path(spark, "record-table"), shared_path(spark, "stream")
    _streamed(spark, rows, ["n"], lambda stream: live.stream_records(stream.drop("n"), live.RecordTable(spark, folder), checkpoint))
    return live.RecordTable(spark, folder).rows


def t3_interval_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in parts by their index, with a buffer of a day; the last part ends every video."""
    rows = bound(spark, sf, "frames").select("frame_time_us", "video_id", "frame_index")
    ends = rows.select("video_id").distinct().select(F.lit(None).cast("bigint").alias("frame_time_us"), "video_id", F.lit(None).cast("bigint").alias("frame_index"))
    rows = rows.unionByName(ends).withColumn("n", F.coalesce("frame_index", F.lit((1 << 62))))
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream")
    _streamed(spark, rows, ["n", "video_id"], lambda stream: live.stream_interval(stream, 2 * 86_400_000_000, delay_us=86_400_000_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start())
    return spark.read.schema("video_id string, frame_index bigint, frame_time_us bigint").parquet(out)


QUERIES = {
    "io6_exif_entries": io6_exif_entries, "io7_exif_ingest": io7_exif_ingest, "io31_png_pixels": io31_png_pixels, "io30_ply_audit": io30_ply_audit, "t4_ply_records": t4_ply_records, "io28_staged_set": io28_staged_set, "io1_file_hashes": io1_file_hashes, "io28_staged_files": io28_staged_files,
    "io26_fixtures": io26_fixtures, "io23_canonical_json": io23_canonical_json, "io24_json_objects": io24_json_objects, "io25_record_round_trip": io25_record_round_trip, "io22_typed_records": io22_typed_records, "io16_get_record": io16_get_record,
    "sc3_config_identity": sc3_config_identity, "sc19_native_model_ref": sc19_native_model_ref, "t1_relation_batches": t1_relation_batches, "t1_scene_labels": t1_scene_labels, "t1_scene_clusters": t1_scene_clusters, "t2_record_batches": t2_record_batches, "t3_interval_stream": t3_interval_stream,
}

PHOTOS = """WITH p AS (SELECT p_partkey AS k, 'p' || lpad(p_partkey::VARCHAR, 8, '0') AS path FROM part)"""
PAGES = "WITH p AS (SELECT 'html/p' || lpad(page_id::VARCHAR, 8, '0') AS path, coalesce(html, '') AS c FROM pages) SELECT path, sha256(c) AS sha256, octet_length(encode(c))::BIGINT AS byte_length FROM p"
CAMERAS = """WITH c AS (SELECT 'c' || p_partkey AS camera_id, p_brand AS manufacturer, CASE WHEN p_partkey % 3 <> 0 THEN p_type || ' "ü"' END AS model FROM part),
j AS (SELECT 'camera' AS record_type, camera_id AS record_id, '{"camera_id":"' || camera_id || '","manufacturer":"' || manufacturer || '","model":' || coalesce('"' || replace(model, '"', '\\"') || '"', 'null') || ',"serial_number":null}' AS payload FROM c)"""

SCENES = """WITH RECURSIVE c AS (SELECT c_custkey AS k, 'o' || lpad(c_custkey::VARCHAR, 8, '0') AS a FROM customer),
links AS (SELECT x.a AS id1, y.a AS id2, x.k FROM c x JOIN c y ON y.k = x.k + 1 + x.k % 3 AND x.k // 50 = y.k // 50 WHERE x.k % 4 <> 0),
ways AS (SELECT id1 AS a, id2 AS b FROM links UNION ALL SELECT id2, id1 FROM links),
reach AS (SELECT a, a AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"""

ORACLES = {
    "io6_exif_entries": f"""{PHOTOS}, e AS (
  SELECT k, path, unnest([
    struct_pack(key := 'Image Model', value := 'Model ' || (k % 7)), struct_pack(key := 'EXIF ISOSpeedRatings', value := (k % 400 + 100)::VARCHAR), struct_pack(key := 'EXIF DateTimeOriginal', value := '2024:01:05 10:20:30'),
    struct_pack(key := CASE WHEN k % 7 <> 0 THEN 'EXIF OffsetTimeOriginal' END, value := CASE WHEN k % 2 = 1 THEN '+02:00' ELSE '-05:30' END),
    struct_pack(key := 'GPS GPSLatitudeRef', value := CASE WHEN k % 2 = 1 THEN 'S' ELSE 'N' END), struct_pack(key := 'GPS GPSLatitude', value := '[' || (k % 90) || ', ' || (k % 60) || ', ' || (k % 119) || '/2]'), struct_pack(key := 'GPS GPSMapDatum', value := 'WGS-84'),
    struct_pack(key := CASE WHEN k % 5 <> 0 THEN 'GPS GPSLongitudeRef' END, value := CASE WHEN k % 3 <> 0 THEN 'E' ELSE 'W' END), struct_pack(key := CASE WHEN k % 5 <> 0 THEN 'GPS GPSLongitude' END, value := '[' || (k % 180) || ', ' || (k % 60) || ', ' || (k % 60) || ']')]) AS e FROM p)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY e.key) - 1)::INT AS position, 'EXIF' AS namespace, e.key AS key, e.value AS value FROM e WHERE e.key IS NOT NULL""",
    "io7_exif_ingest": f"""{PHOTOS}
SELECT path AS observation_id, CASE WHEN k % 5 = 0 THEN 'INCOMPLETE' ELSE 'RESOLVED' END AS gps_status, CASE WHEN k % 5 <> 0 THEN round((k % 90 + (k % 60) / 60::DOUBLE + (k % 119) / 7200::DOUBLE) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END, 9) END AS latitude_deg,
       CASE WHEN k % 5 <> 0 THEN round((k % 180 + (k % 60) / 60::DOUBLE + (k % 60) / 3600::DOUBLE) * CASE WHEN k % 3 <> 0 THEN 1 ELSE -1 END, 9) END AS longitude_deg, 'WGS-84' AS map_datum,
       CASE WHEN k % 7 = 0 THEN 'LOCAL_AMBIGUOUS' ELSE 'RESOLVED' END AS time_status, CASE WHEN k % 7 <> 0 THEN epoch_us(TIMESTAMP '2024-01-05 10:20:30') - CASE WHEN k % 2 = 1 THEN 7200000000 ELSE -19800000000 END END AS instant_us FROM p""",
    "io31_png_pixels": """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 + 1 AS w, p_partkey % 3 + 1 AS h FROM part)
SELECT 'i' || k AS path, w::INT AS width, h::INT AS height, sha256(unhex(array_to_string(list_transform(range(w * h * 3), lambda j: format('{:02x}', (k + 7 * j) % 256)), ''))) AS rgb_sha256 FROM p""",
    "t4_ply_records": """WITH p AS (SELECT p_partkey AS k, unnest(range(p_partkey % 4 + 1)) AS i FROM part) SELECT 'v' || k || '.ply' AS path, i AS vertex, (k % 3)::DOUBLE AS x, ((k + 1) % 3)::DOUBLE AS y FROM p""",
    "io28_staged_set": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "io30_ply_audit": """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 + 1 AS n, ['00000000', '0000803F', '00000040'] AS f FROM part)
SELECT 'v' || k AS path, n::BIGINT AS vertices, sha256(encode('ply' || chr(10) || 'format binary_little_endian 1.0' || chr(10) || 'element vertex ' || n || chr(10) || 'property float x' || chr(10) || 'property float y' || chr(10) || 'end_header' || chr(10)) || unhex(repeat(f[k % 3 + 1] || f[(k + 1) % 3 + 1], n::INT))) AS sha256 FROM p""",
    "io1_file_hashes": PAGES,
    "io28_staged_files": PAGES,
    "io26_fixtures": """SELECT 'fixture.' || k AS fixture_id, 'm' || j AS metric, ['eq', 'lte', 'gte'][j % 3 + 1] AS comparator, (k + j / 4::DOUBLE)::DOUBLE AS target, 0.5::DOUBLE AS abs_tolerance FROM (SELECT n_nationkey AS k, unnest(range(n_nationkey % 3 + 1)) AS j FROM nation)""",
    "io23_canonical_json": f"{CAMERAS} SELECT * FROM j",
    "io16_get_record": f"{CAMERAS} SELECT * FROM j WHERE record_id = 'c7'",
    "io24_json_objects": """SELECT event_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AS is_object, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events""",
    "io25_record_round_trip": """WITH d AS (SELECT doc_id, coalesce(text, '') AS c, coalesce(source, 'none') AS s, strftime(make_timestamp(1704067200000000 + doc_id * 1000001), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS t FROM documents)
SELECT 'observation' AS record_type, 'o' || doc_id AS record_id, '{"asset":{"byte_length":' || octet_length(encode(c)) || ',"mime_type":null,"sha256":"' || sha256(c) || '","uri":"store/' || doc_id || '"},"captured_at":' || CASE WHEN doc_id % 2 = 0 THEN '"' || t || '"' ELSE 'null' END
       || ',"kind":"image","observation_id":"o' || doc_id || '","received_at":"' || t || '","source":{"locator":null,"source_id":"' || s || '"}}' AS payload FROM d""",
    "io22_typed_records": f"{CAMERAS} SELECT camera_id, manufacturer, model, NULL::VARCHAR AS serial_number FROM c UNION ALL SELECT 'o' || doc_id, NULL, coalesce(source, 'none'), sha256(coalesce(text, '')) FROM documents",
    "sc3_config_identity": """SELECT n_nationkey, sha256('{"exact":' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'null' END || ',"name":"' || n_name || '","neighbors":' || (n_nationkey * 2) || '}') AS identity FROM nation""",
    "sc19_native_model_ref": """SELECT n_regionkey AS model_id, 'artifact:native-model:' || sha256('[' || string_agg('{"byte_length":' || octet_length(encode(n_name)) || ',"path":"' || n_name || '","sha256":"' || sha256(n_name) || '"}', ',' ORDER BY n_nationkey) || ']') AS artifact_id FROM nation GROUP BY 1""",
    "t1_relation_batches": "SELECT 'o' || lpad(c_custkey::VARCHAR, 8, '0') AS id1, 'o' || lpad((c_custkey + 1 + c_custkey % 3)::VARCHAR, 8, '0') AS id2, CASE WHEN c_custkey % 4 = 0 THEN 'UNRESOLVED' ELSE 'SUPPORTED' END AS disposition, c_custkey::VARCHAR AS evidence FROM customer",
    "t1_scene_labels": f"{SCENES} SELECT a AS observation_id, root FROM roots",
    "t1_scene_clusters": f"""{SCENES}, m AS (SELECT root, list(a ORDER BY a) AS members FROM roots GROUP BY 1),
e AS (SELECT root, string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR) AS evidence FROM links JOIN roots ON roots.a = id1 GROUP BY 1)
SELECT 'scene:' || sha256(array_to_string(members, chr(10))) AS cluster_id, array_to_string(members, ',') AS members, coalesce(evidence, '') AS evidence FROM m LEFT JOIN e USING (root)""",
    "t2_record_batches": """SELECT DISTINCT 'customer' AS record_type, o_custkey::VARCHAR AS record_id, '{"id":' || o_custkey || '}' AS payload FROM orders""",
    "t3_interval_stream": "",
}


def _interval_sql() -> str:
    from .pair_queries import DAY_US, kept_sql

    return f"{duck('frames')}, {kept_sql(2 * DAY_US)} SELECT * FROM chosen"


ORACLES["t3_interval_stream"] = _interval_sql()
