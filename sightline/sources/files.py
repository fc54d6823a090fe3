"""Files as tables: content hashes, EXIF, PNG and PLY payloads, JSON fixtures."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.checks import assert_empty
from ..operators.identity import safe_path, safe_path_text
from ..scratch import scratch
from ..shipping import ship_package
from ..storage import filesystem_of

#: Tags of the TIFF structure that EXIF uses.
TAGS = {0x010F: "Image Make", 0x0110: "Image Model", 0x0112: "Image Orientation", 0x0132: "Image DateTime", 0x829A: "EXIF ExposureTime", 0x829D: "EXIF FNumber", 0x8827: "EXIF ISOSpeedRatings", 0x9003: "EXIF DateTimeOriginal", 0x9011: "EXIF OffsetTimeOriginal", 0x920A: "EXIF FocalLength", 0xA002: "EXIF ExifImageWidth", 0xA003: "EXIF ExifImageLength"}
GPS_TAGS = {1: "GPS GPSLatitudeRef", 2: "GPS GPSLatitude", 3: "GPS GPSLongitudeRef", 4: "GPS GPSLongitude", 18: "GPS GPSMapDatum"}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FIXTURE_SCHEMA = "schema_version int, fixture_id string, kind string, lane string, deterministic boolean, seed bigint, input_files array<string>, expectations array<struct<metric:string, comparator:string, target:double, abs_tolerance:double, unit:string>>, provenance map<string,string>"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_length of the files under path; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = scratch(files.select("path", F.col("length").alias("byte_length")), "listed-files")
    listed = files._jdf.inputFiles()
    if len(listed) == found.count():
        return found
    # a scan leaves out files of length 0
    seen = found.select("path").toLocalIterator()
    empty = {unquote(x).replace(":///", ":/") for x in listed}.difference(r.path.replace(":///", ":/") for r in seen)
    return found.unionByName(spark.createDataFrame([(x, 0) for x in sorted(empty)], found.schema))


def content_hashes(spark: SparkSession, path: str, *, block: int = 1 << 20) -> DataFrame:
    """path, sha256, byte_length of the files under path.

    Files are read as streams of blocks, so one of any size takes no more
    memory than a block. A file that changes its length meanwhile is an error.
    In a store that only Spark reads, files are read whole, up to 2 GB each.
    """
    ship_package(spark)
    try:
        filesystem_of(path)
    except (ValueError, NotImplementedError, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = filesystem_of(file)
                digest, read = hashlib.sha256(), 0
                with store.open_input_stream(place, compression=None) as stream:
                    while part := stream.read(block):
                        digest.update(part)
                        read += len(part)
                if read != length:
                    raise InvalidFile(f"{file} has {read} bytes, not {length}")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()]), pa.array([read], pa.int64())], names=["path", "sha256", "byte_length"])

    return list_files(spark, path).mapInArrow(run, "path string, sha256 string, byte_length bigint")


FILE = StructType([StructField("path", StringType()), StructField("sha256", StringType()), StructField("byte_length", LongType())])


def _place(store: pyarrow.fs.FileSystem, place: str, write: Callable[[pyarrow.fs.FileSystem, str], tuple[str, int]]) -> tuple[str, int]:
    """Write a file under another name and move it to its place, so that there is the whole file or none."""
    store.create_dir(place.rpartition("/")[0], recursive=True)
    half = f"{place}.{uuid.uuid4().hex}.part"
    try:
        found = write(store, half)
        store.move(half, place)
    except BaseException:
        if store.get_file_info(half).type == pyarrow.fs.FileType.File:
            store.delete_file(half)
        raise
    return found


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """path, sha256, byte_length of files (path, content) that are written under folder. Paths must be plain relative ones."""
    ship_package(files.sparkSession)
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple[str, str, int]] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                if not safe_path_text(path):
                    raise InvalidFile(f"{path!r} is no plain path")

                def write(store: pyarrow.fs.FileSystem, place: str, data: bytes = data) -> tuple[str, int]:
                    with store.open_output_stream(place, compression=None) as out:
                        out.write(data)
                    return hashlib.sha256(data).hexdigest(), len(data)

                done.append((path, *_place(*filesystem_of(f"{folder}/{path}"), write)))
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], kind) for j, kind in enumerate(kinds)], names=FILE.names)

    return scratch(files.select("path", "content").mapInArrow(run, FILE), "written-files")


def stage_files(manifest: DataFrame, root: str, folder: str, *, block: int = 1 << 20) -> DataFrame:
    """path, sha256, byte_length of the manifest's files, copied from under root to under folder.

    manifest has path, sha256, byte_length. Files go through in blocks; one whose
    length or hash is not the recorded one is an error and is not put in its place.
    """
    ship_package(manifest.sparkSession)
    root, folder = root.rstrip("/"), folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sha256, length in zip(*(batch.column(c).to_pylist() for c in FILE.names), strict=True):
                if not safe_path_text(path):
                    raise InvalidFile(f"{path!r} is no plain path")

                def write(store: pyarrow.fs.FileSystem, place: str, path: str = path, sha256: str = sha256, length: int = length) -> tuple[str, int]:
                    source, at = filesystem_of(f"{root}/{path}")
                    digest, read = hashlib.sha256(), 0
                    with source.open_input_stream(at, compression=None) as data, store.open_output_stream(place, compression=None) as out:
                        while part := data.read(block):
                            digest.update(part)
                            read += len(part)
                            out.write(part)
                    if read != length or digest.hexdigest() != sha256.lower():
                        raise InvalidFile(f"{path} is not what the manifest says")
                    return digest.hexdigest(), read

                digest, read = _place(*filesystem_of(f"{folder}/{path}"), write)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest]), pa.array([read], pa.int64())], names=FILE.names)

    return scratch(manifest.select(*FILE.names).mapInArrow(run, FILE), "staged-files")


def relative_to(files: DataFrame, folder: str) -> DataFrame:
    """files with path as it is under folder."""
    mark = "/" + folder.rstrip("/").rpartition("/")[2] + "/"
    return files.withColumn("path", F.substring_index("path", mark, -1))


def _mapped(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """files (path, content) through rows(path, content), which yields tuples of the schema."""
    ship_package(files.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(rows(path, content))
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def exif_entries(data: bytes) -> list[tuple[str, str]]:
    """Sorted (key, value) texts of the EXIF block of a JPEG or TIFF file; files without one have none."""
    start = 0
    if data[:2] == b"\xff\xd8":
        at = 2
        start = -1
        while at + 4 <= len(data) and data[at] == 0xFF:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
                start = at + 10
                break
            at += 2 + size
    if start < 0 or data[start : start + 2] not in (b"II", b"MM"):
        return []
    tiff, order = data[start:], "<" if data[start : start + 2] == b"II" else ">"
    out: list[tuple[str, str]] = []

    def directory(at: int, names: dict[int, str]) -> None:
        if not 0 < at <= len(tiff) - 2:
            return
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            field = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(field) < 12:
                return
            tag, kind, n = struct.unpack(order + "HHI", field[:8])
            size = SIZES.get(kind, 0) * n
            offset = struct.unpack(order + "I", field[8:])[0]
            raw = field[8 : 8 + size] if size <= 4 else tiff[offset : offset + size]
            if tag in (EXIF_IFD, GPS_IFD):
                directory(offset, GPS_TAGS if tag == GPS_IFD else TAGS)
            elif tag in names and size and len(raw) == size:
                out.append((names[tag], _exif_text(order, kind, raw)))

    directory(struct.unpack_from(order + "I", tiff, 4)[0], TAGS)
    return sorted(out)


def _exif_text(order: str, kind: int, raw: bytes) -> str:
    if kind in (2, 7):
        return raw.rstrip(b"\x00").decode("latin-1").strip()
    if kind in (5, 10):
        numbers = struct.unpack(f"{order}{len(raw) // 4}{'I' if kind == 5 else 'i'}", raw)
        values = [str(a) if b == 1 else f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2], strict=True)]
    else:
        values = [str(v) for v in struct.unpack(f"{order}{len(raw) // SIZES[kind]}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", raw)]
    return values[0] if len(values) == 1 else "[" + ", ".join(values) + "]"


def read_exif(files: DataFrame) -> DataFrame:
    """path, position, namespace, key, value of the EXIF entries of files (path, content)."""
    return _mapped(files, "path string, position int, namespace string, key string, value string", lambda path, data: ((path, i, "EXIF", k, v) for i, (k, v) in enumerate(exif_entries(data))))


class InvalidFile(ValueError):
    """A file breaks its format."""


def png_pixels(data: bytes) -> np.ndarray:
    """The RGB pixels of an 8-bit sRGB PNG, as height x width x 3; every check sum and filter is followed."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise InvalidFile("not a PNG")
    at, parts, head, srgb, ended = 8, [], None, False, False
    while at < len(data) and not ended:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise InvalidFile(f"chunk {name!r} is damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            parts.append(body)
        srgb, ended, at = srgb or name == b"sRGB", name == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0) or not srgb:
        raise InvalidFile("not an 8-bit RGB image in sRGB")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (1 + 3 * width):
        raise InvalidFile("the pixels have another size")
    lines = raw.reshape(height, 1 + 3 * width)
    out = np.zeros((height, 3 * width), np.int32)
    above = np.zeros(3 * width, np.int32)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = (line.reshape(-1, 3).cumsum(axis=0) & 255).reshape(-1)
        elif kind in (3, 4):
            for i in range(3 * width):
                left = line[i - 3] if i >= 3 else 0
                if kind == 3:
                    line[i] = (line[i] + (left + above[i]) // 2) & 255
                else:
                    corner = above[i - 3] if i >= 3 else 0
                    guess = left + above[i] - corner
                    near = min((left, above[i], corner), key=lambda v: abs(guess - v))
                    line[i] = (line[i] + near) & 255
        elif kind:
            raise InvalidFile("an unknown filter")
        out[y] = above = line
    return out.reshape(height, width, 3).astype(np.uint8)


def read_png(files: DataFrame) -> DataFrame:
    """path, width, height, rgb (packed) of PNG files (path, content)."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        pixels = png_pixels(data)
        yield path, pixels.shape[1], pixels.shape[0], pixels.tobytes()

    return _mapped(files, "path string, width int, height int, rgb binary", rows)


def ply_records(data: bytes, properties: list[str]) -> np.ndarray:
    """The vertices of a binary little-endian PLY file of float properties, in exactly this order, all finite."""
    end = data.find(b"end_header\n")
    lines = data[: max(end, 0)].decode("ascii", "replace").split("\n")[:-1]
    counts = [x for x in lines if x.startswith("element ")]
    want = ["ply", "format binary_little_endian 1.0", *counts, *(f"property float {p}" for p in properties)]
    if end < 0 or len(counts) != 1 or [x for x in lines if not x.startswith("comment")] != want or not counts[0].startswith("element vertex "):
        raise InvalidFile("the header is not the expected one")
    n, body = int(counts[0].split()[2]), data[end + 11 :]
    if len(body) != 4 * n * len(properties):
        raise InvalidFile("the payload has another size")
    records = np.frombuffer(body, "<f4").reshape(n, len(properties))
    if not np.isfinite(records).all():
        raise InvalidFile("a value is not finite")
    return records


def audit_ply(files: DataFrame, properties: list[str]) -> DataFrame:
    """path, vertices, sha256 of PLY files (path, content) that pass ply_records."""
    return _mapped(files, "path string, vertices bigint, sha256 string", lambda path, data: iter([(path, len(ply_records(data, properties)), hashlib.sha256(data).hexdigest())]))


def git_blob_sha1(content: Column) -> Column:
    """The SHA-1 that version control gives to a file's content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string"), F.lit("\x00")), "utf-8"), content))


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """The fixtures in JSON files under path, one to a file. Versions other than 1 and unsafe paths are errors."""
    rows = spark.read.schema(FIXTURE_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    unsafe = F.exists("input_files", lambda p: ~safe_path(p))
    assert_empty(rows.where((F.col("schema_version") != 1) | unsafe | (F.size("input_files") < 1) | (F.size(F.array_distinct(F.transform("expectations", lambda e: e["metric"]))) != F.size("expectations"))).select("fixture_id"), "a fixture is malformed")
    return rows


def expectations_of(fixtures: DataFrame) -> DataFrame:
    return fixtures.select("fixture_id", F.inline("expectations"))
