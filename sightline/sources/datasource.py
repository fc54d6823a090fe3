"""Spark data sources of this package: records of PLY files by byte range, and data sets that appear as a whole.

register(spark) makes them known; then spark.read.format("sightline_ply") and df.write.format("sightline_set").
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship_package
from ..storage import filesystem_of
from .files import InvalidFile

#: A header ends within so many bytes.
HEADER_BYTES = 1 << 16
#: A small file counts as so many bytes at least, as opening it takes its time.
OPEN_BYTES = 1 << 16
#: Vertices of a batch.
BATCH_ROWS = 65_536


def register(spark: SparkSession) -> None:
    """Make the formats known to the session and send the package to the workers."""
    ship_package(spark)
    spark.dataSource.register(PlySource)
    spark.dataSource.register(SetSource)


def ply_header(data: bytes, properties: list[str]) -> tuple[int, int]:
    """Vertices and header bytes of a binary little-endian PLY file of these float properties; anything else is an error."""
    end = data.find(b"end_header\n")
    lines = data[: max(end, 0)].decode("ascii", "replace").split("\n")[:-1]
    counts = [x for x in lines if x.startswith("element ")]
    want = ["ply", "format binary_little_endian 1.0", *counts, *(f"property float {p}" for p in properties)]
    if end < 0 or len(counts) != 1 or [x for x in lines if not x.startswith("comment")] != want or not counts[0].startswith("element vertex "):
        raise InvalidFile("the header is not the expected one")
    return int(counts[0].split()[2]), end + 11


class Range(NamedTuple):
    """Vertices first to last - 1 of a file; last -1: all."""

    path: str
    first: int
    last: int


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.held = ranges

    @property
    def ranges(self) -> list[Range]:
        return self.held


class WholeFiles(InputPartition):
    """Files that one task reads, as one text for each folder: a plan of millions of files stays small."""

    def __init__(self, files: list[tuple[str, str]]):
        folders: dict[str, list[str]] = {}
        for folder, name in files:
            folders.setdefault(folder, []).append(name)
        self.folders = {folder: "\0".join(names) for folder, names in folders.items()}

    @property
    def ranges(self) -> list[Range]:
        return [Range(f"{folder}/{name}", 0, -1) for folder, names in self.folders.items() for name in names.split("\0")]


class PlySource(DataSource):
    """path, vertex and the float properties of binary PLY files, a row for each vertex.

    Options: path (a file, or a folder with .ply files at any depth), properties
    (names with commas between), block_bytes (128 MB). Records have one length, so a
    file of more than block_bytes is read in ranges of about that many bytes by several tasks, and
    small files share a task. A header other than the expected one, a payload of another
    size and a value that is not finite are errors.
    """

    @classmethod
    def name(cls) -> str:
        return "sightline_ply"

    def _properties(self) -> list[str]:
        found = [p.strip() for p in self.options.get("properties", "").split(",") if p.strip()]
        if not found or len(set(found)) != len(found) or {"path", "vertex"} & set(found):
            raise ValueError("properties must name the floats of a vertex")
        return found

    def schema(self) -> str:
        return "path string, vertex bigint, " + ", ".join(f"`{p}` float" for p in self._properties())

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], self._properties(), int(self.options.get("block_bytes", 1 << 27)))


class PlyReader(DataSourceReader):
    def __init__(self, path: str, properties: list[str], block: int):
        self.path, self.properties, self.block = path, properties, block
        self.size = 4 * len(properties)

    def partitions(self) -> list[InputPartition]:
        store, root = filesystem_of(self.path)
        info = store.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out: list[InputPartition] = []
        together: list[tuple[str, str]] = []
        held = 0
        for folder, name, size in [(*info.path.rsplit("/", 1), info.size)] if info.is_file else _ply_files(store, info.path):
            if size <= self.block:
                cost = max(size, min(OPEN_BYTES, self.block))
                if together and held + cost > self.block:
                    out.append(WholeFiles(together))
                    together, held = [], 0
                together.append((folder, name))
                held += cost
                continue
            path = f"{folder}/{name}"
            with store.open_input_file(path) as data:
                n, _ = ply_header(data.read(HEADER_BYTES), self.properties)
            step = max(1, self.block // self.size)
            out += [Ranges([Range(path, k, min(k + step, n))]) for k in range(0, n, step)] or [Ranges([Range(path, 0, -1)])]
        return [*out, WholeFiles(together)] if together else out or [Ranges([])]

    def read(self, partition: Ranges | WholeFiles) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem_of(self.path)
        some: list[tuple[str, int, np.ndarray]] = []
        held = 0
        for path, first, records in self._records(store, partition.ranges):
            some.append((path, first, records))
            held += len(records)
            if held >= BATCH_ROWS:
                yield self._batch(some)
                some, held = [], 0
        if some:
            yield self._batch(some)

    def _records(self, store: pyarrow.fs.FileSystem, ranges: list[Range]) -> Iterator[tuple[str, int, np.ndarray]]:
        """path, first vertex and values of at most BATCH_ROWS vertices."""
        for path, first, last in ranges:
            with store.open_input_file(path) as data:
                head = data.read(HEADER_BYTES)
                n, start = ply_header(head, self.properties)
                if data.size() != start + n * self.size:
                    raise InvalidFile(f"{path}: the payload has another size")
                last = n if last < 0 else last
                for k in range(first, last, BATCH_ROWS):
                    at, end = start + k * self.size, start + min(last, k + BATCH_ROWS) * self.size
                    if end > len(head):
                        data.seek(at)
                    records = np.frombuffer(head[at:end] if end <= len(head) else data.read(end - at), "<f4").reshape(-1, len(self.properties))
                    if not np.isfinite(records).all():
                        raise InvalidFile(f"{path}: a value is not finite")
                    yield path, k, records

    def _batch(self, some: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(r) for _, _, r in some]
        paths = pa.array([p for p, _, _ in some]).take(pa.array(np.repeat(np.arange(len(some)), sizes)))
        records = np.concatenate([r for _, _, r in some])
        columns = [paths, pa.array(np.concatenate([np.arange(k, k + n) for (_, k, _), n in zip(some, sizes, strict=True)])), *(pa.array(np.ascontiguousarray(records[:, j])) for j in range(len(self.properties)))]
        return pa.RecordBatch.from_arrays(columns, names=["path", "vertex", *self.properties])


def _ply_files(store: pyarrow.fs.FileSystem, root: str) -> Iterator[tuple[str, str, int]]:
    """folder, name, size of the .ply files at any depth, one folder after the other."""
    folders = [root.rstrip("/")]
    while folders:
        at = folders.pop()
        inside = sorted(store.get_file_info(pyarrow.fs.FileSelector(at or "/")), key=lambda f: f.path)
        folders += [f.path.rstrip("/") for f in reversed(inside) if f.type == pyarrow.fs.FileType.Directory]
        yield from ((at, f.base_name, f.size) for f in inside if f.is_file and f.path.endswith(".ply"))


class SetSource(DataSource):
    """A data set of Parquet files that is there as a whole or not at all.

    Option: path, the folder. Tasks write into a folder beside it; once all
    have ended, what failed attempts left is taken out, a list of the files is written
    and the folder is renamed to path. If the write is given up, nothing is
    left. A path that exists is an error; in mode overwrite it is replaced
    after the new set is complete. Read it as Parquet. Renaming is one step on file
    systems that have it; stores that copy instead show files one by one.
    """

    @classmethod
    def name(cls) -> str:
        return "sightline_set"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SetWriter(self.options["path"].rstrip("/"), overwrite)


class Written(WriterCommitMessage):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class SetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.mark = path, overwrite, uuid.uuid4().hex
        store, place = filesystem_of(path)
        if not overwrite and store.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(path)
        # made here and by no task: one that still runs when the write is given up finds no folder to write to
        store.create_dir(self._places()[2], recursive=True)

    def _places(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        store, place = filesystem_of(self.path)
        folder, _, name = place.rpartition("/")
        return store, place, f"{folder}/_{name}.{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _, staged = self._places()
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{staged}/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written("", 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, place, staged = self._places()
        files = {m.file: m.rows for m in messages if m is not None and m.file}
        for file in store.get_file_info(pyarrow.fs.FileSelector(staged)):
            if file.base_name not in files:
                store.delete_file(file.path)
        with store.open_output_stream(f"{staged}/_files.json") as out:
            out.write(json.dumps(files, sort_keys=True).encode())
        old = f"{staged}.old"
        there = store.get_file_info(place).type != pyarrow.fs.FileType.NotFound
        if there and not self.overwrite:
            store.delete_dir(staged)
            raise FileExistsError(self.path)
        if there:
            store.move(place, old)
        store.move(staged, place)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staged = self._places()
        if store.get_file_info(staged).type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(staged)
