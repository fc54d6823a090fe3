"""Tables that grow by batches and are asked by key: segments of bucket files, an index of them, and marks."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..scratch import met, scratch

#: Rows of a bucket file; a segment of fewer rows is one file and read whole.
FILE_ROWS = 100_000
#: Filter bits for each row, and of one bitmap (as Spark's bitmap functions make them).
ROW_BITS, MAP_BITS = 10, 1 << 15
#: A segment takes in the one after it unless it has so many times its rows.
GROWTH = 4


class Segment(NamedTuple):
    """A written part of a table: its folder's name, its rows, bucket files, and bitmaps for each file."""

    name: str
    rows: int
    buckets: int
    maps: int


class Marks:
    """What counts of a table, said after each numbered batch in one small file.

    A batch that has no mark does not count: if a run stops half way, it comes
    again and is written anew. Only the latest marks are kept, so their number
    does not grow.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/marks"

    def _store(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        root, store = self._store()
        if not store.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getPath().getName()) for x in store.listStatus(root) if store.exists(path(x.getPath(), "_SUCCESS")))

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{number:012d}", wholetext=True).first()[0])

    def last(self) -> tuple[int, dict]:
        """Number and content of the last mark; -1 and {} before the first batch."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def write(self, number: int, content: dict) -> None:
        self.spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{number:012d}")
        _, store = self._store()
        for old in self.numbers()[: -self.KEPT]:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old:012d}"), True)


class KeyedLog:
    """Segments of rows, each dealt out by a hash of the key to sorted bucket files.

    A new batch is a segment of its own; neighbours are merged until each has
    GROWTH times the rows of the next, so a row is written again a logarithmic
    number of times and there are a logarithmic number of segments. Of every
    file are kept the range of its keys and a one-hash filter of them, so a
    look-up reads only files that may hold what is asked for; the filter never
    loses a key. Which segments count is the caller's to remember, in a mark,
    so several logs can change together.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] = DataFrame.unionByName):
        self.spark, self.folder, self.key, self.merge = spark, folder.rstrip("/"), key, merge
        self.schema = StructType.fromDDL(schema)
        self.keys = StructType([self.schema[c] for c in key])
        #: Of the last look-up: files read, files there are.
        self.read_files = self.all_files = 0

    def _path(self, segment: Segment, part: str) -> str:
        return f"{self.folder}/{segment.name}/{part}"

    def _bucket(self, buckets: Column) -> Column:
        return F.pmod(F.xxhash64(*self.key), buckets).cast("int")

    def _bit(self, maps: Column) -> Column:
        return F.pmod(F.xxhash64(*self.key, F.lit(7)), maps * MAP_BITS)

    def _write(self, rows: DataFrame, n: int) -> Segment:
        buckets = max(1, math.ceil(n / FILE_ROWS))
        made = Segment(uuid.uuid4().hex, n, buckets, max(1, math.ceil(ROW_BITS * n / buckets / MAP_BITS)))
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self._bucket(F.lit(buckets)))
        dealt.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket").parquet(self._path(made, "rows"))
        if buckets > 1:
            held = self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", LongType())])).parquet(self._path(made, "rows")).withColumn("_file", F.col("_metadata.file_path"))
            span = F.struct(*self.key)
            held.groupBy("_file", "_bucket").agg(F.count("*").alias("_n"), F.min(span).alias("_low"), F.max(span).alias("_high")).coalesce(1).write.parquet(self._path(made, "index"))
            bit = self._bit(F.lit(made.maps))
            held.select("_file", bit.alias("_bit")).groupBy("_file", F.floor(F.col("_bit") / MAP_BITS).alias("_map")).agg(F.bitmap_construct_agg(F.col("_bit") % MAP_BITS).alias("_bits")).write.parquet(self._path(made, "maps"))
        return made

    def segment(self, segment: Segment) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(segment, "rows/*"))

    def rows(self, live: list[Segment]) -> DataFrame:
        """All rows of the segments. With a merge of one's own, that of all segments."""
        if not live:
            return self.spark.createDataFrame([], self.schema)
        out = self.segment(live[0])
        for more in live[1:]:
            out = self.merge(out, self.segment(more))
        return out

    def add(self, live: list[Segment], rows: DataFrame, n: int) -> list[Segment]:
        """The segments that count once the n rows are there too. No segment is changed or deleted.

        The rows are read more than once: give it a written table."""
        if not n:
            return live
        live = list(live)
        while live and live[-1].rows < GROWTH * n:
            taken = live.pop()
            rows, n = self.merge(self.segment(taken), rows), taken.rows + n
        return [*live, self._write(rows, n)]

    def _files(self, segments: list[Segment], keys: DataFrame) -> list[str]:
        """Files of indexed segments that may hold one of the keys."""
        span = StructType([StructField("_low", self.keys), StructField("_high", self.keys)])
        index_schema = StructType([StructField("_file", StringType()), StructField("_bucket", LongType()), StructField("_n", LongType()), *span.fields])
        found: DataFrame | None = None
        for s in segments:
            index = self.spark.read.schema(index_schema).parquet(self._path(s, "index"))
            maps = self.spark.read.parquet(self._path(s, "maps"))
            asked = keys.withColumn("_bucket", self._bucket(F.lit(s.buckets)).cast("long")).withColumn("_bit", self._bit(F.lit(s.maps)))
            near = asked.join(met(index), "_bucket").where(F.struct(*self.key).between(F.col("_low"), F.col("_high")))
            near = near.select("_file", F.floor(F.col("_bit") / MAP_BITS).alias("_map"), (F.col("_bit") % MAP_BITS).alias("_at")).distinct()
            byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
            hit = near.join(maps.hint("merge"), ["_file", "_map"]).where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) > 0).select("_file").distinct()
            found = hit if found is None else found.unionByName(hit)
        return [] if found is None else sorted(r[0] for r in found.collect())

    def find(self, live: list[Segment], keys: DataFrame) -> DataFrame:
        """The rows whose key is among keys (which are distinct and stored), read from the files that may hold them."""
        small, large = [s for s in live if s.buckets == 1], [s for s in live if s.buckets > 1]
        files = self._files(large, keys)
        self.read_files, self.all_files = len(files) + len(small), sum(s.buckets for s in live)
        out = [self.segment(s) for s in small]
        if files:
            out.append(self.spark.read.schema(self.schema).parquet(*files))
        if not out:
            return self.spark.createDataFrame([], self.schema)
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return rows.join(met(keys.select(*self.key)), self.key, "left_semi")

    def discard(self, dropped: list[Segment]) -> None:
        """Delete the files of segments that no mark names any more."""
        for s in dropped:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{s.name}")
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def segments_of(mark: dict, name: str) -> list[Segment]:
    return [Segment(*s) for s in mark.get(name, [])]


def stored_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct keys of rows as a written table."""
    return scratch(rows.select(*columns).distinct(), "asked-keys")
