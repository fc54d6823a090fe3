"""The incremental forms: relation batches, record appends and frame selection as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.checks import InvalidInput, assert_empty
from ..operators.identity import new_records
from ..scratch import scratch, shared_path
from ..shipping import ship_package
from .keyed import KeyedLog, Marks, segments_of, stored_keys


class BatchTable:
    """A table in the shared folder that grows by numbered batches.

    A batch is written under its number, then its mark, one row of what later
    batches need to know of it. What has no mark does not count: if a run stops
    half way, the batch comes again and is written anew; if it comes again
    after its mark, it is there already. All state is in the folder, so a new
    driver goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def marked(self) -> list[int]:
        """The numbers of the batches that count, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/marks")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        named = [x.getPath() for x in store.listStatus(root)]
        done = [p for p in named if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def rows(self, before: int | None = None) -> DataFrame:
        """The rows of the batches that count, or of those with smaller numbers."""
        some = [k for k in self.marked() if before is None or k < before]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/rows/{k:012d}" for k in some))

    def mark(self, number: int) -> Row:
        return self.spark.read.parquet(f"{self.folder}/marks/{number:012d}").first()

    def write(self, number: int, rows: DataFrame, mark: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/rows/{number:012d}")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{number:012d}")


class RelationLog:
    """Relations that arrive in batches, each pair greater than all before; anything else is an error.

    Nothing is dropped as late: a pair out of order or met twice stops the
    stream. A batch of a number that is there already is the same batch again
    and adds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.table = BatchTable(spark, folder, "id1 string, id2 string, disposition string, evidence array<struct<kind:string,id:string>>")

    @property
    def rows(self) -> DataFrame:
        return self.table.rows()

    def add(self, batch: DataFrame, number: int) -> None:
        done = self.table.marked()
        if number in done:
            return
        batch = scratch(batch.select(*self.table.schema.names), "relation-batch")
        ends = batch.agg(F.count("*").alias("n"), F.count_distinct("id1", "id2").alias("d"), F.min(F.struct("id1", "id2")).alias("low"), F.max(F.struct("id1", "id2")).alias("high"))
        found = ends.first()
        earlier = [k for k in done if k < number]
        last = self.table.mark(earlier[-1]).high if earlier else None
        if found.n:
            if found.n != found.d or (last is not None and tuple(found.low) <= tuple(last)):
                raise InvalidInput("pairs must rise from batch to batch")
            assert_empty(batch.where("id1 >= id2"), "a pair is not in order")
        high = found.high or last
        self.table.write(number, batch, batch.sparkSession.createDataFrame([(high,)], "high struct<id1:string,id2:string>"))


def stream_relations(relations: DataFrame, log: RelationLog, checkpoint: str) -> StreamingQuery:
    """Feed a stream of relations to the log."""
    return relations.writeStream.foreachBatch(log.add).option("checkpointLocation", checkpoint).start()


class RecordTable:
    """Records that streams add to; equal ones are taken once, conflicting ones are errors.

    Records lie in bucket files by a hash of their key, with the range and a
    filter of each file's keys. A batch is compared only with files that may
    hold its keys; what is stored is written again only when segments merge.
    """

    KEY = ["record_type", "record_id"]

    def __init__(self, spark: SparkSession, folder: str):
        self.marks = Marks(spark, folder)
        self.log = KeyedLog(spark, f"{folder.rstrip('/')}/records", "record_type string, record_id string, payload string", self.KEY)

    @property
    def rows(self) -> DataFrame:
        return self.log.rows(segments_of(self.marks.last()[1], "records"))

    @property
    def touched(self) -> dict:
        """Of the last batch: records added, files read, and the files that there were."""
        return self.marks.last()[1].get("touched", {})

    def add(self, batch: DataFrame, number: int) -> None:
        last, mark = self.marks.last()
        if number <= last:
            return
        batch = scratch(batch.select(*self.KEY, "payload").distinct(), "record-batch")
        live = segments_of(mark, "records")
        held = self.log.find(live, stored_keys(batch, self.KEY))
        read, of = self.log.read_files, self.log.all_files
        more = scratch(new_records(scratch(held, "record-held"), batch), "record-new")
        n = more.count()
        now = self.log.add(live, more, n)
        earlier = [self.marks.read(k) for k in self.marks.numbers()]
        self.marks.write(number, {"records": now, "touched": {"added": n, "files": read, "of": of}})
        if len(earlier) >= Marks.KEPT:
            kept = {s.name for m in (*earlier[1:], {"records": now}) for s in segments_of(m, "records")}
            self.log.discard([s for s in segments_of(earlier[0], "records") if s.name not in kept])


def stream_records(records: DataFrame, table: RecordTable, checkpoint: str) -> StreamingQuery:
    return records.writeStream.foreachBatch(table.add).option("checkpointLocation", checkpoint).start()


class _Interval(StatefulProcessor):
    """select_interval of one video at a time, with a buffer that puts its frames in order."""

    def __init__(self, interval_us: int, delay_us: int):
        self.interval_us, self.delay_us = interval_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "last bigint, done bigint, most bigint")
        self.held = handle.getListState("held", "t bigint, i bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: TimerValues) -> Iterator[Row]:
        last, done, most = self.at.get() if self.at.exists() else (None, None, None)
        held, ended = [tuple(r) for r in self.held.get()] if self.held.exists() else [], False
        for row in rows:
            if row["frame_index"] is None:
                ended = True
                continue
            t = row["frame_time_us"]
            if done is not None and t < done:
                raise InvalidInput(f"a frame of {key[0]} comes more than {self.delay_us} us late")
            most = t if most is None else max(most, t)
            held.append((t, row["frame_index"]))
        held.sort()
        bound = most if ended else None if most is None else most - self.delay_us
        ready = [x for x in held if bound is not None and x[0] <= bound]
        for t, i in ready:
            if last is None or t - last >= self.interval_us:
                last = t
                yield Row(video_id=key[0], frame_index=i, frame_time_us=t)
        if bound is not None:
            done = bound if done is None else max(done, bound)
        self.at.update((last, done, most))
        if len(ready) < len(held):
            self.held.put(held[len(ready) :])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_interval(frames: DataFrame, interval_us: int, *, delay_us: int = 0) -> DataFrame:
    """select_interval on a stream of frames (video_id, frame_index, frame_time_us).

    Frames of a video may come in any order within delay_us: they are held, as a
    list in the state store, until its latest frame is delay_us ahead of them,
    and then gone through by time, ties by index. A frame that comes later than
    that is an error, never dropped. A row without a frame_index ends the video and gives
    out what is held. So memory is the frames of delay_us, whatever the length of a
    video or a batch. The time last kept is the rest of the state. The session's state store is set to RocksDB, which such states need.
    """
    spark = frames.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = frames.select("video_id", "frame_index", "frame_time_us").groupBy("video_id")
    return grouped.transformWithState(_Interval(interval_us, delay_us), StructType.fromDDL("video_id string, frame_index bigint, frame_time_us bigint"), "Append", "None")


def new_checkpoint(df: DataFrame) -> str:
    """A checkpoint folder for a stream, in the shared folder."""
    return shared_path(df.sparkSession, "stream")
