"""Video frames: probing output, selection and identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .checks import InvalidInput, assert_empty, assert_unique


def parse_probe(probes: DataFrame) -> DataFrame:
    """video_id, frame_index, frame_time_us of probe output in JSON (columns video_id, payload).

    The index is the position among all frames; times are rounded half-even to microseconds.
    A frame without a time, falling times or a payload whose frames all lie before 0
    are errors; frames before 0 are left out but keep their index.
    """
    schema = "struct<frames:array<struct<best_effort_timestamp_time:string>>>"
    read = probes.select("video_id", F.from_json("payload", schema).alias("p"))
    assert_empty(read.where("p.frames is null or size(p.frames) = 0").select("video_id"), "a payload has no frames")
    rows = read.select("video_id", F.posexplode("p.frames").alias("frame_index", "f"))
    seconds = F.expr("try_cast(f.best_effort_timestamp_time as decimal(38,12))")
    rows = rows.select("video_id", F.col("frame_index").cast("bigint").alias("frame_index"), seconds.alias("s"))
    assert_empty(rows.where("s is null"), "a frame has no time")
    timed = rows.select("video_id", "frame_index", F.expr("cast(bround(s * 1000000, 0) as bigint)").alias("frame_time_us"))
    check_frames(timed)
    kept = timed.where("frame_time_us >= 0")
    assert_empty(timed.select("video_id").distinct().join(kept.select("video_id").distinct(), "video_id", "left_anti"), "all frames of a video lie before 0")
    return kept


def check_frames(frames: DataFrame) -> None:
    """Indexes must be unique and times must not fall with the index."""
    assert_unique(frames, ["video_id", "frame_index"], "a frame index occurs twice")
    w = Window.partitionBy("video_id").orderBy("frame_index")
    assert_empty(frames.withColumn("before", F.lag("frame_time_us").over(w)).where("frame_time_us < before"), "frame times fall")


def _kept(times: np.ndarray, last: int | None, interval_us: int) -> list[int]:
    """Positions of the times that are kept, the first one if none was kept before."""
    out = []
    at = 0 if last is None else int(np.searchsorted(times, last + interval_us))
    while at < len(times):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(times, times[at] + interval_us)))
    return out


def select_interval(frames: DataFrame, interval_us: int) -> DataFrame:
    """The first frame of each video and each that is at least interval_us after the last one kept.

    What is kept depends on what was kept before, so a video's frames are gone
    through in order, as a stream of Arrow batches: one batch and one time are
    in memory however long the video is, and only kept frames are looked at
    one by one. Times that fall are an error. Returns video_id, frame_index,
    frame_time_us.
    """
    if interval_us < 0:
        raise ValueError("interval_us must not be negative")
    ship_package(frames.sparkSession)
    names = ["video_id", "frame_index", "frame_time_us"]
    rows = frames.select(*names).repartition("video_id").sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last, seen = None, None, None
        for batch in batches:
            ids, times = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
            change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            some: list[int] = []
            for at, end in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
                if at == end:
                    continue
                if ids[at] != video:
                    video, last, seen = ids[at], None, None
                part = times[at:end]
                if (part[1:] < part[:-1]).any() or (seen is not None and part[0] < seen):
                    raise InvalidInput(f"frame times of {video} fall")
                seen = int(part[-1])
                kept = _kept(part, last, interval_us)
                if kept:
                    last = int(part[kept[-1]])
                    some += [at + k for k in kept]
            yield batch.take(pa.array(some, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def cap_frames(frames: DataFrame, most: int) -> DataFrame:
    """At most `most` frames of each video, spread evenly: of n, those at (i * (n - 1)) div (most - 1)."""
    if most < 1:
        raise ValueError("most must be positive")
    w = Window.partitionBy("video_id")
    placed = frames.withColumn("_r", F.row_number().over(w.orderBy("frame_index")) - 1).withColumn("_n", F.count("*").over(w))
    if most == 1:
        return placed.where("_r = 0").drop("_r", "_n")
    return placed.where(_reached(most)).drop("_r", "_n")


def _reached(most: int) -> Column:
    """Whether rank _r of _n is (i * (_n - 1)) div (most - 1) for some i below most."""
    least = f"((_r * {most - 1} + _n - 2) div greatest(_n - 1, 1))"
    return F.expr(f"_n <= {most} or ({least} <= {most - 1} and ({least} * (_n - 1)) div {most - 1} = _r)")


def bound_density(frames: DataFrame, spacing_us: int | None, most: int | None) -> DataFrame:
    """select_interval, then cap_frames; either may be left out."""
    out = frames.select("video_id", "frame_index", "frame_time_us")
    if spacing_us is not None:
        out = select_interval(out, spacing_us)
    return out if most is None else cap_frames(out, most)


def select_quality(frames: DataFrame, sharpness: float, clipped: float, diversity: float) -> DataFrame:
    """Frames that are sharp and little clipped, the first such of a video and those that differ from the frame before.

    frames has video_id, frame_index, sharpness, clipped and difference (from
    the frame directly before, kept or not).
    """
    good = frames.where((F.col("sharpness") >= sharpness) & (F.col("clipped") <= clipped))
    first = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index")) == 1
    return good.withColumn("_first", first).where(F.col("_first") | (F.col("difference") >= diversity)).drop("_first")


def frame_observation_id(video: Column, sha256: Column, index: Column, time_us: Column) -> Column:
    """The id of a frame as an observation of its own."""
    return F.concat(F.lit("vf:"), F.sha2(F.concat_ws("\x00", video, sha256, index.cast("string"), time_us.cast("string")), 256))
