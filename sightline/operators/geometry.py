"""Cameras, depth fields and how candidate geometries agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..scratch import lookup, scratch
from ..shipping import ship_package
from .checks import assert_empty, assert_unique

#: Cameras are gathered by their pose where it is shared by so many on average; their order is counted in chunks of so many.
REPEATS, CHUNK_CAMERAS = 8, 1 << 18
#: Cameras of a chunk that are compared one by one; the rest of a chunk by counts.
RUN = 256


def rotation_about_z(angle: Column) -> Column:
    """A rotation by angle (radians) about z, as nine numbers by rows."""
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, s, c, zero, zero, zero, one)


def _at(m: Column, i: int, j: int) -> Column:
    return m[3 * i + j]


def relative_rotation(a: Column, b: Column) -> Column:
    """b times the transpose of a."""
    return F.array(*(sum((_at(b, i, k) * _at(a, j, k) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)))


def rotation_angle_degrees(a: Column, b: Column) -> Column:
    """The angle of the rotation between two rotations."""
    dot = sum((a[k] * b[k] for k in range(9)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dot - 1) / 2))))


def camera_centre(r: Column, t: Column) -> Column:
    """The centre of a camera: minus the transposed rotation times the translation."""
    return F.array(*(-sum((_at(r, k, i) * t[k] for k in range(3)), F.lit(0.0)) for i in range(3)))


def baseline_direction(r1: Column, c1: Column, c2: Column) -> Column:
    """The unit direction from a camera of rotation r1 and centre c1 to the centre c2, in that camera; null if they coincide."""
    gap = F.zip_with(c2, c1, lambda a, b: a - b)
    local = F.element_at(F.transform(F.array(gap), lambda g: F.array(*(sum((_at(r1, i, k) * g[k] for k in range(3)), F.lit(0.0)) for i in range(3)))), 1)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.array(local), lambda v: F.when(norm(v) > 1e-12, F.transform(v, lambda x: x / norm(v))))
    return F.element_at(unit, 1)


def direction_angle_degrees(a: Column, b: Column) -> Column:
    """The angle between two unit vectors."""
    dot = sum((a[k] * b[k] for k in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def _median_degrees(rows: DataFrame) -> DataFrame:
    """key, kind, n, median of rows (key, kind, v from 0 to 180, times): exact; null v do not count, the others as often as times says.

    Rows are counted by cells of 1/1024 degree, combined before the shuffle; then only the
    values of the one or two cells that hold the middle ranks are put in order.
    """
    by = ["key", "kind"]
    w = Window.partitionBy(*by)
    rows = rows.where("v is not null").withColumn("cell", F.floor(F.col("v") * 1024))
    counts = scratch(rows.groupBy(*by, "cell").agg(F.sum("times").alias("n")), "median-cells")
    ranked = counts.withColumn("before", F.sum("n").over(w.orderBy("cell")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    middle = ranked.where("before <= total div 2 and before + n > (total - 1) div 2").drop("n")
    held = rows.join(lookup(scratch(middle, "median-middle")), [*by, "cell"]).groupBy(*by, "v").agg(F.sum("times").alias("n"), F.min("before").alias("before"), F.max("total").alias("total"))
    at = held.withColumn("at", F.min("before").over(w) + F.sum("n").over(w.orderBy("v")) - F.col("n"))
    found = at.where("at <= total div 2 and at + n > (total - 1) div 2")
    return found.groupBy(*by).agg(F.max("total").alias("n"), ((F.min("v") + F.max("v")) / 2).alias("median"))


def _pairs_ahead(p: list[np.ndarray], before: np.ndarray, q: list[np.ndarray], width: int) -> np.ndarray:
    """How many pairs of a member of p[i] and one of q[k] have the first member at a lesser place, plus before[i] for each of q[k]."""
    at_p, at_q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (p, q))
    of_p, of_q = (np.repeat(np.arange(len(x)), np.array([len(y) for y in x], np.int64)) for x in (p, q))
    order = np.argsort(at_q, kind="stable")
    at_q, of_q = at_q[order], of_q[order]
    found = np.multiply.outer(before, np.bincount(of_q, minlength=width))
    if not len(at_p) or not len(at_q):
        return found
    # q falls into runs; a place of p lies within one, before all later ones and behind all earlier ones
    runs = -(-len(at_q) // RUN)
    run = np.searchsorted(at_q[::RUN], at_p, "right") - 1
    here = np.bincount((run + 1) * len(p) + of_p, minlength=(runs + 1) * len(p)).reshape(runs + 1, len(p))
    there = np.bincount(np.arange(len(at_q)) // RUN * width + of_q, minlength=runs * width).reshape(runs, width)
    found += np.rint(np.cumsum(here[:runs], axis=0).T.astype(float) @ there.astype(float)).astype(np.int64)
    start, end = np.searchsorted(at_q, at_p, "right"), np.minimum((run + 1) * RUN, len(at_q))
    left = np.where(run >= 0, end - start, 0)
    for k in range(0, len(at_p), 8192):
        n = left[k : k + 8192]
        behind = np.repeat(start[k : k + 8192] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found += np.bincount(np.repeat(of_p[k : k + 8192], n) * width + of_q[behind], minlength=found.size).reshape(found.shape)
    return found


def _by_pose(both: DataFrame, names: list[str], cameras: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of all pairs of poses (names) of a key, by blocks i and j of poses.

    The first has in times, by the slot of a pose in block j, how many pairs of a camera of
    each pose have the first one's before the second one's; rows of a pose for several chunks
    of cameras add up. A task holds two blocks of poses and the places of one chunk.
    """
    chunks = max(1, -(-cameras // CHUNK_CAMERAS))
    ranged = scratch(both.repartitionByRange(chunks, "key", "camera").withColumn("g", F.spark_partition_id()), "pose-ranged")
    placed = ranged.withColumn("at", F.dense_rank().over(Window.partitionBy("g").orderBy("key", "camera")).cast("long"))
    cells = placed.groupBy("key", *names, "g").agg(F.collect_list("at").alias("at")).withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
    cells = scratch(cells.withColumn("slot", F.dense_rank().over(Window.partitionBy("key", "block").orderBy(*names)) - 1), "pose-cells")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    two = cells.select("key", "block", "slot", *names).distinct().select("key", every.alias("i"), F.col("block").alias("j"), "slot", *(F.col(x).alias(f"{x}_2") for x in names))
    # a pose is there from the chunk of its first camera on
    w, last = Window.partitionBy("key", "block", "slot").orderBy("g"), F.lit(int(cells.agg(F.max("g")).first()[0] or 0))
    early = cells.withColumn("before", F.coalesce(F.sum(F.size("at")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("until", F.coalesce(F.lead("g").over(w) - 1, last))
    early = early.withColumn("h", F.explode(F.sequence("g", "until"))).withColumn("own", F.col("h") == F.col("g"))
    early = early.select("key", F.col("block").alias("i"), every.alias("j"), F.col("h").alias("g"), F.when(F.col("own"), F.col("before")).otherwise(F.col("before") + F.size("at")).alias("before"), F.when(F.col("own"), F.col("at")).otherwise(F.expr("cast(array() as array<bigint>)")).alias("at"), *(F.col(x).alias(f"{x}_1") for x in names))
    late = cells.select("key", every.alias("i"), F.col("block").alias("j"), "g", "slot", "at")
    kept = ["key", "i", "j", *(f"{x}_1" for x in names)]
    schema = StructType([*early.select(*kept).schema.fields, StructField("times", ArrayType(LongType()))])

    def solve(first: pa.Table, second: pa.Table) -> pa.Table:
        lists = lambda t: [np.asarray(x.values) for x in t.column("at")]
        slots = second.column("slot").to_numpy()
        width, q = int(slots.max(initial=-1)) + 1, lists(second)
        placed_q = [np.zeros(0, np.int64)] * width
        for slot, at in zip(slots, q, strict=True):
            placed_q[slot] = at
        found = _pairs_ahead(lists(first), first.column("before").to_numpy().astype(np.int64), placed_q, width)
        times = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel()))
        return first.select(kept).append_column("times", times).filter(pa.array(found.any(axis=1)))

    ship_package(both.sparkSession)
    group, tasks = ["key", "i", "j", "g"], int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = early.repartition(tasks, *group).groupBy(*group).cogroup(late.repartition(tasks, *group).groupBy(*group)).applyInArrow(solve, schema)
    return one, two


def pose_agreement(reference: DataFrame, candidate: DataFrame, *, block: int = 1024) -> DataFrame:
    """key, shared, reference_count, candidate_count, union_count, pair_count, rotation_deg, translation_pairs, translation_deg.

    Both have key, camera, r (nine numbers) and t (three); a key names what is
    compared with what. Over all pairs of cameras that both know: the exact median angle
    between relative rotations, and between baseline directions where neither
    baseline is 0. Medians over nothing are null. The cameras of a key fall into blocks of
    about block cameras by a hash, as many as the largest key asks for, and each block meets each.
    Where cameras share their poses, in the reference and in the candidate, each pair of poses is
    compared once and counts for all pairs of their cameras.
    """
    spark = reference.sparkSession
    both = reference.select("key", "camera", "r", camera_centre(F.col("r"), F.col("t")).alias("c")).join(candidate.select("key", "camera", F.col("r").alias("u"), camera_centre(F.col("r"), F.col("t")).alias("d")), ["key", "camera"])
    # per camera m = r' u: the trace of one relative rotation's transpose by the other is the sum of products of
    # two cameras' m, and the two baselines g, h, each seen from its own first camera, have the product g' m h
    m = [sum((_at(F.col("r"), k, i) * _at(F.col("u"), k, j) for k in range(3)), F.lit(0.0)).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    both = both.select("key", "camera", *m, *(F.element_at(x, i + 1).alias(f"{x}{i}") for x in "cd" for i in range(3)))
    both = scratch(both, "pose-both")
    names = [f"m{i}{j}" for i in range(3) for j in range(3)] + [f"{x}{i}" for x in "cd" for i in range(3)]
    size = lambda rows: rows.groupBy("key").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(1))).first()
    (cameras, most), (poses, most_poses) = size(both), size(both.select("key", *names).distinct())
    if shared := poses * REPEATS <= cameras:
        most = most_poses
    blocks = max(4, -(-most // block))
    if shared:
        one, two = _by_pose(both, names, cameras, blocks)
    else:
        both = scratch(both.withColumn("block", F.pmod(F.xxhash64("camera"), F.lit(blocks)).cast("int")), "pose-cameras")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        one = both.select("key", F.col("block").alias("i"), every.alias("j"), F.col("camera").alias("camera1"), *(F.col(x).alias(f"{x}_1") for x in names))
        two = both.select("key", every.alias("i"), F.col("block").alias("j"), F.col("camera").alias("camera2"), *(F.col(x).alias(f"{x}_2") for x in names))
    times = F.get("times", F.col("slot")) if shared else (F.col("camera1") < F.col("camera2")).cast("long")
    group = ["key", "i", "j"]
    # a block's rows are many times those of the table they come from, by whose size Spark would broadcast them through the driver
    pairs = one.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).join(two.hint("merge"), group).withColumn("times", times).where("times > 0")
    trace = sum((F.col(f"{x}_1") * F.col(f"{x}_2") for x in names[:9]), F.lit(0.0))
    gap = {x: [F.col(f"{x}{i}_2") - F.col(f"{x}{i}_1") for i in range(3)] for x in "cd"}
    pairs = pairs.select("key", "times", trace.alias("trace"), *(F.col(f"{x}_1") for x in names[:9]), *(gap[x][i].alias(f"{x}{i}") for x in "cd" for i in range(3)))
    length = {x: F.sqrt(sum((F.col(f"{x}{i}") * F.col(f"{x}{i}") for i in range(3)), F.lit(0.0))) for x in "cd"}
    along = sum((F.col(f"c{i}") * F.col(f"m{i}{j}_1") * F.col(f"d{j}") for i in range(3) for j in range(3)), F.lit(0.0))
    angle = lambda cosine: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    far = (length["c"] > 1e-12) & (length["d"] > 1e-12)
    pairs = pairs.select("key", "times", angle((F.col("trace") - 1) / 2).alias("rot"), F.when(far, angle(along / (length["c"] * length["d"]))).alias("dir"))
    medians = _median_degrees(pairs.select("key", "times", F.expr("stack(2, 'rot', rot, 'dir', dir) as (kind, v)")))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    angles = medians.groupBy("key").agg(of("rot", "n").alias("pair_count"), of("rot", "median").alias("rotation_deg"), of("dir", "n").alias("translation_pairs"), of("dir", "median").alias("translation_deg"))
    counts = reference.select("key", "camera", F.lit(1).alias("a")).join(candidate.select("key", "camera", F.lit(1).alias("b")), ["key", "camera"], "full")
    counts = counts.groupBy("key").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count("a").alias("reference_count"), F.count("b").alias("candidate_count"), F.count("*").alias("union_count"))
    return counts.join(angles, "key", "left").fillna(0, ["pair_count", "translation_pairs"])


def pose_quality(agreement: DataFrame) -> DataFrame:
    """key, metric, value: coverage, rotation and translation errors against a reference; what has no evidence has no row."""
    wide = agreement.select("key", (F.col("shared") / F.col("reference_count")).alias("camera_coverage"), F.col("rotation_deg").alias("median_rotation_error_deg"), F.expr("try_divide(translation_pairs, pair_count)").alias("translation_coverage"), F.col("translation_deg").alias("median_translation_error_deg"))
    names = wide.columns[1:]
    return wide.select("key", F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (metric, value)")).where("value is not null")


def geometry_consensus(solutions: DataFrame) -> DataFrame:
    """solution1, solution2, metric, value over all pairs of solutions: shared ratio and disagreements.

    solutions has solution, camera, r, t. Pairs with fewer than two shared cameras have the ratio alone.
    """
    assert_unique(solutions, ["solution", "camera"], "a camera occurs twice in a solution")
    ids = [r.solution for r in solutions.select("solution").distinct().orderBy("solution").collect()]  # candidates are few
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    named = F.explode(F.array(*(F.struct(F.lit(f"{a}|{b}").alias("key"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    wide = solutions.withColumn("p", named)
    agreement = pose_agreement(wide.where("solution = p.a").select("p.key", "camera", "r", "t"), wide.where("solution = p.b").select("p.key", "camera", "r", "t"))
    out = agreement.select("key", (F.col("shared") / F.col("union_count")).alias("shared_camera_ratio"), F.col("rotation_deg").alias("median_rotation_disagreement_deg"), F.col("translation_deg").alias("median_translation_disagreement_deg"))
    names = out.columns[1:]
    long = out.select("key", F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (metric, value)")).where("value is not null")
    return long.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("solution1"), F.split_part("key", F.lit("|"), F.lit(2)).alias("solution2"), "metric", "value")


def intrinsics_quality(pairs: DataFrame) -> DataFrame:
    """key, median_focal_error, median_principal_error of cameras of equal size; other models or sizes are an error.

    pairs has key, model, width, height, fx, fy, cx, cy and the same with a 2.
    """
    assert_empty(pairs.where("model <> 'pinhole' or model2 <> 'pinhole' or width <> width2 or height <> height2"), "cameras can't be compared")
    focal = (F.abs(F.col("fx2") - F.col("fx")) / F.col("fx") + F.abs(F.col("fy2") - F.col("fy")) / F.col("fy")) / 2
    centre = F.hypot(F.col("cx2") - F.col("cx"), F.col("cy2") - F.col("cy")) / F.hypot(F.col("width"), F.col("height"))
    return pairs.groupBy("key").agg(F.median(focal).alias("median_focal_error"), F.median(centre).alias("median_principal_error"))


def check_depth(pixels: DataFrame) -> None:
    """Valid depths are positive; confidence lies within 0 and 1."""
    assert_empty(pixels.where("valid and not depth > 0 or confidence is not null and not confidence between 0 and 1"), "a depth field is malformed")


def depth_coverage(pixels: DataFrame) -> DataFrame:
    """camera, valid_count, hole_count, mean_confidence of each field, over its valid pixels."""
    return pixels.groupBy("camera").agg(F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("hole_count"), F.avg(F.when(F.col("valid"), F.col("confidence"))).alias("mean_confidence"))


def depth_coverage_total(pixels: DataFrame) -> DataFrame:
    """metric, value over all fields: support, confidence-bearing share, holes, pooled confidence, valid share."""
    fields = pixels.groupBy("camera").agg(F.count("*").alias("n"), F.count_if("valid").alias("v"), F.max(F.col("confidence").isNotNull().cast("int")).alias("c"), F.sum(F.when(F.col("valid"), F.col("confidence"))).alias("s"), F.count(F.when(F.col("valid"), F.col("confidence"))).alias("k"))
    wide = fields.agg(
        F.count("*").cast("double").alias("field_count"),
        (F.sum("c") / F.count("*")).alias("confidence_field_ratio"),
        ((F.sum("n") - F.sum("v")) / F.sum("n")).alias("hole_ratio"),
        F.expr("try_divide(sum(s), sum(k))").alias("mean_confidence"),
        (F.sum("v") / F.sum("n")).alias("valid_ratio"),
    )
    names = wide.columns
    return wide.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (metric, value)")).where("value is not null")


def depth_errors(pixels: DataFrame) -> DataFrame:
    """camera, reference_coverage, median_abs_error, median_rel_error against reference_depth and reference_valid.

    Medians are exact and over pixels that both hold valid; null where there are none.
    """
    joint = F.col("valid") & F.col("reference_valid")
    gap = F.when(joint, F.abs(F.col("depth") - F.col("reference_depth")))
    return pixels.groupBy("camera").agg(
        F.try_divide(F.count_if(joint).cast("double"), F.count_if("reference_valid").cast("double")).alias("reference_coverage"), F.median(gap).alias("median_abs_error"), F.median(gap / F.when(joint, F.nullif(F.col("reference_depth"), F.lit(0.0)))).alias("median_rel_error")
    )


def valid_depth(values: Column) -> Column:
    """(depth, valid) of raw depths: what is not positive and finite is invalid, with depth 0."""
    return F.transform(values, lambda v: F.struct(F.when((v > 0) & (v < float("inf")), v).otherwise(0.0).alias("depth"), F.coalesce((v > 0) & (v < float("inf")), F.lit(False)).alias("valid")))


def sparse_model_rows(estimates: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Cameras of a sparse estimate: pose joined to its calibration, model name in lower case."""
    assert_empty(estimates.join(calibrations, "camera_id", "left_anti"), "a pose has no calibration")
    return estimates.join(calibrations.withColumn("model", F.lower("model")), "camera_id")
