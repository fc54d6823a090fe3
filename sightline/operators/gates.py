"""Gates before outside tools run and after: tables of what is wrong, none if all is well.

Every gate returns rows (what is judged, problem), so that many inputs are judged
at once; passed() raises if there is a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch, spread
from .checks import assert_empty
from .dag import settle
from .identity import safe_path

#: What a trainer that reads source images as they are needs of their photometry.
SOURCE_PHOTOMETRY = {"orientation": "source_pixels", "pixel_layout": "rgb8_packed", "decoded_encoding": "srgb_full_rgb8"}


def passed(problems: DataFrame, message: str) -> None:
    """Raise with the first problem, if there is one."""
    assert_empty(problems, message)


def _first(cases: list[tuple[Column, str]]) -> Column:
    """The name of the first case that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def order_problems(rows: DataFrame, by: str, keys: list[str], noun: str, position: str = "position") -> DataFrame:
    """by, problem: repeated_<noun> where keys occur twice in a list, <noun>_order where they fall.

    rows has by, position and keys; each list is gone through in order of its positions.
    """
    current = F.struct(*keys)
    w = Window.partitionBy(by).orderBy(position)
    falls = rows.withColumn("_before", F.lag(current).over(w)).where(F.col("_before") > current)
    twice = rows.groupBy(by, *keys).count().where("count > 1")
    return falls.select(by).distinct().withColumn("problem", F.lit(f"{noun}_order")).unionByName(twice.select(by).distinct().withColumn("problem", F.lit(f"repeated_{noun}")))


def membership_problems(expected: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """columns, problem: missing, unexpected or repeated rows of found against the keys of expected."""
    sides = [df.select(*columns, F.lit(w).alias("_w"), F.lit(h).alias("_h")) for df, w, h in ((expected, 1, 0), (found, 0, 1))]
    rows = scratch(sides[0].unionByName(sides[1]), "members")
    met = spread(rows, rows.count(), *columns).groupBy(*columns).agg(F.sum("_w").alias("_w"), F.sum("_h").alias("_h"))
    unlike = reduce(Column.__or__, (F.col(c).isNull() for c in columns))  # a key that is not known equals none
    w, h = F.col("_w") > 0, F.col("_h") > 0
    every = F.array(F.when(w & (~h | unlike), "missing"), F.when(h & (~w | unlike), "unexpected"), F.when(F.col("_h") > 1, "repeated"))
    return met.select(*columns, F.explode(F.array_compact(every)).alias("problem"))


def reference_problems(refs: DataFrame, kind: str) -> DataFrame:
    """owner, problem of the inputs (owner, position, kind, id) that a solver takes: all of one kind, unique, in order of (kind, id)."""
    other = refs.where(F.col("kind") != kind).select("owner").distinct().withColumn("problem", F.lit("other_kind"))
    return other.unionByName(order_problems(refs, "owner", ["kind", "id"], "input"))


def route_reason_problems(decisions: DataFrame, reasons: DataFrame, evidence: DataFrame) -> DataFrame:
    """decision_id, problem: decisions need reasons with unique codes in order, and evidence that their input has.

    decisions has decision_id; reasons decision_id, position, code, refs (array
    of kind and id); evidence decision_id, kind, id: the artifacts of the
    router's input and of its media profiles.
    """
    none = decisions.select("decision_id").join(reasons, "decision_id", "left_anti").withColumn("problem", F.lit("no_reason"))
    refs = reasons.select("decision_id", F.explode("refs").alias("r")).select("decision_id", "r.kind", "r.id")
    unknown = refs.join(evidence, ["decision_id", "kind", "id"], "left_anti").select("decision_id").distinct().withColumn("problem", F.lit("unknown_evidence"))
    return _union([none, unknown, order_problems(reasons, "decision_id", ["code"], "code")])


def router_input_problems(inputs: DataFrame, profiles: DataFrame, artifacts: DataFrame, failures: DataFrame) -> DataFrame:
    """input_id, problem of router inputs.

    inputs has input_id, gpu_count, vram_bytes; profiles input_id, position,
    observation_id; artifacts input_id, position, artifact_id, kind; failures
    input_id, position, failure. Each list is unique and in order, there is a
    profile, an artifact id has one kind, and without a GPU there is no video memory.
    """
    kinds = artifacts.groupBy("input_id", "artifact_id").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b")
    return _union([
        inputs.select("input_id").join(profiles, "input_id", "left_anti").withColumn("problem", F.lit("no_profile")),
        inputs.where("gpu_count = 0 and vram_bytes <> 0 or gpu_count < 0 or vram_bytes < 0").select("input_id").withColumn("problem", F.lit("budget")),
        kinds.select("input_id").distinct().withColumn("problem", F.lit("two_kinds")),
        order_problems(profiles, "input_id", ["observation_id"], "profile"),
        order_problems(artifacts, "input_id", ["artifact_id", "kind"], "artifact"),
        order_problems(failures, "input_id", ["failure"], "failure"),
    ])


def route_graph_problems(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, problem of route graphs, any number at once.

    graphs has graph_id; nodes graph_id, position, node; edges graph_id,
    position, source, target. A graph has nodes; nodes and edges are unique and
    in order, edges join nodes of the graph, and there is no cycle; all graphs
    are settled at once.
    """
    nodes, edges = scratch(nodes, "route-nodes"), scratch(edges, "route-edges")  # both are read several times
    ends = edges.select("graph_id", F.col("source").alias("node")).union(edges.select("graph_id", "target")).distinct()
    node = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    cyclic = settle(edges.select(node("source").alias("s"), node("target").alias("t")), "s", "t").cyclic
    return _union([
        graphs.select("graph_id").join(nodes, "graph_id", "left_anti").withColumn("problem", F.lit("no_node")),
        ends.join(nodes, ["graph_id", "node"], "left_anti").select("graph_id").distinct().withColumn("problem", F.lit("unknown_end")),
        order_problems(nodes, "graph_id", ["node"], "node"),
        order_problems(edges, "graph_id", ["source", "target"], "edge"),
        cyclic.select("node.graph_id").distinct().withColumn("problem", F.lit("cycle")),
    ])


def preflight_problems(requested: DataFrame, images: DataFrame, cameras: DataFrame, files: DataFrame, *, registered_images: int, sparse_points: int, most_bytes: int = 1 << 28) -> DataFrame:
    """observation_id, problem (null for what concerns the whole model): what keeps images and cameras from training.

    requested has position, observation_id; images position, observation_id,
    name, sha256, byte_length; cameras observation_id, model, parameters (fx, fy,
    cx, cy), width, height; files name, sha256, byte_length, width, height as they were
    read. Images, cameras and the request must be the same, in the same order; a
    name is one plain part that ends in .png; cameras are pinholes with focal
    lengths above 0; files are as recorded, of the camera's size, and no larger than
    most_bytes.
    """
    order = requested.select("observation_id", F.col("position").alias("_asked"))
    camera = cameras.groupBy("observation_id").agg(F.count("*").alias("_cameras"), F.first("model").alias("model"), F.first("parameters").alias("parameters"), F.first("width").alias("_w"), F.first("height").alias("_h"))
    held = files.select("name", F.col("sha256").alias("_sha"), F.col("byte_length").alias("_bytes"), F.col("width").alias("_fw"), F.col("height").alias("_fh"))
    every = order.join(images, "observation_id", "full").join(camera, "observation_id", "full").join(held, "name", "left")
    fx, fy = F.get("parameters", F.lit(0)), F.get("parameters", F.lit(1))
    plain = safe_path(F.col("name")) & ~F.col("name").contains("/") & F.lower("name").endswith(".png")
    problem = _first([
        (F.col("_asked").isNull(), "not_requested"),
        (F.col("name").isNull(), "no_image"),
        (F.col("_cameras").isNull(), "no_camera"),
        (F.col("_cameras") > 1, "two_cameras"),
        (F.col("position") != F.col("_asked"), "order"),
        (~plain, "name"),
        ((F.col("model") != "pinhole") | (F.size("parameters") != 4), "not_pinhole"),
        (~((fx > 0) & (fy > 0)), "focal_length"),
        (F.col("_sha").isNull(), "missing_file"),
        (F.col("_bytes") > most_bytes, "too_large"),
        ((F.col("_sha") != F.col("sha256")) | (F.col("_bytes") != F.col("byte_length")), "other_content"),
        ((F.col("_fw") != F.col("_w")) | (F.col("_fh") != F.col("_h")), "other_dimensions"),
    ])
    found = every.select("observation_id", problem.alias("problem")).where("problem is not null")
    totals = cameras.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.when(F.col("n") != registered_images, "registered_images"), F.when(F.lit(sparse_points) < 1, "no_points"),
    )).alias("problem")).where("problem is not null")
    return found.unionByName(totals.select(F.lit(None).cast(found.schema["observation_id"].dataType).alias("observation_id"), "problem"))


def source_photometry_problems(images: DataFrame, assessments: DataFrame) -> DataFrame:
    """observation_id, problem: images whose pixels must not be trained on as they are.

    images has observation_id, sha256, width, height; assessments observation_id,
    compatibility_status, color_status, normalization_status, source_sha256,
    source_kind, orientation, pixel_layout, decoded_encoding, level, width,
    height, exposure_ev, gains. Each image has one assessment; it is of exactly
    these bytes, ready and compatible, unrotated, at the original level and size, and changes
    nothing: the adjustment is 0 EV and gains of 1.
    """
    counted = assessments.withColumn("_n", F.count("*").over(Window.partitionBy("observation_id")))
    joined = images.select("observation_id", F.col("sha256"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(True).alias("_image")).join(counted, "observation_id", "full")
    other = F.lit(False)
    for name, value in SOURCE_PHOTOMETRY.items():
        other = other | ~F.col(name).eqNullSafe(F.lit(value))
    problem = _first([
        (F.col("_n").isNull(), "no_assessment"),
        (F.col("_image").isNull(), "no_image"),
        (F.col("_n") > 1, "two_assessments"),
        (~F.col("compatibility_status").eqNullSafe(F.lit("COMPATIBLE")), "not_compatible"),
        (~F.col("color_status").eqNullSafe(F.lit("READY")) | ~F.col("normalization_status").eqNullSafe(F.lit("READY")), "not_ready"),
        (~F.col("source_sha256").eqNullSafe(F.col("sha256")) | ~F.col("source_kind").eqNullSafe(F.lit("image")), "other_source"),
        (other | ~F.col("level").eqNullSafe(F.lit(0)), "other_pixels"),
        (~F.col("width").eqNullSafe(F.col("_w")) | ~F.col("height").eqNullSafe(F.col("_h")), "resized"),
        (~F.col("exposure_ev").eqNullSafe(F.lit(0.0)) | ~F.col("gains").eqNullSafe(F.array(*[F.lit(1.0)] * 3)), "adjusted"),
    ])
    return joined.select("observation_id", problem.alias("problem")).where("problem is not null").distinct()


def staged_problems(manifest: DataFrame, staged: DataFrame, originals: DataFrame) -> DataFrame:
    """path, problem of a staged data set against its manifest and the files that it was made from.

    manifest has path, sha256, byte_length; staged and originals path, sha256,
    byte_length as the files were read again. Copies and originals must both be what the
    manifest says, and the set holds no other file.
    """
    want = manifest.select("path", F.lower("sha256").alias("_sha"), F.col("byte_length").alias("_n"))
    read = lambda rows, a, b: rows.select("path", F.col("sha256").alias(a), F.col("byte_length").alias(b))
    every = want.join(read(staged, "_s1", "_n1"), "path", "full").join(read(originals, "_s2", "_n2"), "path", "left")
    problem = _first([
        (F.col("_sha").isNull(), "unexpected"),
        (~safe_path(F.col("path")), "unsafe_path"),
        (F.col("_s1").isNull(), "missing"),
        ((F.col("_s1") != F.col("_sha")) | (F.col("_n1") != F.col("_n")), "other_copy"),
        (F.col("_s2").isNull(), "original_missing"),
        ((F.col("_s2") != F.col("_sha")) | (F.col("_n2") != F.col("_n")), "other_original"),
    ])
    return every.select("path", problem.alias("problem")).where("problem is not null")


def source_pin_problems(pins: DataFrame, found: DataFrame, *, closed: tuple[str, ...] = ()) -> DataFrame:
    """path, problem of reviewed source files.

    pins has path, byte_length, blob_sha1; found path, byte_length, blob_sha1,
    is_link as they lie there. Every pinned file is there, no link, of this length and
    hash. Files that are not pinned are ignored, unless their path matches one of the
    closed patterns (regular expressions): a package, or the sources at the top.
    """
    want = pins.select("path", F.col("byte_length").alias("_n"), F.col("blob_sha1").alias("_sha"), F.lit(True).alias("_pinned"))
    every = want.join(found, "path", "full")
    within = reduce(lambda a, b: a | b, [F.col("path").rlike(c) for c in closed], F.lit(False))
    problem = _first([
        (F.col("_pinned").isNull() & within, "unlisted"),
        (F.col("_pinned").isNull(), ""),
        (F.col("blob_sha1").isNull(), "missing"),
        (F.col("is_link"), "link"),
        (F.col("byte_length") != F.col("_n"), "other_length"),
        (F.col("blob_sha1") != F.col("_sha"), "other_content"),
    ])
    return every.select("path", problem.alias("problem")).where("problem <> ''")


def extraction_plan(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id, frame_index, frame_time_us, observation_id: what an outside tool is asked to extract.

    videos has video_id, sha256; frames the chosen ones (video_id, frame_index, frame_time_us).
    """
    from .frames import frame_observation_id

    named = frame_observation_id(F.col("video_id"), F.col("sha256"), F.col("frame_index"), F.col("frame_time_us"))
    return frames.join(videos.select("video_id", "sha256"), "video_id").select("video_id", "frame_index", "frame_time_us", named.alias("observation_id"))


def extraction_problems(plan: DataFrame, videos: DataFrame, found_videos: DataFrame, extracted: DataFrame) -> DataFrame:
    """video_id, problem of what the tool returned: the video's bytes changed, frames are missing, not asked for or repeated,
    or images of one video differ in size.

    videos and found_videos have video_id, sha256, byte_length, before and after;
    extracted observation_id, video_id, width, height.
    """
    after = found_videos.select("video_id", F.col("sha256").alias("_s"), F.col("byte_length").alias("_n"))
    changed = videos.join(after, "video_id", "left").where("_s is null or _s <> sha256 or _n <> byte_length")
    members = membership_problems(plan, extracted, ["video_id", "observation_id"]).select("video_id", F.concat(F.lit("frame_"), F.col("problem")).alias("problem")).distinct()
    sizes = extracted.groupBy("video_id").agg(F.min(F.struct("width", "height")).alias("a"), F.max(F.struct("width", "height")).alias("b")).where("a <> b or a.width < 1 or a.height < 1")
    return _union([changed.select("video_id", F.lit("other_video").alias("problem")), members, sizes.select("video_id", F.lit("dimensions").alias("problem"))])


def environment_problems(expected: DataFrame, found: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """environment, name, problem: packages must be there in exactly the reviewed version, and required features must be on.

    expected and found have environment, name, version; features environment,
    name, required, present: build flags and callables that a route needs.
    """
    joined = expected.join(found.select("environment", "name", F.col("version").alias("_v")), ["environment", "name"], "left")
    problem = _first([(F.col("_v").isNull(), "missing"), (F.col("_v") != F.col("version"), "other_version")])
    out = joined.select("environment", "name", problem.alias("problem")).where("problem is not null")
    if features is None:
        return out
    return out.unionByName(features.where("required and not coalesce(present, false)").select("environment", "name", F.lit("feature_off").alias("problem")))


def lineage_problems(derived: DataFrame, ancestry: DataFrame, sources: DataFrame) -> DataFrame:
    """artifact_id, problem of derived artifacts.

    derived has artifact_id, source_id, and the pairs of what must be kept as
    frame, source_frame, scale, source_scale; ancestry artifact_id, kind, id of the results; sources
    artifact_id, kind, id of all that the result was made from. An artifact has an id of its
    own, exactly the ancestry of its sources, and their frame and scale.
    """
    problem = _first([(F.col("artifact_id") == F.col("source_id"), "same_id"), (~F.col("frame").eqNullSafe(F.col("source_frame")), "other_frame"), (~F.col("scale").eqNullSafe(F.col("source_scale")), "other_scale")])
    own = derived.select("artifact_id", problem.alias("problem")).where("problem is not null")
    key = ["artifact_id", "kind", "id"]
    lacks = sources.select(*key).distinct().join(ancestry, key, "left_anti").select("artifact_id").distinct().withColumn("problem", F.lit("ancestor_missing"))
    more = ancestry.select(*key).distinct().join(sources, key, "left_anti").select("artifact_id").distinct().withColumn("problem", F.lit("ancestor_unknown"))
    return _union([own, lacks, more])


def semantics_digest(fields: DataFrame, *, scale_status: str = "unresolved", point_map_count: int = 0) -> DataFrame:
    """model_id, cameras, valid_count, digest: what a learned geometry says, as one hash over its cameras in order.

    fields has model_id, position, observation_id, projection_model, width,
    height, depth_width, depth_height, valid_count, all_valid_positive, one row a camera.
    Every camera needs a depth field.
    """
    assert_empty(fields.where("valid_count is null or depth_width is null").select("model_id", "observation_id"), "a camera has no depth field")
    names = ["all_valid_positive", "depth_height", "depth_width", "height", "observation_id", "projection_model", "valid_count", "width"]
    line = F.to_json(F.struct(*names))
    grouped = fields.groupBy("model_id").agg(F.count("*").alias("cameras"), F.sum("valid_count").alias("valid_count"), F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["line"]), ","), F.lit(f"]|{scale_status}|{point_map_count}"))
    return grouped.select("model_id", "cameras", "valid_count", F.sha2(text, 256).alias("digest"))


def geometry_problems(matches: DataFrame, geometry: DataFrame) -> DataFrame:
    """id1, id2, problem of two-view geometries.

    matches has id1 < id2 and raw_matches; geometry a, b (either way round),
    configuration, inliers. Every raw pair has one geometry and no other pair has
    any; inliers are at most the raw matches.
    """
    found = geometry.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "inliers")
    found = found.groupBy("id1", "id2").agg(F.count("*").alias("_n"), F.min("inliers").alias("_low"), F.max("inliers").alias("_high"))
    every = matches.select("id1", "id2", "raw_matches").join(found, ["id1", "id2"], "full")
    problem = _first([(F.col("_n").isNull(), "no_geometry"), (F.col("raw_matches").isNull(), "no_match"), (F.col("_n") > 1, "two_geometries"), ((F.col("_low") < 0) | (F.col("_high") > F.col("raw_matches")), "inliers")])
    return every.select("id1", "id2", problem.alias("problem")).where("problem is not null")


def publication_problems(plans: DataFrame, published: DataFrame) -> DataFrame:
    """key, problem: what is published has a plan of the same configuration, versions and parent; all have key, configuration, versions, parent."""
    want = plans.select("key", *(F.col(c).alias(f"_{c}") for c in ("configuration", "versions", "parent")), F.lit(True).alias("_planned"))
    joined = published.join(want, "key", "left")
    other = [(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"other_{c}") for c in ("configuration", "versions", "parent")]
    return joined.select("key", _first([(F.col("_planned").isNull(), "no_plan"), *other]).alias("problem")).where("problem is not null")


def refinement_problems(runs: DataFrame) -> DataFrame:
    """result_id, problem of refinements: a new id, no claim of a scale, an initialisation that is the
    source as it is read again, and a source that stayed as it was.

    runs has result_id, source_id, scale_status, initialization_sha256,
    canonical_sha256, source_sha256_before, source_sha256_after.
    """
    problem = _first([
        (F.col("result_id") == F.col("source_id"), "same_id"),
        (~F.col("scale_status").eqNullSafe(F.lit("UNRESOLVED")), "scale"),
        (~F.col("initialization_sha256").eqNullSafe(F.col("canonical_sha256")), "other_initialization"),
        (~F.col("source_sha256_before").eqNullSafe(F.col("source_sha256_after")), "source_changed"),
    ])
    return runs.select("result_id", problem.alias("problem")).where("problem is not null")


def difference_problems(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: rows of a model that are missing, unexpected, repeated or have another value in any other column."""
    values = [c for c in expected.columns if c not in keys]
    want = expected.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_want"))
    have = found.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*values)).alias("_b"))
    problem = _first([(F.col("_n").isNull(), "missing"), (F.col("_want").isNull(), "unexpected"), (F.col("_n") > 1, "repeated"), (~F.col("_a").eqNullSafe(F.col("_b")), "differs")])
    return want.join(have, keys, "full").select(*keys, problem.alias("problem")).where("problem is not null")


def named_camera_problems(cameras: DataFrame, names: DataFrame) -> DataFrame:
    """model_id, name, problem: a model's cameras (model_id, name) stand one to one for the observations (model_id, name, observation_id) that went in."""
    twice = names.groupBy("model_id", "observation_id").agg(F.count("*").alias("_n"), F.min("name").alias("name")).where("_n > 1")
    return membership_problems(names, cameras, ["model_id", "name"]).unionByName(twice.select("model_id", "name", F.lit("two_names").alias("problem")))


def pyramid_problems(levels: DataFrame, files: DataFrame) -> DataFrame:
    """observation_id, level, problem of decoded images: one file of packed RGB to each planned level, of exactly its size.

    levels has observation_id, level, width, height; files observation_id, level, byte_length.
    """
    have = files.groupBy("observation_id", "level").agg(F.count("*").alias("_n"), F.min("byte_length").alias("_bytes"))
    every = levels.select("observation_id", "level", (F.col("width").cast("bigint") * F.col("height") * 3).alias("_size")).join(have, ["observation_id", "level"], "full")
    problem = _first([(F.col("_n").isNull(), "missing"), (F.col("_size").isNull(), "unexpected"), (F.col("_n") > 1, "repeated"), (F.col("_bytes") != F.col("_size"), "size")])
    return every.select("observation_id", "level", problem.alias("problem")).where("problem is not null")


def retrieval_problems(images: DataFrame, read: DataFrame, descriptors: DataFrame) -> DataFrame:
    """observation_id, problem of a learned retrieval before its neighbours are joined.

    images has observation_id, sha256 as they were asked for, read the same as the model
    got them, descriptors observation_id, descriptor: one to each image, finite, of unit length.
    """
    norm = F.sqrt(F.aggregate("descriptor", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.coalesce(F.abs(norm - 1) <= 1e-4, F.lit(False)) & ~F.exists("descriptor", lambda v: v.isNull() | F.isnan(v))
    made = descriptors.groupBy("observation_id").agg(F.count("*").alias("_n"), F.bool_and(unit).alias("_unit"))
    every = images.select("observation_id", "sha256", F.lit(True).alias("_asked")).join(read.select("observation_id", F.col("sha256").alias("_sha")), "observation_id", "left").join(made, "observation_id", "full")
    problem = _first([
        (F.col("_asked").isNull(), "not_asked"), (~F.col("_sha").eqNullSafe(F.col("sha256")), "other_image"), (F.col("_n").isNull(), "no_descriptor"), (F.col("_n") > 1, "two_descriptors"), (~F.col("_unit"), "not_unit"),
    ])
    return every.select("observation_id", problem.alias("problem")).where("problem is not null")
