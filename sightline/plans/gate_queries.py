"""Queries over the gates, with faults planted by the rows' numbers, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gates
from ..scratch import scratch, shared_path
from ..sources import files
from .bindings import bound, duck


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(prefix: str, c: Column, width: int = 0) -> Column:
    n = c.cast("string")
    return F.concat(F.lit(prefix), F.lpad(n, width, "0") if width else n)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the entries of their customer's lists, in order of their keys."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.row_number().over(w).alias("position"))


ORDERS = "WITH RECURSIVE o AS (SELECT o_custkey AS owner, o_orderkey AS k, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders)"


def _order_sql(rows: str, owner: str, key: str, noun: str) -> str:
    """What order_problems says of rows with owner, position and a key."""
    return f"""SELECT DISTINCT {owner}, '{noun}_order' AS problem FROM (SELECT *, lag({key}) OVER (PARTITION BY {owner} ORDER BY position) AS b FROM {rows}) WHERE b > {key}
UNION ALL SELECT DISTINCT {owner}, 'repeated_{noun}' FROM (SELECT {owner} FROM {rows} GROUP BY {owner}, {key} HAVING count(*) > 1)"""


def d15_solver_inputs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    refs = _orders(spark, sf).select("owner", "position", F.when(k % 40 == 0, "image.other").otherwise("image.observation").alias("kind"), _text("i", F.when(k % 30 == 0, k % 100).otherwise(k), 9).alias("id"))
    return gates.reference_problems(refs, "image.observation")


def d16_feed_forward_inputs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    refs = _orders(spark, sf).select("owner", "position", F.when(k % 35 == 0, "media.video").otherwise("media.decoded_image_pyramid").alias("kind"), _text("i", F.when(k % 25 == 0, F.lit(1)).otherwise(k), 9).alias("id"))
    return gates.reference_problems(refs, "media.decoded_image_pyramid")


def d17_route_reasons(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf)
    decisions = _table(spark, sf, "customer").select(F.col("c_custkey").alias("decision_id"))
    code = F.when(F.col("k") % 50 == 0, "c00000").otherwise(_text("c", F.col("position"), 5))
    reasons = orders.select(F.col("owner").alias("decision_id"), "position", code.alias("code"), F.array(F.struct(F.lit("order").alias("kind"), _text("o", F.col("k")).alias("id"))).alias("refs"))
    evidence = orders.select(F.col("owner").alias("decision_id"), F.when(F.col("k") % 61 == 0, "line").otherwise("order").alias("kind"), _text("o", F.col("k")).alias("id"))
    return gates.route_reason_problems(decisions, reasons, evidence)


def d18_router_inputs(spark: SparkSession, sf: str) -> DataFrame:
    orders, k = _orders(spark, sf).withColumnRenamed("owner", "input_id"), F.col("k")
    gpus = F.col("c_custkey") % 3
    inputs = _table(spark, sf, "customer").select(F.col("c_custkey").alias("input_id"), gpus.alias("gpu_count"), F.when(F.col("c_custkey") % 30 == 0, 8).otherwise(gpus * 8).alias("vram_bytes"))
    profiles = orders.select("input_id", "position", _text("p", F.when(k % 45 == 0, F.lit(0)).otherwise(k), 9).alias("observation_id"))
    artifacts = orders.select("input_id", "position", _text("a", F.when(k % 20 == 0, F.lit(7)).otherwise(k), 9).alias("artifact_id"), F.when(k % 3 == 0, "x").otherwise("y").alias("kind"))
    return gates.router_input_problems(inputs, profiles, artifacts, orders.select("input_id", "position", F.col("status").alias("failure")))


def g5_route_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders are the nodes of a graph, joined in a row; some rows are closed, some edges lead nowhere, some lists turned round."""
    orders = scratch(_orders(spark, sf).withColumnRenamed("owner", "graph_id"), "route-orders")
    graphs = _table(spark, sf, "customer").select(F.col("c_custkey").alias("graph_id"))
    last = F.max("position").over(Window.partitionBy("graph_id"))
    g, node = F.col("graph_id"), _text("n", F.col("position"), 5)
    turned = F.when(g % 20 == 0, -F.col("position")).otherwise(F.col("position"))
    nodes = orders.select("graph_id", turned.alias("position"), node.alias("node"))
    to = F.when(F.col("position") < last, _text("n", F.col("position") + 1, 5)).when((g % 10 == 0) & (last > 1), "n00001").when(g % 15 == 1, "n99999")
    edges = orders.select("graph_id", "position", node.alias("source"), to.alias("target")).where("target is not null")
    return gates.route_graph_problems(graphs, nodes, edges)


def d14_source_photometry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    sha = F.sha2(F.concat_ws("\n", k, "p_name"), 256)  # parts may share a name, images of two parts are never the same bytes
    part = _table(spark, sf, "part")
    images = part.select(_text("i", k).alias("observation_id"), sha.alias("sha256"), (k % 40 + 10).alias("width"), (k % 30 + 10).alias("height"))
    assessments = part.select(
        _text("i", F.when(k % 19 == 0, -k).when(k % 31 == 0, k + 1).otherwise(k)).alias("observation_id"), F.when(k % 7 == 0, "UNRESOLVED").otherwise("COMPATIBLE").alias("compatibility_status"), F.when(k % 11 == 0, "REJECTED").otherwise("READY").alias("color_status"), F.lit("READY").alias("normalization_status"),
        F.when(k % 13 == 0, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("source_sha256"), F.lit("image").alias("source_kind"), F.when(k % 17 == 0, "rotated").otherwise("source_pixels").alias("orientation"), F.lit("rgb8_packed").alias("pixel_layout"), F.lit("srgb_full_rgb8").alias("decoded_encoding"),
        F.lit(0).alias("level"), (k % 40 + 10 + F.when(k % 23 == 0, 1).otherwise(0)).alias("width"), (k % 30 + 10).alias("height"), F.when(k % 29 == 0, 0.5).otherwise(0.0).alias("exposure_ev"), F.array(*[F.lit(1.0)] * 3).alias("gains"),
    )
    return gates.source_photometry_problems(images, assessments)


def x23_preflight(spark: SparkSession, sf: str) -> DataFrame:
    k, sha = F.col("p_partkey"), F.sha2("p_name", 256)
    part = _table(spark, sf, "part")
    seen, n = _text("i", k), F.octet_length("p_name").cast("bigint")
    name = _text("img", k)
    ended = F.when(k % 19 == 0, F.concat(F.lit("a/"), name, F.lit(".png"))).when(k % 22 == 0, F.concat(name, F.lit(".jpg"))).otherwise(F.concat(name, F.lit(".PNG")))
    requested = part.select(k.alias("position"), F.when(k % 37 == 0, _text("q", k)).otherwise(seen).alias("observation_id"))
    images = part.select(F.when(k % 23 == 0, -k).otherwise(k).alias("position"), seen.alias("observation_id"), ended.alias("name"), sha.alias("sha256"), n.alias("byte_length"))
    cameras = part.select(F.when(k % 41 == 0, _text("r", k)).otherwise(seen).alias("observation_id"), F.when(k % 7 == 0, "fisheye").otherwise("pinhole").alias("model"), F.array(F.when(k % 11 == 0, 0.0).otherwise(500.0), F.lit(500.0), F.lit(32.0), F.lit(32.0)).alias("parameters"), (k % 40 + 10).alias("width"), (k % 30 + 10).alias("height"))
    read = part.select(F.when(k % 13 == 0, F.concat(F.lit("gone/"), ended)).otherwise(ended).alias("name"), F.when(k % 17 == 0, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("sha256"), n.alias("byte_length"), (k % 40 + 10).alias("width"), (k % 30 + 10 + F.when(k % 29 == 0, 1).otherwise(0)).alias("height"))
    return gates.preflight_problems(requested, images, cameras, read, registered_images=1, sparse_points=0)


def io29_staged(spark: SparkSession, sf: str) -> DataFrame:
    k, html = F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8")
    path = F.concat(F.lit("images/"), _text("p", k))
    pages = _table(spark, sf, "pages")
    n, sha = F.octet_length(html).cast("bigint"), F.sha2(html, 256)
    folder = shared_path(spark, "staged")
    files.write_files(pages.select(F.when(k % 13 == 0, F.concat(F.lit("other/"), _text("p", k))).otherwise(path).alias("path"), F.when(k % 17 == 0, F.concat(html, F.encode(F.lit("x"), "utf-8"))).otherwise(html).alias("content")), folder)
    manifest = pages.select(path.alias("path"), F.upper(sha).alias("sha256"), n.alias("byte_length"))
    originals = pages.select(F.when(k % 23 == 0, F.concat(path, F.lit(".bak"))).otherwise(path).alias("path"), sha.alias("sha256"), (n + F.when(k % 29 == 0, 1).otherwise(0)).alias("byte_length"))
    return gates.staged_problems(manifest, files.relative_to(files.content_hashes(spark, folder), folder), originals)


def x26_source_pins(spark: SparkSession, sf: str) -> DataFrame:
    k, body = F.col("p_partkey"), F.encode("p_name", "utf-8")
    part = _table(spark, sf, "part")
    path = F.concat(F.when(k % 3 == 0, "package/").otherwise("docs/"), _text("m", k), F.lit(".py"))
    pins = part.select(F.when(k % 10 == 0, F.concat(F.lit("old/"), path)).otherwise(path).alias("path"), F.octet_length(body).cast("bigint").alias("byte_length"), files.git_blob_sha1(body).alias("blob_sha1"))
    now = F.when(k % 11 == 0, F.encode(F.lit("changed"), "utf-8")).otherwise(body)
    found = part.select(path.alias("path"), F.octet_length(body).cast("bigint").alias("byte_length"), files.git_blob_sha1(now).alias("blob_sha1"), (k % 13 == 0).alias("is_link"))
    return gates.source_pin_problems(pins, found, closed=("^package/",))


def io11_extraction(spark: SparkSession, sf: str) -> DataFrame:
    frames = scratch(bound(spark, sf, "frames").select("video_id", "frame_index", "frame_time_us"), "frames")
    number = F.substring("video_id", 2, 9).cast("bigint")
    videos = scratch(frames.select("video_id").distinct().select("video_id", F.sha2("video_id", 256).alias("sha256"), number.alias("byte_length")), "videos")
    plan = scratch(gates.extraction_plan(videos, frames), "extraction-plan")
    after = videos.select("video_id", F.when(number % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"), "byte_length")
    index, other = F.col("frame_index"), number % 5 == 0
    got = plan.select(F.when(other & (index == 1), F.concat("observation_id", F.lit("x"))).otherwise(F.col("observation_id")).alias("observation_id"), "video_id", F.when((number % 7 == 0) & (index == 0), 65).otherwise(64).alias("width"), F.lit(48).alias("height"))
    return gates.extraction_problems(plan, videos, after, got)


def x11_environments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    nation = _table(spark, sf, "nation").withColumn("environment", F.col("n_regionkey"))
    expected = nation.select("environment", F.col("n_name").alias("name"), _text("4.", n).alias("version"))
    found = nation.select("environment", F.when(n % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), _text("4.", F.when(n % 5 == 0, n + 1).otherwise(n)).alias("version"))
    features = nation.select("environment", F.lower("n_name").alias("name"), (n % 3 == 0).alias("required"), F.when(n % 4 != 0, n % 2 == 0).alias("present"))
    return gates.environment_problems(expected, found, features)


def x20_lineage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    derived = _table(spark, sf, "part").select(k.alias("artifact_id"), F.when(k % 17 == 0, k).otherwise(-k).alias("source_id"), F.col("p_brand").alias("frame"), F.when(k % 13 == 0, F.lit("f")).otherwise(F.col("p_brand")).alias("source_frame"), F.lit(None).cast("string").alias("scale"), F.when(k % 19 == 0, "metric").alias("source_scale"))
    lines = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("artifact_id"), F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id"))
    claimed = lines.select("artifact_id", "kind", F.when((F.col("artifact_id") % 11 == 0) & (F.col("id") % 2 == 0), -F.col("id")).otherwise(F.col("id")).alias("id"))
    return gates.lineage_problems(derived, claimed, lines)


def a14_semantics_digest(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.contracts import geometry_semantics

    camera = F.substring("camera", 2, 9).cast("bigint")
    fields = geometry_semantics(bound(spark, sf, "pixels").withColumn("depth", F.col("depth") - 2))
    fields = fields.select((camera % 50).alias("model_id"), camera.alias("position"), F.col("camera").alias("observation_id"), F.lit("pinhole").alias("projection_model"), F.lit(7).alias("width"), F.lit(1).alias("height"), F.lit(7).alias("depth_width"), F.lit(1).alias("depth_height"), "valid_count", F.col("all_valid_positive"))
    return gates.semantics_digest(fields)


def x3_geometry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    part, one, two = _table(spark, sf, "part"), _text("a", k, 8), _text("b", k, 8)
    matches = part.select(one.alias("id1"), two.alias("id2"), (k % 50 + 20).alias("raw_matches"))
    turned, inliers = k % 3 == 0, F.when(k % 11 == 0, 90).otherwise(k % 20)
    geometry = part.select(F.when(turned, two).otherwise(one).alias("a"), F.when(k % 13 == 0, F.lit("zz")).when(turned, one).otherwise(two).alias("b"), inliers.alias("inliers"))
    again = part.where(k % 17 == 0).select(one.alias("a"), two.alias("b"), inliers.alias("inliers"))  # a second geometry of some
    return gates.geometry_problems(matches, geometry.unionByName(again))


def x14_publications(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = _table(spark, sf, "orders")
    plans = orders.select(_text("k", k).alias("key"), F.col("o_orderpriority").alias("configuration"), F.lit("4.2").alias("versions"), _text("p", F.col("o_custkey")).alias("parent"))
    published = orders.select(_text("k", F.when(k % 31 == 0, -1 - k).otherwise(k)).alias("key"), F.when(k % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("configuration"), F.when(k % 11 == 0, "4.3").otherwise("4.2").alias("versions"), _text("p", F.col("o_custkey") + F.when(k % 13 == 0, 1).otherwise(0)).alias("parent"))
    return gates.publication_problems(plans, published)


def x8_refinements(spark: SparkSession, sf: str) -> DataFrame:
    k, sha = F.col("p_partkey"), F.sha2("p_name", 256)
    other = lambda n: F.when(k % n == 0, F.sha2(F.lit("x"), 256)).otherwise(sha)
    runs = _table(spark, sf, "part").select(k.alias("result_id"), F.when(k % 17 == 0, k).otherwise(-1 - k).alias("source_id"), F.when(k % 7 == 0, "METRIC").when(k % 41 != 0, "UNRESOLVED").alias("scale_status"), sha.alias("initialization_sha256"), other(11).alias("canonical_sha256"), sha.alias("source_sha256_before"), other(13).alias("source_sha256_after"))
    return gates.refinement_problems(runs)


def x24_model_differences(spark: SparkSession, sf: str) -> DataFrame:
    """A model's cameras against the same, read again with some values, names and repeats changed."""
    k = F.col("p_partkey")
    part = _table(spark, sf, "part")
    expected = part.select(k.alias("camera_id"), F.col("p_size").alias("width"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("focal"), F.array(F.col("p_size"), F.lit(1)).alias("dims"))
    found = part.select(F.when(k % 19 == 0, -1 - k).otherwise(k).alias("camera_id"), (F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).alias("width"), F.when((k % 5 != 0) | (k % 11 == 0), F.col("p_retailprice")).alias("focal"), F.array(F.col("p_size"), F.lit(1)).alias("dims"))
    return gates.difference_problems(expected, found.unionByName(found.where("camera_id > 0 and camera_id % 23 = 0")), ["camera_id"])


def x7_named_cameras(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    orders = _orders(spark, sf)
    names = orders.select(F.col("owner").alias("model_id"), _text("f", k).alias("name"), _text("o", F.when(k % 29 == 0, F.lit(0)).otherwise(k)).alias("observation_id"))
    cameras = orders.select(F.col("owner").alias("model_id"), _text("f", F.when(k % 17 == 0, -1 - k).otherwise(k)).alias("name"))
    return gates.named_camera_problems(cameras, names)


def io13_pyramid_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    images = _table(spark, sf, "part").select(k.alias("observation_id"), (k % 40 + 10).alias("width"), (k % 30 + 10).alias("height"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
    levels = images.select("observation_id", "level", F.expr("greatest(1, shiftright(width, level))").alias("width"), F.expr("greatest(1, shiftright(height, level))").alias("height"))
    g = F.col("observation_id")
    made = levels.select(g, F.when((g % 13 == 0) & (F.col("level") == 1), 7).otherwise(F.col("level")).alias("level"), (F.col("width") * F.col("height") * 3 + F.when((g % 7 == 0) & (F.col("level") == 0), 1).otherwise(0)).cast("bigint").alias("byte_length"))
    return gates.pyramid_problems(levels, made)


def j4_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("observation_id", 2, 9).cast("bigint")
    rows = bound(spark, sf, "descriptors")
    images = rows.select(F.when(n % 31 == 0, F.concat("observation_id", F.lit("z"))).otherwise(F.col("observation_id")).alias("observation_id"), F.sha2("observation_id", 256).alias("sha256"))
    read = rows.select("observation_id", F.sha2(F.when(n % 17 == 0, F.lit("x")).otherwise(F.col("observation_id")), 256).alias("sha256"))
    made = rows.select("observation_id", F.when(n % 13 == 0, F.transform("descriptor", lambda v: v * 2)).otherwise(F.col("descriptor")).alias("descriptor"))
    return gates.retrieval_problems(images, read, made)


def io27_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Results of fixtures, each as a file of canonical JSON."""
    n = F.col("n_nationkey")
    rows = _table(spark, sf, "nation").select(F.concat(F.lit("results/"), n.cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("fixture."), n.cast("string")).alias("fixture_id"), F.struct(n.alias("n")).alias("metrics"), F.lit("own").alias("runner"), F.when(n % 4 == 0, "failed").otherwise("passed").alias("status"))).alias("json"))
    return files.write_files(rows.select("path", F.encode(F.concat("json", F.lit("\n")), "utf-8").alias("content")), shared_path(spark, "results"))


QUERIES = {
    "d15_solver_inputs": d15_solver_inputs, "d16_feed_forward_inputs": d16_feed_forward_inputs, "d17_route_reasons": d17_route_reasons, "d18_router_inputs": d18_router_inputs, "g5_route_graphs": g5_route_graphs, "d14_source_photometry": d14_source_photometry,
    "x23_preflight": x23_preflight, "io29_staged": io29_staged, "x26_source_pins": x26_source_pins, "io11_extraction": io11_extraction, "x11_environments": x11_environments, "x20_lineage": x20_lineage, "a14_semantics_digest": a14_semantics_digest,
    "x3_geometry": x3_geometry, "x14_publications": x14_publications, "x8_refinements": x8_refinements, "x24_model_differences": x24_model_differences, "x7_named_cameras": x7_named_cameras, "io13_pyramid_files": io13_pyramid_files,
    "j4_retrieval": j4_retrieval, "io27_result_files": io27_result_files,
}

ORACLES = {
    "d15_solver_inputs": f"""{ORDERS}, r AS (SELECT owner, position, CASE WHEN k % 40 = 0 THEN 'image.other' ELSE 'image.observation' END AS kind, 'i' || lpad(CASE WHEN k % 30 = 0 THEN k % 100 ELSE k END::VARCHAR, 9, '0') AS id FROM o), q AS (SELECT *, kind || ':' || id AS key FROM r)
SELECT DISTINCT owner, 'other_kind' AS problem FROM q WHERE kind <> 'image.observation' UNION ALL {_order_sql('q', 'owner', 'key', 'input')}""",
    "d16_feed_forward_inputs": f"""{ORDERS}, r AS (SELECT owner, position, CASE WHEN k % 35 = 0 THEN 'media.video' ELSE 'media.decoded_image_pyramid' END AS kind, 'i' || lpad(CASE WHEN k % 25 = 0 THEN 1 ELSE k END::VARCHAR, 9, '0') AS id FROM o), q AS (SELECT *, kind || ':' || id AS key FROM r)
SELECT DISTINCT owner, 'other_kind' AS problem FROM q WHERE kind = 'media.video' UNION ALL {_order_sql('q', 'owner', 'key', 'input')}""",
    "d17_route_reasons": f"""{ORDERS}, r AS (SELECT owner AS decision_id, position, CASE WHEN k % 50 = 0 THEN 'c00000' ELSE 'c' || lpad(position::VARCHAR, 5, '0') END AS code FROM o)
SELECT c_custkey AS decision_id, 'no_reason' AS problem FROM customer ANTI JOIN o ON owner = c_custkey UNION ALL SELECT DISTINCT owner, 'unknown_evidence' FROM o WHERE k % 61 = 0 UNION ALL {_order_sql('r', 'decision_id', 'code', 'code')}""",
    "d18_router_inputs": f"""{ORDERS}, p AS (SELECT owner AS input_id, position, CASE WHEN k % 45 = 0 THEN 0 ELSE k END AS key FROM o),
a AS (SELECT owner AS input_id, position, CASE WHEN k % 20 = 0 THEN 7 ELSE k END AS id, CASE WHEN k % 3 = 0 THEN 'x' ELSE 'y' END AS kind, lpad(id::VARCHAR, 9, '0') || kind AS key FROM o), f AS (SELECT owner AS input_id, position, status AS key FROM o)
SELECT c_custkey AS input_id, 'no_profile' AS problem FROM customer ANTI JOIN o ON owner = c_custkey UNION ALL SELECT c_custkey, 'budget' FROM customer WHERE c_custkey % 30 = 0
UNION ALL SELECT DISTINCT input_id, 'two_kinds' FROM (SELECT input_id FROM a GROUP BY input_id, id HAVING count(DISTINCT kind) > 1)
UNION ALL {_order_sql('p', 'input_id', 'key', 'profile')} UNION ALL {_order_sql('a', 'input_id', 'key', 'artifact')} UNION ALL {_order_sql('f', 'input_id', 'key', 'failure')}""",
    "g5_route_graphs": f"""{ORDERS}, g AS (SELECT owner AS graph_id, max(position) AS n FROM o GROUP BY 1)
SELECT c_custkey AS graph_id, 'no_node' AS problem FROM customer ANTI JOIN o ON owner = c_custkey UNION ALL SELECT graph_id, 'unknown_end' FROM g WHERE graph_id % 15 = 1 AND NOT (graph_id % 10 = 0 AND n > 1)
UNION ALL SELECT graph_id, 'node_order' FROM g WHERE graph_id % 20 = 0 AND n > 1 UNION ALL SELECT graph_id, 'cycle' FROM g WHERE graph_id % 10 = 0 AND n > 1""",
    "d14_source_photometry": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 19 = 0 THEN -p_partkey WHEN p_partkey % 31 = 0 THEN p_partkey + 1 ELSE p_partkey END AS t FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM p), j AS (SELECT coalesce(i.k, c.t) AS id, i.k AS image, c.k AS k, c.n AS n FROM p i FULL JOIN c ON c.t = i.k)
SELECT DISTINCT 'i' || id AS observation_id, CASE WHEN n IS NULL THEN 'no_assessment' WHEN image IS NULL THEN 'no_image' WHEN n > 1 THEN 'two_assessments' WHEN k % 7 = 0 THEN 'not_compatible' WHEN k % 11 = 0 THEN 'not_ready' WHEN k % 13 = 0 OR k <> image THEN 'other_source'
  WHEN k % 17 = 0 THEN 'other_pixels' WHEN k % 23 = 0 THEN 'resized' WHEN k % 29 = 0 THEN 'adjusted' END AS problem FROM j WHERE problem IS NOT NULL""",
    "x23_preflight": """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'i' || k AS observation_id, CASE WHEN k % 37 = 0 THEN 'not_requested' WHEN k % 41 = 0 THEN 'no_camera' WHEN k % 23 = 0 THEN 'order' WHEN k % 19 = 0 OR k % 22 = 0 THEN 'name' WHEN k % 7 = 0 THEN 'not_pinhole' WHEN k % 11 = 0 THEN 'focal_length' WHEN k % 13 = 0 THEN 'missing_file'
  WHEN k % 17 = 0 THEN 'other_content' WHEN k % 29 = 0 THEN 'other_dimensions' END AS problem FROM p WHERE problem IS NOT NULL
UNION ALL SELECT 'q' || k, 'no_image' FROM p WHERE k % 37 = 0 UNION ALL SELECT 'r' || k, 'not_requested' FROM p WHERE k % 41 = 0 UNION ALL SELECT NULL, 'registered_images' UNION ALL SELECT NULL, 'no_points'""",
    "io29_staged": """SELECT 'images/p' || page_id AS path, CASE WHEN page_id % 13 = 0 THEN 'missing' WHEN page_id % 17 = 0 THEN 'other_copy' WHEN page_id % 23 = 0 THEN 'original_missing' WHEN page_id % 29 = 0 THEN 'other_original' END AS problem FROM pages WHERE problem IS NOT NULL
UNION ALL SELECT 'other/p' || page_id, 'unexpected' FROM pages WHERE page_id % 13 = 0""",
    "x26_source_pins": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'package/' ELSE 'docs/' END || 'm' || p_partkey || '.py' AS path FROM part)
SELECT path, CASE WHEN k % 10 = 0 THEN CASE WHEN k % 3 = 0 THEN 'unlisted' END WHEN k % 13 = 0 THEN 'link' WHEN k % 11 = 0 THEN 'other_content' END AS problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT 'old/' || path, 'missing' FROM p WHERE k % 10 = 0""",
    "io11_extraction": f"""{duck('frames')}, v AS (SELECT video_id, substr(video_id, 2)::BIGINT AS n, count(*) AS frames FROM frames GROUP BY 1)
SELECT video_id, 'other_video' AS problem FROM v WHERE n % 9 = 0 UNION ALL SELECT video_id, 'frame_missing' FROM v WHERE n % 5 = 0 AND frames > 1 UNION ALL SELECT video_id, 'frame_unexpected' FROM v WHERE n % 5 = 0 AND frames > 1 UNION ALL SELECT video_id, 'dimensions' FROM v WHERE n % 7 = 0 AND frames > 1""",
    "x11_environments": """SELECT n_regionkey AS environment, n_name AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'missing' ELSE 'other_version' END AS problem FROM nation WHERE n_nationkey % 7 = 0 OR n_nationkey % 5 = 0
UNION ALL SELECT n_regionkey, lower(n_name), 'feature_off' FROM nation WHERE n_nationkey % 3 = 0 AND (n_nationkey % 4 = 0 OR n_nationkey % 2 = 1)""",
    "x20_lineage": """WITH l AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem)
SELECT p_partkey AS artifact_id, CASE WHEN p_partkey % 17 = 0 THEN 'same_id' WHEN p_partkey % 13 = 0 THEN 'other_frame' ELSE 'other_scale' END AS problem FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 13 = 0 OR p_partkey % 19 = 0
UNION ALL SELECT DISTINCT k, 'ancestor_missing' FROM l WHERE k % 11 = 0 AND s % 2 = 0 UNION ALL SELECT DISTINCT k, 'ancestor_unknown' FROM l WHERE k % 11 = 0 AND s % 2 = 0""",
    "a14_semantics_digest": f"""{duck('pixels')}, f AS (SELECT camera, substr(camera, 2)::BIGINT AS k, count(*) FILTER (valid) AS n, coalesce(bool_and(depth - 2 > 0) FILTER (valid), true) AS ok FROM pixels GROUP BY 1),
j AS (SELECT k, n, '{{"all_valid_positive":' || CASE WHEN ok THEN 'true' ELSE 'false' END || ',"depth_height":1,"depth_width":7,"height":1,"observation_id":"' || camera || '","projection_model":"pinhole","valid_count":' || n || ',"width":7}}' AS line FROM f)
SELECT k % 50 AS model_id, count(*) AS cameras, sum(n)::BIGINT AS valid_count, sha256('[' || string_agg(line, ',' ORDER BY k) || ']|unresolved|0') AS digest FROM j GROUP BY 1""",
    "x3_geometry": """WITH p AS (SELECT p_partkey AS k, 'a' || lpad(p_partkey::VARCHAR, 8, '0') AS one, 'b' || lpad(p_partkey::VARCHAR, 8, '0') AS two FROM part),
g AS (SELECT k, one AS id1, CASE WHEN k % 13 = 0 THEN NULL ELSE two END AS id2 FROM p UNION ALL SELECT k, one, two FROM p WHERE k % 17 = 0), c AS (SELECT k, count(*) AS n FROM g WHERE id2 IS NOT NULL GROUP BY 1)
SELECT one AS id1, two AS id2, CASE WHEN n IS NULL THEN 'no_geometry' WHEN n > 1 THEN 'two_geometries' WHEN p.k % 11 = 0 AND 90 > p.k % 50 + 20 THEN 'inliers' END AS problem FROM p LEFT JOIN c USING (k) WHERE problem IS NOT NULL
UNION ALL SELECT CASE WHEN k % 3 = 0 THEN two ELSE one END, 'zz', 'no_match' FROM p WHERE k % 13 = 0""",
    "x14_publications": """SELECT 'k' || CASE WHEN o_orderkey % 31 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 31 = 0 THEN 'no_plan' WHEN o_orderkey % 7 = 0 THEN 'other_configuration' WHEN o_orderkey % 11 = 0 THEN 'other_versions' WHEN o_orderkey % 13 = 0 THEN 'other_parent' END AS problem FROM orders WHERE problem IS NOT NULL""",
    "x8_refinements": """SELECT p_partkey AS result_id, CASE WHEN p_partkey % 17 = 0 THEN 'same_id' WHEN p_partkey % 7 = 0 OR p_partkey % 41 = 0 THEN 'scale' WHEN p_partkey % 11 = 0 THEN 'other_initialization' WHEN p_partkey % 13 = 0 THEN 'source_changed' END AS problem FROM part WHERE problem IS NOT NULL""",
    "x24_model_differences": """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS camera_id, CASE WHEN k % 19 = 0 THEN 'missing' WHEN k > 0 AND k % 23 = 0 THEN 'repeated' WHEN k % 7 = 0 OR (k % 5 = 0 AND k % 11 = 0) THEN 'differs' END AS problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT -1 - k, 'unexpected' FROM p WHERE k % 19 = 0""",
    "x7_named_cameras": f"""{ORDERS}
SELECT owner AS model_id, 'f' || k AS name, 'missing' AS problem FROM o WHERE k % 17 = 0 UNION ALL SELECT owner, 'f' || (-1 - k), 'unexpected' FROM o WHERE k % 17 = 0
UNION ALL SELECT owner, min('f' || k), 'two_names' FROM o WHERE k % 29 = 0 GROUP BY 1 HAVING count(*) > 1""",
    "io13_pyramid_files": """SELECT p_partkey AS observation_id, 1 AS level, 'missing' AS problem FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey, 7, 'unexpected' FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey, 0, 'size' FROM part WHERE p_partkey % 7 = 0""",
    "j4_retrieval": f"""{duck('descriptors')}, d AS (SELECT observation_id AS o, substr(observation_id, 2)::BIGINT AS n FROM descriptors)
SELECT o AS observation_id, CASE WHEN n % 31 = 0 THEN 'not_asked' WHEN n % 17 = 0 THEN 'other_image' WHEN n % 13 = 0 THEN 'not_unit' END AS problem FROM d WHERE problem IS NOT NULL UNION ALL SELECT o || 'z', 'other_image' FROM d WHERE n % 31 = 0""",
    "io27_result_files": """WITH r AS (SELECT 'results/' || n_nationkey || '.json' AS path, '{"fixture_id":"fixture.' || n_nationkey || '","metrics":{"n":' || n_nationkey || '},"runner":"own","status":"' || CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'passed' END || '"}' || chr(10) AS c FROM nation)
SELECT path, sha256(c) AS sha256, octet_length(encode(c))::BIGINT AS byte_length FROM r""",
}
