"""Queries over metadata, decisions, identities and graphs, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, decisions, identity, metadata
from ..scratch import scratch, spread
from .bindings import bound, duck


def d1_metadata(spark: SparkSession, sf: str) -> DataFrame:
    found = metadata.interpret_metadata(bound(spark, sf, "raw_metadata"))
    return found.withColumns({c: F.round(c, 9) for c in ("latitude_deg", "longitude_deg")})


D1 = r"""
ex AS (SELECT observation_id, key, count(*) AS n, arg_min(value, position) AS value FROM raw_metadata WHERE namespace = 'EXIF' GROUP BY 1, 2),
k AS (
  SELECT observation_id, max(value) FILTER (key = 'GPS GPSLatitude') AS lat, upper(trim(max(value) FILTER (key = 'GPS GPSLatitudeRef'))) AS latr, max(value) FILTER (key = 'GPS GPSLongitude') AS lon,
         upper(trim(max(value) FILTER (key = 'GPS GPSLongitudeRef'))) AS lonr, max(value) FILTER (key = 'GPS GPSMapDatum') AS datum, max(value) FILTER (key = 'EXIF DateTimeOriginal') AS tm, max(value) FILTER (key = 'EXIF OffsetTimeOriginal') AS off,
         bool_or(key LIKE 'GPS %') AS any_gps, bool_or(key LIKE 'GPS %' AND n > 1) AS gps2, bool_or(key LIKE 'EXIF %') AS any_time, bool_or(key LIKE 'EXIF %' AND n > 1) AS time2
  FROM ex GROUP BY 1),
o AS (SELECT DISTINCT observation_id FROM raw_metadata),
p AS (SELECT o.observation_id, k.* EXCLUDE (observation_id),
        regexp_matches(lat, '^\[[0-9]+, [0-9]+, [0-9]+(/2)?\]$') AS lat_ok, regexp_matches(lon, '^\[[0-9]+, [0-9]+, [0-9]+(/2)?\]$') AS lon_ok,
        [x::DOUBLE FOR x IN regexp_extract_all(lat, '[0-9]+')] AS a, [x::DOUBLE FOR x IN regexp_extract_all(lon, '[0-9]+')] AS b,
        try_strptime(tm, '%Y:%m:%d %H:%M:%S') AS local, [x::INT FOR x IN regexp_extract_all(off, '[0-9]+')] AS oh
      FROM o LEFT JOIN k USING (observation_id)),
q AS (SELECT *, CASE WHEN lat_ok AND a[2] < 60 AND a[3] / coalesce(a[4], 1) < 60 THEN (a[1] + a[2] / 60 + a[3] / coalesce(a[4], 1) / 3600) * CASE WHEN latr = 'S' THEN -1 ELSE 1 END END AS la,
        CASE WHEN lon_ok AND b[2] < 60 AND b[3] / coalesce(b[4], 1) < 60 THEN (b[1] + b[2] / 60 + b[3] / coalesce(b[4], 1) / 3600) * CASE WHEN lonr = 'W' THEN -1 ELSE 1 END END AS lo,
        CASE WHEN oh[1] < 24 AND oh[2] < 60 THEN (oh[1] * 3600 + oh[2] * 60) * CASE WHEN off LIKE '-%' THEN -1 ELSE 1 END END AS os FROM p),
r AS (SELECT *, CASE WHEN any_gps IS NULL OR NOT any_gps THEN 'ABSENT' WHEN gps2 THEN 'INVALID' WHEN lat IS NULL OR latr IS NULL OR lon IS NULL OR lonr IS NULL THEN 'INCOMPLETE'
        WHEN coalesce(latr IN ('N', 'S') AND lonr IN ('E', 'W') AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180, false) THEN 'RESOLVED' ELSE 'INVALID' END AS gps_status,
        CASE WHEN any_time IS NULL OR NOT any_time THEN 'ABSENT' WHEN time2 OR local IS NULL THEN 'INVALID' WHEN off IS NULL THEN 'LOCAL_AMBIGUOUS' WHEN os IS NULL THEN 'INVALID' ELSE 'RESOLVED' END AS time_status FROM q),
interpreted AS (
  SELECT observation_id, gps_status, CASE WHEN gps_status = 'RESOLVED' THEN round(la, 9) END AS latitude_deg, CASE WHEN gps_status = 'RESOLVED' THEN round(lo, 9) END AS longitude_deg,
         CASE WHEN gps_status IN ('RESOLVED', 'INCOMPLETE') THEN datum END AS map_datum, time_status, CASE WHEN time_status = 'RESOLVED' THEN epoch_us(local) - os::BIGINT * 1000000 END AS instant_us FROM r)"""


def j7_capture_time_sync(spark: SparkSession, sf: str) -> DataFrame:
    times = metadata.interpret_metadata(bound(spark, sf, "raw_metadata"))
    n = F.substring("observation_id", 2, 9).cast("bigint")
    pairs = times.select(F.col("observation_id").alias("id1"), F.concat(F.lit("e"), F.lpad((n + 2).cast("string"), 8, "0")).alias("id2"))
    return metadata.capture_time_sync(pairs, times)


def d4_input_classes(spark: SparkSession, sf: str) -> DataFrame:
    raw = bound(spark, sf, "raw_metadata")
    n = F.substring("observation_id", 2, 9).cast("bigint")
    grouped = spread(raw, raw.count(), "observation_id").groupBy("observation_id").agg(F.collect_list(F.struct("namespace", "key", "value")).alias("entries"))
    rows = grouped.select("observation_id", F.when(n % 4 == 0, "image").otherwise("video").alias("kind"), F.when(n % 3 == 0, 200).otherwise(160).alias("width"), F.lit(100).alias("height"), "entries")
    found = metadata.input_classes(rows)
    return found.select("observation_id", "class_order", "input_class", "evidence_kind", F.array_join("evidence_keys", ",").alias("evidence_keys"))


def j6_same_video_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame with those one, two, four, ... sixty-four places on in its video."""
    frames = bound(spark, sf, "frames")
    ahead = frames.select("video_id", F.col("frame_index").alias("index1"), F.explode(F.array(*(F.lit(1 << k).cast("bigint") for k in range(7)))).alias("step"))
    return metadata.same_video_sync(frames, ahead.select("video_id", "index1", (F.col("index1") + F.col("step")).alias("index2")))


def j6_video_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.video_offsets(bound(spark, sf, "frames").select("video_id", "frame_index", "frame_time_us"))


def d10_visual_sync(spark: SparkSession, sf: str) -> DataFrame:
    rows = bound(spark, sf, "frames").select("event_id", (F.col("event_id") % 5 != 0).alias("is_unique"), (F.col("event_id") % 9).alias("support"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 700).alias("residual_us"), (F.col("event_id") * 3 - 900).alias("offset_us"))
    return metadata.visual_event_sync(rows, 3, 500).select("event_id", "status", "offset_us")


def sc12_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return audio.correlate(bound(spark, sf, "samples"), 4, 8)


CORRELATIONS = """
lags AS (SELECT unnest(range(-4, 5))::INT AS lag),
s AS (SELECT a.pair_id, lag, count(*) AS overlap, sum(a.first::BIGINT) AS sx, sum(b.second::BIGINT) AS sy, sum(a.first::BIGINT * b.second) AS sxy, sum(a.first::BIGINT * a.first) AS sxx, sum(b.second::BIGINT * b.second) AS syy
      FROM samples a CROSS JOIN lags JOIN samples b ON a.pair_id = b.pair_id AND b.n = a.n + lag GROUP BY 1, 2),
c AS (SELECT pair_id, lag, overlap, (overlap * sxy - sx * sy)::DOUBLE AS cov, (overlap * sxx - sx * sx)::DOUBLE AS vx, (overlap * syy - sy * sy)::DOUBLE AS vy FROM s WHERE overlap >= 8),
correlations AS (SELECT pair_id, lag, overlap, round(greatest(-1.0, least(1.0, cov / sqrt(vx * vy))), 9) AS correlation FROM c WHERE vx > 0 AND vy > 0)"""


def w6_best_lag(spark: SparkSession, sf: str) -> DataFrame:
    samples = bound(spark, sf, "samples")
    return audio.best_lag(samples, audio.correlate(samples, 4, 8), 0.3, 8000)


def _policy_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    return tuple(bound(spark, sf, x) for x in ("subject_metrics", "subject_failures", "metric_rules", "failure_rules"))


def d8_quality_policy(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.evaluate_policy(*_policy_inputs(spark, sf))


def d8_policy_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.policy_reasons(*_policy_inputs(spark, sf))


REASONS = """
subjects AS (SELECT subject FROM subject_metrics UNION SELECT subject FROM subject_failures),
reasons AS (
  SELECT s.subject, 'missing_required_metric' AS kind, r.metric, NULL::VARCHAR AS failure, 'unresolved' AS decision FROM subjects s CROSS JOIN metric_rules r LEFT JOIN subject_metrics m ON m.subject = s.subject AND m.metric = r.metric WHERE r.required AND m.subject IS NULL
  UNION ALL SELECT m.subject, 'unknown_metric', m.metric, NULL, 'unresolved' FROM subject_metrics m LEFT JOIN metric_rules r USING (metric) WHERE r.metric IS NULL
  UNION ALL SELECT m.subject, 'metric_direction_mismatch', m.metric, NULL, 'unresolved' FROM subject_metrics m JOIN metric_rules r USING (metric) WHERE m.direction <> r.direction
  UNION ALL SELECT m.subject, 'metric_threshold_violation', m.metric, NULL, r.decision FROM subject_metrics m JOIN metric_rules r USING (metric)
    WHERE m.direction = r.direction AND ((r.direction = 'higher_is_better' AND value < threshold) OR (r.direction = 'lower_is_better' AND value > threshold))
  UNION ALL SELECT f.subject, CASE WHEN r.failure IS NULL THEN 'unmapped_failure' ELSE 'mapped_failure' END, NULL, f.failure, coalesce(r.decision, 'unresolved') FROM subject_failures f LEFT JOIN failure_rules r USING (failure)),
ranked AS (SELECT *, list_position(['pass', 'warn', 'retry', 'escalate', 'unresolved'], decision) AS p, concat_ws(':', kind, coalesce(metric, ''), coalesce(failure, ''), decision) AS t FROM reasons)"""


def d9_fallback(spark: SparkSession, sf: str) -> DataFrame:
    states = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("state_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 4).cast("string")).alias("node"), F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("trigger"), (F.col("o_orderkey") % 6).cast("int").alias("transitions_used")
    )
    rules = spark.createDataFrame([("n0", "t0", "RETRY", "n0"), ("n0", "t1", "ROUTE", "n1"), ("n1", "t2", "ROUTE", "n2"), ("n2", "t0", "STOP", None)], "node string, trigger string, action string, target string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(4)], "node string")
    return decisions.resolve_fallback(states, rules, nodes, 4).select("state_id", "action", "target")


def a3_profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    assets = bound(spark, sf, "assets").select(F.substring("observation_id", 9, 1).alias("group_id"), F.col("source").alias("source_id"))
    frames = bound(spark, sf, "frames").select(F.when(F.col("event_id") % 10 < 7, (F.col("event_id") % 10).cast("string")).otherwise("of no asset").alias("group_id"), "frame_time_us", "sharpness")
    found = decisions.profile_summary(assets, frames)
    return found.withColumn("value", F.round("value", 6))


def a15_fixture(spark: SparkSession, sf: str) -> DataFrame:
    observed = bound(spark, sf, "subject_metrics").select(F.col("subject").alias("fixture_id"), "metric", "value")
    expected = observed.where("metric <> 'unheard_of'").select("fixture_id", "metric", F.when(F.col("metric") == "mean_discount", "lte").when(F.col("metric") == "mean_quantity", "gte").otherwise("eq").alias("comparator"), F.when(F.col("metric") == "mean_discount", 0.05).when(F.col("metric") == "mean_quantity", 25.5).otherwise(F.round("value", -1)).alias("target"), F.when(F.col("metric") == "row_count", 3.0).otherwise(0.001).alias("abs_tolerance"))
    return decisions.evaluate_fixture(expected, observed).select("fixture_id", "metric", "comparator", "target", "observed", "passed")


def a15_fixture_results(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.fixture_results(a15_fixture(spark, sf))


CHECKS = """
e AS (SELECT subject AS fixture_id, metric, CASE metric WHEN 'mean_discount' THEN 'lte' WHEN 'mean_quantity' THEN 'gte' ELSE 'eq' END AS comparator,
        CASE metric WHEN 'mean_discount' THEN 0.05 WHEN 'mean_quantity' THEN 25.5 ELSE round(value, -1) END::DOUBLE AS target, value AS observed, CASE metric WHEN 'row_count' THEN 3.0 ELSE 0.001 END::DOUBLE AS tol
      FROM subject_metrics WHERE metric <> 'unheard_of'),
checks AS (SELECT fixture_id, metric, comparator, target, observed, CASE comparator WHEN 'eq' THEN abs(observed - target) <= tol WHEN 'lte' THEN observed - target <= tol ELSE target - observed <= tol END AS passed FROM e)"""


def _meshes(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_size")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("surface_id"), (k % 50 + 10).alias("triangle_count"), (k % 40 + 8).alias("vertex_count"), (k % 40 + 8 - p % 3).alias("finite_vertex_count"), (p % 4).cast("bigint").alias("degenerate_triangle_count"),
        F.when(k % 9 == 0, 0).otherwise(k % 90 + 20).alias("unique_edge_count"), (p % 7).cast("bigint").alias("boundary_edge_count"), (p % 2).cast("bigint").alias("non_manifold_edge_count"), (p % 5 + 1).cast("bigint").alias("connected_component_count"), (k % 50 + 10 - p % 6).alias("largest_component_triangle_count"),
    )


MESHES = """WITH m AS (SELECT p_partkey AS s, p_partkey % 50 + 10 AS t, p_partkey % 40 + 8 AS v, p_size AS p, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 90 + 20 END AS e FROM part)"""


def a11_surface_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.surface_metrics(_meshes(spark, sf)).withColumn("value", F.round("value", 9))


def a12_surface_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    meshes = _meshes(spark, sf)
    regions = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).otherwise(-1 - F.col("l_partkey")).alias("surface_id"), F.when(F.col("l_discount") > 0.09, "UNSUPPORTED").otherwise("SUPPORTED").alias("status"))
    return decisions.surface_support(meshes, regions)


def d13_capture_settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("group_id"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderstatus")).alias("iso"), F.lit(1).alias("exposure"))
    return decisions.capture_settings_agree(rows, ["iso", "exposure"])


def a13_execution_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("stage"), (F.col("event_id") < 40).alias("cold"), F.col("value").alias("seconds"), F.when((F.col("event_type") != "view") | (F.col("event_id") % 3 != 0), F.col("event_id") * 1000).alias("rss_bytes"))
    return decisions.execution_profile(rows).withColumn("value", F.round("value", 9))


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return bound(spark, sf, "assets").select("observation_id", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("byte_length"))


def io1_content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf)


def io4_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return identity.with_duplicates(_assets(spark, sf)).select("observation_id", F.array_join("duplicates", ",").alias("duplicates"))


def io4_duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy with its class and how many are in it."""
    classes, members = identity.duplicate_classes(_assets(spark, sf))
    return members.join(classes.select("class_id", "n"), "class_id")


def io14_verify_files(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("observation_id", 2, 9).cast("bigint")
    path = F.when(n % 37 == 0, F.concat(F.lit("../"), F.col("observation_id"))).otherwise(F.concat(F.lit("files/"), F.col("observation_id")))
    files = _assets(spark, sf).withColumn("path", path).withColumn("n", n)
    expected = files.select((F.col("n") % 97).alias("artifact_id"), "path", F.when(F.col("n") % 41 == 0, F.lit("0" * 64)).otherwise(F.upper("sha256")).alias("sha256"), "byte_length")
    return identity.verify_files(expected, files.select(F.when(F.col("n") % 53 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "sha256", "byte_length"))


def io15_put_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("customer").alias("record_type"), F.col("c_custkey").cast("string").alias("record_id"), F.concat(F.lit('{"c_mktsegment":"'), "c_mktsegment", F.lit('","c_nationkey":'), F.col("c_nationkey").cast("string"), F.lit("}")).alias("payload"))
    half = rows.where("cast(record_id as bigint) % 2 = 0")
    return identity.put_records(half, rows)


def io17_find_by_content(spark: SparkSession, sf: str) -> DataFrame:
    assets = _assets(spark, sf)
    first = assets.orderBy("observation_id").first()
    return identity.find_by_content(assets, first.sha256, first.byte_length)


#: Keys that one task makes.
KEY_ROWS = 50_000


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the graph with what makes them: their dependencies are their inputs."""
    nodes, edges = bound(spark, sf, "artifact_nodes"), bound(spark, sf, "artifact_edges")
    fed = edges.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("dependency", F.split_part("dependency", F.lit(":"), F.lit(1)).alias("k")))).alias("d"))
    inputs = F.transform(F.coalesce("d", F.expr("cast(array() as array<struct<dependency:string,k:string>>)")), lambda x: F.struct(x["k"].alias("artifact_kind"), F.sha2(x["dependency"], 256).alias("sha256")))
    kind, none = F.col("kind"), F.lit(None).cast("string")
    made = spread(nodes.join(fed, "artifact", "left"), nodes.count(), "artifact", each=KEY_ROWS)
    return made.select(
        "artifact", F.col("kind").alias("output_kind"), inputs.alias("inputs"),
        F.struct(F.lit('Maker "é😀"\n').alias("implementation"), F.lit("1.0").alias("version"), F.when(kind != "region", "r1").alias("revision")).alias("producer"), F.sha2("kind", 256).alias("configuration_sha256"),
        F.when(kind == "order", F.struct(F.lit("modèle").alias("name"), none.alias("version"), none.alias("revision"))).alias("model"), F.when(kind == "order", F.struct(F.lit("w").alias("identifier"), F.sha2(F.lit("w"), 256).alias("sha256"))).alias("checkpoint"),
        F.when(kind == "nation", F.sha2(F.lit("hw"), 256)).alias("hardware_runtime_sha256"),
    )


def sc2_artifact_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf).select("artifact", identity.artifact_key("evidence").alias("artifact_key"))


def io18_find_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The artifacts that are computed from the same as nation:3."""
    rows = _artifacts(spark, sf).select(F.lit("p1").alias("project_id"), F.col("artifact").alias("artifact_id"), F.col("output_kind").alias("kind"), identity.artifact_key("evidence").alias("artifact_key"))
    rows = scratch(rows, "artifact-keys")  # a key is made once, not for its filter, its join and the order each
    return identity.find_by_key(rows, rows.where("artifact_id = 'nation:3'").select("artifact_key"))


def a16_model_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_regionkey").alias("model_id"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), F.octet_length("n_name").alias("byte_length"))
    return identity.model_identity(rows)


def g3_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    nodes = bound(spark, sf, "artifact_nodes")
    return identity.invalidation_closure(nodes, bound(spark, sf, "artifact_edges"), nodes.where("artifact in ('region:1', 'nation:7')"))


def g4_dag_layers(spark: SparkSession, sf: str) -> DataFrame:
    layers = identity.check_dag(bound(spark, sf, "artifact_nodes"), bound(spark, sf, "artifact_edges"))
    return spark.createDataFrame([(layers,)], "layers int")


def io20_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    found = identity.dependencies_of(bound(spark, sf, "artifact_nodes"), bound(spark, sf, "artifact_edges"))
    return found.select("artifact", F.array_join("dependencies", ",").alias("dependencies"))


def io21_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return identity.direct_dependents(bound(spark, sf, "artifact_edges"), "nation:3")


def sc18_safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", identity.safe_path(F.col("url")).alias("url_safe"), identity.safe_path(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))).alias("path_safe"), identity.safe_path(F.concat(F.lit("a/../"), F.col("page_id").cast("string"))).alias("up_safe"))


QUERIES = {
    "d1_metadata": d1_metadata, "j7_capture_time_sync": j7_capture_time_sync, "d4_input_classes": d4_input_classes, "j6_same_video_sync": j6_same_video_sync, "j6_video_offsets": j6_video_offsets, "d10_visual_sync": d10_visual_sync,
    "sc12_correlations": sc12_correlations, "w6_best_lag": w6_best_lag, "d8_quality_policy": d8_quality_policy, "d8_policy_reasons": d8_policy_reasons, "d9_fallback": d9_fallback,
    "a3_profile_summary": a3_profile_summary, "a15_fixture": a15_fixture, "a15_fixture_results": a15_fixture_results, "a11_surface_metrics": a11_surface_metrics, "a12_surface_benchmark": a12_surface_benchmark,
    "d13_capture_settings": d13_capture_settings, "a13_execution_profile": a13_execution_profile, "io1_content_hashes": io1_content_hashes, "io4_duplicates": io4_duplicates, "io4_duplicate_classes": io4_duplicate_classes, "io14_verify_files": io14_verify_files,
    "io15_put_records": io15_put_records, "io17_find_by_content": io17_find_by_content, "io18_find_by_key": io18_find_by_key, "sc2_artifact_keys": sc2_artifact_keys, "a16_model_identity": a16_model_identity,
    "g3_invalidation": g3_invalidation, "g4_dag_layers": g4_dag_layers, "io20_dependencies": io20_dependencies, "io21_dependents": io21_dependents, "sc18_safe_paths": sc18_safe_paths,
}

ASSETS = "h AS (SELECT observation_id, sha256(coalesce(content, '')) AS sha256, octet_length(encode(coalesce(content, '')))::BIGINT AS byte_length FROM assets)"

KEYS = r"""
fed AS (SELECT artifact, string_agg('{"artifact_kind":"' || split_part(dependency, ':', 1) || '","sha256":"' || sha256(dependency) || '"}', ',' ORDER BY dependency) AS d FROM artifact_edges GROUP BY 1),
keys AS (SELECT artifact, kind, 'artifact-key:v1:' || sha256(
  '{"checkpoint":' || CASE WHEN kind = 'order' THEN '{"identifier":"w","sha256":"' || sha256('w') || '"}' ELSE 'null' END || ',"configuration_sha256":"' || sha256(kind) || '","domain":"evidence"'
  || CASE WHEN kind = 'nation' THEN ',"hardware_runtime_sha256":"' || sha256('hw') || '"' ELSE '' END || ',"inputs":[' || coalesce(d, '') || '],"model":' || CASE WHEN kind = 'order' THEN '{"name":"mod\u00e8le","revision":null,"version":null}' ELSE 'null' END
  || ',"output_kind":"' || kind || '","producer":{"implementation":"Maker \"\u00e9\ud83d\ude00\"\n","revision":' || CASE WHEN kind <> 'region' THEN '"r1"' ELSE 'null' END || ',"version":"1.0"},"schema_version":1}') AS artifact_key
  FROM artifact_nodes LEFT JOIN fed USING (artifact))"""

ORACLES = {
    "d1_metadata": f"{duck('raw_metadata')}, {D1} SELECT * FROM interpreted",
    "j7_capture_time_sync": f"""{duck('raw_metadata')}, {D1}
SELECT a.observation_id AS id1, b.observation_id AS id2, CASE WHEN a.time_status = 'RESOLVED' AND b.time_status = 'RESOLVED' THEN 'SUPPORTED' ELSE 'UNRESOLVED' END AS status, b.instant_us - a.instant_us AS offset_us
FROM interpreted a JOIN interpreted b ON substr(b.observation_id, 2)::BIGINT = substr(a.observation_id, 2)::BIGINT + 2 WHERE NOT (a.time_status = 'ABSENT' AND b.time_status = 'ABSENT')""",
    "d4_input_classes": rf"""{duck('raw_metadata')},
o AS (SELECT DISTINCT observation_id, substr(observation_id, 2)::BIGINT AS n FROM raw_metadata),
t AS (SELECT observation_id, namespace || ':' || key AS name, lower(namespace) AS ns, lower(key) AS k, trim(regexp_replace(translate(lower(key), '-_', '  '), '\s+', ' ', 'g')) AS nk, trim(regexp_replace(translate(lower(value), '-_', '  '), '\s+', ' ', 'g')) AS nv FROM raw_metadata),
f AS (
  SELECT observation_id, 3 AS o, 'drone_aerial' AS c, name FROM t WHERE ns = 'exif' AND k IN ('image make', 'image model') AND regexp_matches(nv, '\b(mavic|phantom|inspire|matrice|avata|anafi)\b|\bskydio\s+(2\+?|x2|x10)\b|\bautel(\s+robotics)?\s+evo\b')
  UNION SELECT observation_id, 4, 'fisheye', name FROM t WHERE contains(nk, 'fisheye') OR contains(nv, 'fisheye')
  UNION SELECT observation_id, 5, 'rolling_shutter', name FROM t WHERE contains(nk, 'rolling shutter') OR contains(nv, 'rolling shutter'))
SELECT observation_id, CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END AS class_order, CASE WHEN n % 4 = 0 THEN 'still' ELSE 'video' END AS input_class, 'observed' AS evidence_kind, 'observation.kind' AS evidence_keys FROM o
UNION ALL SELECT observation_id, 2, 'equirectangular_360', 'candidate', 'metadata.dimensions' FROM o WHERE n % 3 = 0
UNION ALL SELECT observation_id, o, c, 'candidate', string_agg(name, ',' ORDER BY name) FROM f GROUP BY 1, 2, 3""",
    "j6_same_video_sync": f"{duck('frames')} SELECT a.video_id, a.frame_index AS index1, b.frame_index AS index2, b.frame_time_us - a.frame_time_us AS offset_us, 'SUPPORTED' AS status FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_index - a.frame_index IN (1, 2, 4, 8, 16, 32, 64)",
    "j6_video_offsets": f"{duck('frames')} SELECT video_id, frame_index, frame_time_us, frame_time_us - first_value(frame_time_us) OVER (PARTITION BY video_id ORDER BY frame_index) AS offset_us FROM frames",
    "d10_visual_sync": """WITH g AS (SELECT event_id, event_id * 3 - 900 AS o, event_id % 5 <> 0 AND event_id % 9 >= 3 AND event_id % 11 <> 0 AND event_id % 700 <= 500 AS ok FROM events)
SELECT event_id, CASE WHEN ok THEN 'SUPPORTED' ELSE 'UNRESOLVED' END AS status, CASE WHEN ok THEN o END AS offset_us FROM g""",
    "sc12_correlations": f"{duck('samples')}, {CORRELATIONS} SELECT * FROM correlations",
    "w6_best_lag": f"""{duck('samples')}, {CORRELATIONS},
p AS (SELECT DISTINCT pair_id FROM samples),
m AS (SELECT *, max(correlation) OVER (PARTITION BY pair_id) AS best FROM correlations),
b AS (SELECT pair_id, arg_min(lag, struct_pack(d := abs(lag), l := lag)) AS lag, arg_min(overlap, struct_pack(d := abs(lag), l := lag)) AS overlap, max(correlation) AS correlation, count(*) AS tied FROM m WHERE correlation = best GROUP BY 1),
e AS (SELECT pair_id, CASE WHEN tied IS NULL THEN 'UNAVAILABLE' WHEN correlation < 0.3 THEN 'WEAK' WHEN tied > 1 THEN 'AMBIGUOUS' ELSE 'ACCEPTED' END AS evidence, coalesce(lag, 0) AS lag, coalesce(overlap, 0) AS overlap, coalesce(correlation, 0.0) AS correlation FROM p LEFT JOIN b USING (pair_id))
SELECT *, CASE WHEN evidence = 'ACCEPTED' THEN 'SUPPORTED' ELSE 'UNRESOLVED' END AS status, CASE WHEN evidence = 'ACCEPTED' THEN lag::BIGINT * 125 END AS offset_us FROM e""",
    "d8_quality_policy": f"""{duck('subject_metrics', 'subject_failures', 'metric_rules', 'failure_rules')}, {REASONS}
SELECT s.subject, coalesce(arg_max(decision, p), 'pass') AS decision, coalesce(string_agg(t, '|' ORDER BY p DESC, kind, coalesce(metric, ''), coalesce(failure, '')), '') AS reasons FROM subjects s LEFT JOIN ranked r USING (subject) GROUP BY 1""",
    "d8_policy_reasons": f"{duck('subject_metrics', 'subject_failures', 'metric_rules', 'failure_rules')}, {REASONS} SELECT * FROM reasons",
    "d9_fallback": """WITH r(node, trigger, action, target) AS (VALUES ('n0', 't0', 'RETRY', 'n0'), ('n0', 't1', 'ROUTE', 'n1'), ('n1', 't2', 'ROUTE', 'n2'), ('n2', 't0', 'STOP', NULL))
SELECT o_orderkey AS state_id, CASE WHEN o_orderkey % 6 >= 4 OR r.action IS NULL THEN 'UNRESOLVED' ELSE r.action END AS action, CASE WHEN o_orderkey % 6 < 4 THEN r.target END AS target
FROM orders LEFT JOIN r ON r.node = 'n' || (o_custkey % 4) AND r.trigger = 't' || (o_orderkey % 3)""",
    "a3_profile_summary": f"""{duck('assets', 'frames')}, g AS (SELECT substr(observation_id, 9, 1) AS group_id, source FROM assets), c AS (SELECT group_id, count(*)::DOUBLE AS n, count(DISTINCT source)::DOUBLE AS s FROM g GROUP BY 1),
f AS (SELECT (event_id % 10)::VARCHAR AS group_id, avg(sharpness) AS m, (max(frame_time_us) - min(frame_time_us)) / 1e6::DOUBLE AS d FROM frames WHERE event_id % 10 < 7 GROUP BY 1),
l AS (SELECT group_id, 'observation_count' AS metric, n AS value FROM c UNION ALL SELECT group_id, 'source_count', s FROM c UNION ALL SELECT group_id, 'mean_sharpness', m FROM c JOIN f USING (group_id) UNION ALL SELECT group_id, 'duration_seconds', d FROM c JOIN f USING (group_id))
SELECT group_id, metric, round(value, 6)::DOUBLE AS value FROM l""",
    "a15_fixture": f"{duck('subject_metrics')}, {CHECKS} SELECT * FROM checks",
    "a15_fixture_results": f"{duck('subject_metrics')}, {CHECKS} SELECT fixture_id, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS status, count(*) AS checks FROM checks GROUP BY 1",
    "a11_surface_metrics": f"""{MESHES}, l AS (
  SELECT s, 'connected_component_count' AS metric, (p % 5 + 1)::DOUBLE AS value FROM m UNION ALL SELECT s, 'degenerate_triangle_ratio', (p % 4) / t::DOUBLE FROM m UNION ALL SELECT s, 'finite_vertex_ratio', (v - p % 3) / v::DOUBLE FROM m
  UNION ALL SELECT s, 'largest_component_triangle_ratio', (t - p % 6) / t::DOUBLE FROM m UNION ALL SELECT s, 'boundary_edge_ratio', (p % 7) / e::DOUBLE FROM m WHERE e IS NOT NULL UNION ALL SELECT s, 'non_manifold_edge_ratio', (p % 2) / e::DOUBLE FROM m WHERE e IS NOT NULL)
SELECT s AS surface_id, metric, round(value, 9)::DOUBLE AS value FROM l""",
    "a12_surface_benchmark": """WITH r AS (SELECT l_partkey, bool_or(l_discount > 0.09) AS bad FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)
SELECT p_partkey AS surface_id, CASE WHEN bad IS NULL THEN 'UNKNOWN' WHEN bad THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS support FROM part LEFT JOIN r ON l_partkey = p_partkey""",
    "d13_capture_settings": "SELECT o_custkey AS group_id, count(*) >= 2 AND bool_and(o_orderkey % 50 <> 0) AND count(DISTINCT o_orderstatus) = 1 AS agrees FROM orders GROUP BY 1",
    "a13_execution_profile": """WITH g AS (SELECT event_type AS stage, max(value) FILTER (event_id < 40) AS c, median(value) FILTER (event_id >= 40) AS s, CASE WHEN bool_and(event_type <> 'view' OR event_id % 3 <> 0) THEN max(event_id * 1000)::DOUBLE END AS r FROM events GROUP BY 1),
l AS (SELECT stage, 'cold_seconds' AS metric, c AS value FROM g UNION ALL SELECT stage, 'steady_median_seconds', s FROM g UNION ALL SELECT stage, 'peak_rss_bytes', r FROM g) SELECT stage, metric, round(value, 9)::DOUBLE AS value FROM l WHERE value IS NOT NULL""",
    "io1_content_hashes": f"{duck('assets')}, {ASSETS} SELECT * FROM h",
    "io4_duplicates": f"""{duck('assets')}, {ASSETS}
SELECT a.observation_id, coalesce(string_agg(b.observation_id, ',' ORDER BY b.observation_id), '') AS duplicates FROM h a LEFT JOIN h b ON a.sha256 = b.sha256 AND a.byte_length = b.byte_length AND a.observation_id <> b.observation_id GROUP BY 1""",
    "io4_duplicate_classes": f"{duck('assets')}, {ASSETS}, c AS (SELECT observation_id, min(observation_id) OVER w AS class_id, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY sha256, byte_length)) SELECT * FROM c WHERE n > 1",
    "io14_verify_files": f"""{duck('assets')}, {ASSETS}, f AS (SELECT *, substr(observation_id, 2)::BIGINT AS n FROM h),
v AS (SELECT n % 97 AS artifact_id, CASE WHEN n % 37 = 0 THEN 2 WHEN n % 53 = 0 THEN 1 WHEN n % 41 = 0 THEN 2 ELSE 0 END AS v FROM f)
SELECT artifact_id, ['VERIFIED', 'MISSING', 'CORRUPTED'][max(v) + 1] AS status, count(*) FILTER (v > 0) AS problems FROM v GROUP BY 1""",
    "io15_put_records": """SELECT 'customer' AS record_type, c_custkey::VARCHAR AS record_id, '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' AS payload FROM customer""",
    "io17_find_by_content": f"{duck('assets')}, {ASSETS}, f AS (SELECT sha256, byte_length FROM h ORDER BY observation_id LIMIT 1) SELECT observation_id FROM h SEMI JOIN f USING (sha256, byte_length)",
    "sc2_artifact_keys": f"{duck('artifact_nodes', 'artifact_edges')}, {KEYS} SELECT artifact, artifact_key FROM keys",
    "io18_find_by_key": f"{duck('artifact_nodes', 'artifact_edges')}, {KEYS} SELECT 'p1' AS project_id, artifact AS artifact_id, kind, artifact_key FROM keys WHERE artifact_key = (SELECT artifact_key FROM keys WHERE artifact = 'nation:3')",
    "a16_model_identity": """SELECT n_regionkey AS model_id, sha256('[' || string_agg('{"byte_length":' || octet_length(encode(n_name)) || ',"path":"' || n_name || '","sha256":"' || sha256(n_name) || '"}', ',' ORDER BY n_nationkey) || ']') AS identity FROM nation GROUP BY 1""",
    "g3_invalidation": f"""{duck('artifact_edges')}, c AS (SELECT 'region:1' AS artifact, 0 AS depth UNION ALL SELECT 'nation:7', 0 UNION SELECT e.artifact, c.depth + 1 FROM c JOIN artifact_edges e ON e.dependency = c.artifact)
SELECT artifact, min(depth)::INT AS depth FROM c GROUP BY 1""",
    "g4_dag_layers": f"{duck('artifact_edges')}, c AS (SELECT artifact, 1 AS d FROM artifact_edges UNION SELECT e.artifact, c.d + 1 FROM c JOIN artifact_edges e ON e.dependency = c.artifact) SELECT (max(d) + 1)::INT AS layers FROM c",
    "io20_dependencies": f"{duck('artifact_nodes', 'artifact_edges')} SELECT n.artifact, coalesce(string_agg(DISTINCT e.dependency, ',' ORDER BY e.dependency), '') AS dependencies FROM artifact_nodes n LEFT JOIN artifact_edges e USING (artifact) GROUP BY 1",
    "io21_dependents": f"{duck('artifact_edges')} SELECT DISTINCT artifact FROM artifact_edges WHERE dependency = 'nation:3'",
    "sc18_safe_paths": "SELECT page_id, false AS url_safe, true AS path_safe, false AS up_safe FROM pages",
}
