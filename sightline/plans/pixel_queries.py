"""Queries over depth, poses, photometry and rasters, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, pairs, photometry
from .bindings import bound, duck


def _poses(spark: SparkSession, sf: str) -> DataFrame:
    rows = bound(spark, sf, "poses")
    return rows.select("solution", "camera", geometry.rotation_about_z(F.col("angle")).alias("r"), F.array("tx", "ty", "tz").alias("t"))


def a10_geometry_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.geometry_consensus(_poses(spark, sf)).withColumn("value", F.round("value", 5))


def a8_pose_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _poses(spark, sf)
    reference = rows.where("solution = 'A'").select(F.lit("A").alias("key"), "camera", "r", "t")
    return geometry.pose_quality(geometry.pose_agreement(reference, rows.where("solution = 'B'").select(F.lit("A").alias("key"), "camera", "r", "t"))).withColumn("value", F.round("value", 5))


# rotations about z: relative ones differ by the angle alone, and a centre is -R'T t
POSES = """
c AS (SELECT solution, camera, angle, -(cos(angle) * tx + sin(angle) * ty) AS cx, -(-sin(angle) * tx + cos(angle) * ty) AS cy, -tz AS cz FROM poses),
p AS (SELECT a.solution AS s1, b.solution AS s2, a.camera, a.angle AS a1, b.angle AS a2, a.cx AS x1, a.cy AS y1, a.cz AS z1, b.cx AS x2, b.cy AS y2, b.cz AS z2 FROM c a JOIN c b ON a.camera = b.camera AND a.solution < b.solution),
q AS (SELECT p.s1, p.s2, (q.a1 - p.a1) - (q.a2 - p.a2) AS da,
        cos(p.a1) * (q.x1 - p.x1) - sin(p.a1) * (q.y1 - p.y1) AS u1, sin(p.a1) * (q.x1 - p.x1) + cos(p.a1) * (q.y1 - p.y1) AS v1, q.z1 - p.z1 AS w1,
        cos(p.a2) * (q.x2 - p.x2) - sin(p.a2) * (q.y2 - p.y2) AS u2, sin(p.a2) * (q.x2 - p.x2) + cos(p.a2) * (q.y2 - p.y2) AS v2, q.z2 - p.z2 AS w2
      FROM p JOIN p q ON p.s1 = q.s1 AND p.s2 = q.s2 AND p.camera < q.camera),
r AS (SELECT *, sqrt(u1 * u1 + v1 * v1 + w1 * w1) AS n1, sqrt(u2 * u2 + v2 * v2 + w2 * w2) AS n2 FROM q),
angles AS (SELECT s1, s2, count(*) AS pairs, median(degrees(acos(greatest(-1.0, least(1.0, (2 * cos(da) + 1 - 1) / 2))))) AS rot,
             count(*) FILTER (n1 > 1e-12 AND n2 > 1e-12) AS tp, median(CASE WHEN n1 > 1e-12 AND n2 > 1e-12 THEN degrees(acos(greatest(-1.0, least(1.0, (u1 * u2 + v1 * v2 + w1 * w2) / (n1 * n2))))) END) AS dir FROM r GROUP BY 1, 2),
counts AS (SELECT a.solution AS s1, b.solution AS s2, (SELECT count(*) FROM c x JOIN c y ON x.camera = y.camera AND x.solution = a.solution AND y.solution = b.solution) AS shared, a.n AS n1, b.n AS n2
           FROM (SELECT solution, count(*) AS n FROM c GROUP BY 1) a JOIN (SELECT solution, count(*) AS n FROM c GROUP BY 1) b ON a.solution < b.solution)"""


def a4_depth_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.depth_coverage(bound(spark, sf, "pixels")).withColumn("mean_confidence", F.round("mean_confidence", 9))


def a4_depth_coverage_total(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.depth_coverage_total(bound(spark, sf, "pixels")).withColumn("value", F.round("value", 9))


def a7_depth_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = geometry.depth_errors(bound(spark, sf, "pixels"))
    return found.withColumns({c: F.round(c, 9) for c in found.columns[1:]})


def a9_intrinsics(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_size")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(
        (k % 20).alias("key"), F.lit("pinhole").alias("model"), F.lit("pinhole").alias("model2"), F.lit(640.0).alias("width"), F.lit(640.0).alias("width2"), F.lit(480.0).alias("height"), F.lit(480.0).alias("height2"),
        (500.0 + p).alias("fx"), (510.0 + p).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"), (500.0 + k % 30).alias("fx2"), (505.0 + k % 40).alias("fy2"), (320.0 + k % 7).alias("cx2"), (240.0 - p % 5).alias("cy2"),
    )
    found = geometry.intrinsics_quality(rows)
    return found.withColumns({c: F.round(c, 9) for c in found.columns[1:]})


def x10_valid_depth(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.array(F.col("o_totalprice") - 100000, F.lit(0.0), F.col("o_totalprice")).alias("raw"))
    return rows.select("o_orderkey", F.posexplode(geometry.valid_depth(F.col("raw"))).alias("i", "x")).select("o_orderkey", "i", "x.depth", "x.valid")


def sc4_ecef(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = pairs.ecef(F.col("latitude_deg"), F.col("longitude_deg"))
    return bound(spark, sf, "points").select("observation_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_size")
    codes = F.array(*((((k * a + p * b) % 256).cast("int")) for a, b in ((0, 0), (37, 1), (91, 5), (13, 13), (255, 0), (7, 64))))
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("image_id"), codes.alias("codes"), (p % 3).cast("double").alias("ev"), F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0)).alias("gains"))


CODES = """c AS (SELECT p_partkey AS image_id, (p_size % 3)::DOUBLE AS ev, i, ((p_partkey * [0, 37, 91, 13, 255, 7][i + 1] + p_size * [0, 1, 5, 13, 0, 64][i + 1]) % 256)::INT AS code FROM part, (SELECT unnest(range(6))::INT AS i)),
l AS (SELECT *, CASE WHEN code / 255.0::DOUBLE <= 0.04045 THEN code / 255.0::DOUBLE / 12.92 ELSE pow((code / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS linear FROM c),
n AS (SELECT *, linear * pow(2.0, ev) * [1.0, 0.5, 2.0][i % 3 + 1] AS normalized FROM l)"""


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    rows = _codes(spark, sf).withColumn("linear", photometry.linear_rgb(F.col("codes")))
    return rows.withColumn("normalized", photometry.normalize_linear(F.col("linear"), F.pow(F.lit(2.0), F.col("ev")), F.col("gains")))


def sc8_linear_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select("image_id", F.posexplode("linear").alias("i", "v")).select("image_id", "i", F.round("v", 9).alias("linear"))


def sc10_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select("image_id", F.posexplode("normalized").alias("i", "v")).select("image_id", "i", F.round("v", 9).alias("normalized"))


def sc11_validity_masks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _normalized(spark, sf)
    rounded = F.transform("normalized", lambda v: F.round(v, 9))
    masks = rows.select("image_id", photometry.validity_masks(F.col("codes"), rounded).alias("m"))
    return masks.select("image_id", *(F.array_join(F.transform(F.col(f"m.{c}"), lambda v: v.cast("string")), "").alias(c) for c in ("low", "high", "above_one")))


def sc9_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 4000 + 1).cast("int").alias("width"), (F.col("p_size") * 37 + 1).cast("int").alias("height"))
    return photometry.pyramid_levels(rows, 256)


def a1_image_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = photometry.image_quality(bound(spark, sf, "rasters"))
    return found.withColumns({c: F.round(c, 6) for c in found.columns[1:]})


def a2_visual_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The rasters' ids have six digits, so parts beyond a million share one: a raster may have several rows for a place."""
    places = bound(spark, sf, "rasters").where("x in (1, 3, 5, 7) and y in (0, 2, 3, 5)")
    n = F.substring("raster_id", 2, 9).cast("bigint")
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("r"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("raster_id")).distinct()
    near = names.select(n.alias("n"), F.col("raster_id").alias("id1")).join(names.select((n - 1).alias("n"), F.col("raster_id").alias("id2")), "n").select("id1", "id2")
    found = photometry.place_similarity(places, near, 16)
    return found.select("id1", "id2", F.round("hash_distance", 9).alias("hash_distance"), F.round("mean_difference", 9).alias("mean_difference"))


def j11_pixel_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.canonical_tracks(bound(spark, sf, "track_elements"))
    n = F.substring("observation_id", 2, 9).cast("bigint")
    samples = rows.select("point_id", "observation_id", *(((F.col("point_id") * a + n * b + F.col("feature_index")) % 256).cast("int").alias(c) for c, a, b in (("r", 3, 7), ("g", 5, 11), ("b", 1, 13))))
    return photometry.pixel_deltas(samples).withColumn("mean_delta", F.round("mean_delta", 9))


def _color_cases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")

    def unless(every: int, value: str, other: str | None) -> Column:
        return F.when(k % every == 0, F.lit(other)).otherwise(F.lit(value))

    d = photometry.DECLARATION
    return spark.read.parquet(f"{sf}/events.parquet").select(
        k.alias("case_id"), (k % 29 == 0).alias("evidence_conflict"), F.when(k % 23 == 0, "absent").when(k % 31 == 0, "unknown").when(k % 37 == 0, "invalid").otherwise("declared").alias("declaration_status"),
        unless(19, d["color_space"], None).alias("color_space"), unless(17, d["primaries"], "bt2020").alias("primaries"), F.lit(d["transfer"]).alias("transfer"), F.lit(d["matrix"]).alias("matrix"), unless(41, d["value_range"], None).alias("value_range"),
        F.when(k % 13 == 0, "icc").alias("profile_name"), F.when(k % 11 == 0, None).when(k % 7 == 0, "yuv").otherwise(photometry.ENCODING).alias("decoded_encoding"), unless(43, photometry.LAYOUT, "planar").alias("pixel_layout"),
        unless(47, photometry.ORIENTATION, "rotated").alias("orientation"), unless(53, photometry.CONVENTION, "x").alias("working_convention"), unless(59, photometry.CONVENTION, "x").alias("output_convention"), (k % 61 != 0).alias("backend_reviewed"),
        F.when(k % 10 != 3, (k % 9 - 4).cast("double")).when(k % 20 == 3, F.lit(2000.0)).alias("exposure_ev"), F.when(k % 14 != 5, F.array(F.lit(1.0), (k % 5).cast("double"), F.lit(2.0))).alias("gains"),
    )


COLOR = """c AS (SELECT event_id AS k, CASE
  WHEN k % 29 = 0 THEN 'rejected:evidence_conflict' WHEN k % 23 = 0 OR k % 31 = 0 THEN 'unresolved:no_evidence' WHEN k % 37 = 0 THEN 'rejected:invalid_declaration' WHEN k % 19 = 0 OR k % 41 = 0 THEN 'unresolved:incomplete_declaration'
  WHEN k % 17 = 0 THEN 'rejected:unsupported_declaration' WHEN k % 13 = 0 THEN 'rejected:profile' WHEN k % 11 = 0 THEN 'unresolved:decoded_encoding' WHEN k % 7 = 0 THEN 'rejected:decoded_encoding' WHEN k % 43 = 0 THEN 'rejected:pixel_layout'
  WHEN k % 47 = 0 THEN 'rejected:orientation' WHEN k % 53 = 0 THEN 'rejected:working_convention' WHEN k % 59 = 0 THEN 'rejected:output_convention' WHEN k % 61 = 0 THEN 'rejected:backend' END AS issue FROM (SELECT *, event_id AS k FROM events)),
color AS (SELECT k, coalesce(upper(split_part(issue, ':', 1)), 'READY') AS color_status, split_part(issue, ':', 2) AS color_issue FROM c),
f AS (SELECT *, CASE WHEN k % 10 <> 3 THEN (k % 9 - 4)::DOUBLE WHEN k % 20 = 3 THEN 2000.0 END AS ev, k % 14 <> 5 AS has_gains FROM color),
g AS (SELECT *, CASE WHEN color_status <> 'READY' THEN 'rejected:color' WHEN ev IS NULL OR NOT has_gains THEN 'unresolved:factors' WHEN k % 5 = 0 THEN 'rejected:gains' WHEN ev > 1100 THEN 'rejected:exposure_scale' WHEN k % 61 = 0 THEN 'rejected:backend' END AS issue2 FROM f),
norm AS (SELECT k, color_status, color_issue, coalesce(upper(split_part(issue2, ':', 1)), 'READY') AS normalization_status, split_part(issue2, ':', 2) AS normalization_issue, CASE WHEN issue2 IS NULL THEN pow(2.0, ev) END AS exposure_scale FROM g)"""


def d5_color_gate(spark: SparkSession, sf: str) -> DataFrame:
    return photometry.color_gate(_color_cases(spark, sf)).select("case_id", "color_status", "color_issue")


def d6_normalization_gate(spark: SparkSession, sf: str) -> DataFrame:
    found = photometry.normalization_gate(photometry.color_gate(_color_cases(spark, sf)))
    return found.select("case_id", "normalization_status", "normalization_issue", F.round("exposure_scale", 9).alias("exposure_scale"))


def d7_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("case_id")
    gated = photometry.normalization_gate(photometry.color_gate(_color_cases(spark, sf)))
    cases = gated.withColumns({"color_observation": k, "normalization_observation": F.when(k % 33 == 0, k + 1).otherwise(k), "same_request": k % 27 != 0, "same_plan": k % 39 != 0, "supported_convention": F.lit(True), "has_output": k % 3 != 0})
    return photometry.photometric_compatibility(cases).select("case_id", "compatibility", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {
    "a10_geometry_consensus": a10_geometry_consensus, "a8_pose_quality": a8_pose_quality, "a9_intrinsics": a9_intrinsics, "a4_depth_coverage": a4_depth_coverage, "a4_depth_coverage_total": a4_depth_coverage_total, "a7_depth_errors": a7_depth_errors,
    "x10_valid_depth": x10_valid_depth, "sc4_ecef": sc4_ecef, "sc8_linear_rgb": sc8_linear_rgb, "sc10_normalized": sc10_normalized, "sc11_validity_masks": sc11_validity_masks, "sc9_pyramid": sc9_pyramid, "a1_image_quality": a1_image_quality,
    "a2_visual_similarity": a2_visual_similarity, "j11_pixel_deltas": j11_pixel_deltas, "d5_color_gate": d5_color_gate, "d6_normalization_gate": d6_normalization_gate, "d7_compatibility": d7_compatibility,
}

ORACLES = {
    "a10_geometry_consensus": f"""{duck('poses')}, {POSES}, l AS (
  SELECT s1, s2, 'shared_camera_ratio' AS metric, shared / (n1 + n2 - shared)::DOUBLE AS value FROM counts UNION ALL SELECT s1, s2, 'median_rotation_disagreement_deg', rot FROM angles UNION ALL SELECT s1, s2, 'median_translation_disagreement_deg', dir FROM angles)
SELECT s1 AS solution1, s2 AS solution2, metric, round(value, 5)::DOUBLE AS value FROM l""",
    "a8_pose_quality": f"""{duck('poses')}, {POSES}, l AS (
  SELECT 'camera_coverage' AS metric, shared / n1::DOUBLE AS value FROM counts WHERE s1 = 'A' AND s2 = 'B' UNION ALL SELECT 'median_rotation_error_deg', rot FROM angles WHERE s1 = 'A' AND s2 = 'B'
  UNION ALL SELECT 'translation_coverage', tp / pairs::DOUBLE FROM angles WHERE s1 = 'A' AND s2 = 'B' UNION ALL SELECT 'median_translation_error_deg', dir FROM angles WHERE s1 = 'A' AND s2 = 'B')
SELECT 'A' AS key, metric, round(value, 5)::DOUBLE AS value FROM l""",
    "a9_intrinsics": """WITH e AS (SELECT p_partkey % 20 AS key, (abs((500.0::DOUBLE + p_partkey % 30) - (500.0::DOUBLE + p_size)) / (500.0::DOUBLE + p_size) + abs((505.0::DOUBLE + p_partkey % 40) - (510.0::DOUBLE + p_size)) / (510.0::DOUBLE + p_size)) / 2 AS f,
  sqrt(((p_partkey % 7) * (p_partkey % 7) + (p_size % 5) * (p_size % 5))::DOUBLE) / 800 AS c FROM part) SELECT key, round(median(f), 9) AS median_focal_error, round(median(c), 9) AS median_principal_error FROM e GROUP BY 1""",
    "a4_depth_coverage": f"{duck('pixels')} SELECT camera, count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS hole_count, round(avg(confidence) FILTER (valid), 9) AS mean_confidence FROM pixels GROUP BY 1",
    "a4_depth_coverage_total": f"""{duck('pixels')}, t AS (SELECT count(DISTINCT camera)::DOUBLE AS f, count(DISTINCT camera) FILTER (confidence IS NOT NULL) AS c, count(*)::DOUBLE AS n, count(*) FILTER (valid) AS v, avg(confidence) FILTER (valid) AS m FROM pixels),
l AS (SELECT 'field_count' AS metric, f AS value FROM t UNION ALL SELECT 'confidence_field_ratio', c / f FROM t UNION ALL SELECT 'hole_ratio', (n - v) / n FROM t UNION ALL SELECT 'mean_confidence', m FROM t UNION ALL SELECT 'valid_ratio', v / n FROM t)
SELECT metric, round(value, 9)::DOUBLE AS value FROM l""",
    "a7_depth_errors": f"""{duck('pixels')}, j AS (SELECT *, valid AND reference_valid AS joint FROM pixels)
SELECT camera, round(count(*) FILTER (joint) / nullif(count(*) FILTER (reference_valid), 0)::DOUBLE, 9) AS reference_coverage, round(median(abs(depth - reference_depth)) FILTER (joint), 9) AS median_abs_error,
       round(median(abs(depth - reference_depth) / nullif(reference_depth, 0)) FILTER (joint), 9) AS median_rel_error FROM j GROUP BY 1""",
    "x10_valid_depth": """WITH r AS (SELECT o_orderkey, i, [o_totalprice - 100000, 0.0, o_totalprice][i + 1] AS d FROM orders, (SELECT unnest(range(3))::INT AS i))
SELECT o_orderkey, i, CASE WHEN d > 0 THEN d ELSE 0.0 END::DOUBLE AS depth, d > 0 AS valid FROM r""",
    "sc4_ecef": f"""{duck('points')}, e AS (SELECT observation_id, radians(latitude_deg) AS lat, radians(longitude_deg) AS lon, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM points),
n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(lat) * sin(lat)) AS n FROM e)
SELECT observation_id, round(n * cos(lat) * cos(lon), 3) AS x, round(n * cos(lat) * sin(lon), 3) AS y, round(n * (1 - e2) * sin(lat), 3) AS z FROM n""",
    "sc8_linear_rgb": f"WITH {CODES} SELECT image_id, i, round(linear, 9) AS linear FROM l",
    "sc10_normalized": f"WITH {CODES} SELECT image_id, i, round(normalized, 9) AS normalized FROM n",
    "sc11_validity_masks": f"""WITH {CODES} SELECT image_id, string_agg((code = 0)::INT::VARCHAR, '' ORDER BY i) AS low, string_agg((code = 255)::INT::VARCHAR, '' ORDER BY i) AS high, string_agg((round(normalized, 9) > 1.0)::INT::VARCHAR, '' ORDER BY i) AS above_one FROM n GROUP BY 1""",
    "sc9_pyramid": """WITH r AS (SELECT p_partkey AS image_id, (p_partkey % 4000 + 1)::INT AS w, (p_size * 37 + 1)::INT AS h, level FROM part, (SELECT unnest(range(20))::INT AS level))
SELECT image_id, level, greatest(1, w >> level) AS width, greatest(1, h >> level) AS height FROM r WHERE level = 0 OR greatest(1, w >> (level - 1), h >> (level - 1)) > 256""",
    "a1_image_quality": f"""{duck('rasters')}, l AS (SELECT c.raster_id, n.luma + s.luma + e.luma + w.luma - 4 * c.luma AS v FROM rasters c JOIN rasters n ON n.raster_id = c.raster_id AND n.x = c.x AND n.y = c.y - 1 JOIN rasters s ON s.raster_id = c.raster_id AND s.x = c.x AND s.y = c.y + 1
  JOIN rasters e ON e.raster_id = c.raster_id AND e.x = c.x + 1 AND e.y = c.y JOIN rasters w ON w.raster_id = c.raster_id AND w.x = c.x - 1 AND w.y = c.y), v AS (SELECT raster_id, var_pop(v) AS s FROM l GROUP BY 1)
SELECT r.raster_id, round(avg(luma) / 255, 6) AS mean_luma, round(count(*) FILTER (luma = 0) / count(*)::DOUBLE, 6) AS black_ratio, round(count(*) FILTER (luma = 255) / count(*)::DOUBLE, 6) AS white_ratio, round(max(s), 6) AS sharpness FROM rasters r LEFT JOIN v USING (raster_id) GROUP BY 1""",
    "a2_visual_similarity": f"""{duck('rasters')}, g AS (SELECT raster_id, substr(raster_id, 2)::BIGINT AS n, x, y, luma FROM rasters WHERE x IN (1, 3, 5, 7) AND y IN (0, 2, 3, 5)), m AS (SELECT *, luma >= avg(luma) OVER (PARTITION BY raster_id) AS bit FROM g)
SELECT a.raster_id AS id1, b.raster_id AS id2, round(count(*) FILTER (a.bit <> b.bit) / 16.0::DOUBLE, 9) AS hash_distance, round(sum(abs(a.luma - b.luma)) / (255.0::DOUBLE * 16), 9) AS mean_difference FROM m a JOIN m b ON b.n = a.n + 1 AND a.x = b.x AND a.y = b.y GROUP BY 1, 2""",
    "j11_pixel_deltas": f"""{duck('track_elements')}, t AS (SELECT point_id, observation_id, substr(observation_id, 2)::BIGINT AS n, min(feature_index) AS f FROM track_elements GROUP BY 1, 2),
s AS (SELECT *, (point_id * 3 + n * 7 + f) % 256 AS r, (point_id * 5 + n * 11 + f) % 256 AS g, (point_id + n * 13 + f) % 256 AS b FROM t)
SELECT x.observation_id AS id1, y.observation_id AS id2, count(*) AS samples, round(sum(abs(x.r - y.r) + abs(x.g - y.g) + abs(x.b - y.b)) / (count(*) * 765.0::DOUBLE), 9) AS mean_delta FROM s x JOIN s y ON x.point_id = y.point_id AND x.observation_id < y.observation_id GROUP BY 1, 2""",
    "d5_color_gate": f"WITH {COLOR} SELECT k AS case_id, color_status, color_issue FROM color",
    "d6_normalization_gate": f"WITH {COLOR} SELECT k AS case_id, normalization_status, normalization_issue, round(exposure_scale, 9) AS exposure_scale FROM norm",
    "d7_compatibility": f"""WITH {COLOR}, r AS (SELECT k, list_filter([CASE WHEN k % 33 = 0 THEN 'different_observations' END, CASE WHEN k % 27 = 0 THEN 'foreign_request' END, CASE WHEN color_status = 'REJECTED' THEN 'color_rejected' END, CASE WHEN normalization_status = 'REJECTED' THEN 'normalization_rejected' END,
    CASE WHEN normalization_status = 'READY' AND NOT (color_status = 'READY' AND k % 39 <> 0) THEN 'foreign_plan' END, CASE WHEN normalization_status <> 'READY' AND k % 3 <> 0 THEN 'output_without_normalization' END], lambda x: x IS NOT NULL) AS a,
  list_filter([CASE WHEN color_status = 'UNRESOLVED' THEN 'color_unresolved' END, CASE WHEN normalization_status = 'UNRESOLVED' THEN 'normalization_unresolved' END, CASE WHEN color_status = 'READY' AND normalization_status = 'READY' AND k % 3 = 0 THEN 'output_absent' END], lambda x: x IS NOT NULL) AS u FROM norm)
SELECT k AS case_id, CASE WHEN len(a) > 0 THEN 'INCOMPATIBLE' WHEN len(u) > 0 THEN 'UNRESOLVED' ELSE 'COMPATIBLE' END AS compatibility, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE u END, ',') AS reasons FROM r""",
}
