"""Queries of depth fields against one another, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import depth, geometry
from .bindings import bound, duck


def _cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a camera of 8 x 6 pixels; each sees the plane before it, half of them turned by a right angle."""
    k = F.col("p_partkey")
    turned = k % 2 == 1
    one, none = F.lit(1.0), F.lit(0.0)
    pose = {c: none for c in depth.POSE} | {"r00": F.when(turned, 0.0).otherwise(1.0), "r01": F.when(turned, -1.0).otherwise(0.0), "r10": F.when(turned, 1.0).otherwise(0.0), "r11": F.when(turned, 0.0).otherwise(1.0), "r22": one, "t0": (k % 3 - 1) * 0.125, "t1": (k % 5 - 2) * 0.0625, "t2": (k % 4) * 0.25}
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("camera"), F.lit(4.0).alias("fx"), F.lit(4.0).alias("fy"), F.lit(4.0).alias("cx"), F.lit(3.0).alias("cy"), F.lit(8).alias("width"), F.lit(6).alias("height"), *(c.cast("double").alias(n) for n, c in pose.items()))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("raster_id", 2, 9).cast("bigint")
    far = 4.0 + (k % 4) * 0.25 + ((F.col("x") + F.col("y") * 2 + k) % 5 - 2) * 0.03125
    return bound(spark, sf, "rasters").select(k.alias("camera"), F.col("x").alias("u"), F.col("y").alias("v"), far.cast("double").alias("depth"), (F.col("luma") % 7 != 0).alias("valid"))


def _views(spark: SparkSession, sf: str) -> DataFrame:
    """Each camera with the two before it and the two after it."""
    c = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("camera"))
    pairs = c.withColumn("other", F.explode(F.array(*(F.col("camera") + s for s in (-2, -1, 1, 2)))))
    return pairs.join(c.select(F.col("camera").alias("other")), "other", "left_semi")


def x10_consistent_depth(spark: SparkSession, sf: str) -> DataFrame:
    found = depth.consistent_depth(_cameras(spark, sf), _pixels(spark, sf), _views(spark, sf), least_views=3, tolerance=0.01, several=True)
    return found.withColumns({c: F.round(c, 9) for c in ("depth", "confidence")})


def a4_consistent_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.depth_coverage(x10_consistent_depth(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 8))


def x18_voxel_sums(spark: SparkSession, sf: str) -> DataFrame:
    return depth.voxel_sums(_cameras(spark, sf), _pixels(spark, sf), voxel=0.5, truncation=0.5)


def x18_zero_crossings(spark: SparkSession, sf: str) -> DataFrame:
    found = depth.zero_crossings(x18_voxel_sums(spark, sf), voxel=0.5, least_weight=4)
    return found.withColumns({c: F.round(c, 6) for c in "xyz"})


QUERIES = {"x10_consistent_depth": x10_consistent_depth, "a4_consistent_coverage": a4_consistent_coverage, "x18_voxel_sums": x18_voxel_sums, "x18_zero_crossings": x18_zero_crossings}

SCENE = f"""{duck('rasters')},
cam AS (SELECT p_partkey AS camera, (p_partkey % 2 = 1)::INT::DOUBLE AS s, (p_partkey % 2 = 0)::INT::DOUBLE AS c, (p_partkey % 3 - 1) * 0.125::DOUBLE AS t0, (p_partkey % 5 - 2) * 0.0625::DOUBLE AS t1, (p_partkey % 4) * 0.25::DOUBLE AS t2 FROM part),
px AS (SELECT substr(raster_id, 2)::BIGINT AS camera, x AS u, y AS v, (4.0 + (substr(raster_id, 2)::BIGINT % 4) * 0.25 + ((x + y * 2 + substr(raster_id, 2)::BIGINT) % 5 - 2) * 0.03125)::DOUBLE AS depth, luma % 7 <> 0 AS valid FROM rasters)"""
MERGED = f"""{SCENE},
good AS (SELECT * FROM px WHERE valid),
w AS (SELECT g.camera, g.u, g.v, g.depth, ((g.u + 0.5 - 4) / 4 * g.depth - t0) AS a0, ((g.v + 0.5 - 3) / 4 * g.depth - t1) AS a1, g.depth - t2 AS a2, s, c FROM good g JOIN cam USING (camera)),
p AS (SELECT camera, u, v, depth, c * a0 + s * a1 AS x, c * a1 - s * a0 AS y, a2 AS z FROM w),
m AS (SELECT p.camera, p.u, p.v, k.camera AS other, k.c * x - k.s * y + k.t0 AS x, k.s * x + k.c * y + k.t1 AS y, z + k.t2 AS z FROM p JOIN cam k ON abs(k.camera - p.camera) IN (1, 2)),
n AS (SELECT camera, u, v, other, z, floor(x / z * 4 + 4)::INT AS bu, floor(y / z * 4 + 3)::INT AS bv FROM m WHERE z > 0),
e AS (SELECT n.camera, n.u, n.v, q.z - a.t2 + a.t2 AS z0, q.z + a.t2 AS back FROM n JOIN good g ON g.camera = n.other AND g.u = bu AND g.v = bv JOIN p q ON q.camera = n.other AND q.u = bu AND q.v = bv JOIN cam a ON a.camera = n.camera WHERE abs(n.z - g.depth) <= 0.01::DOUBLE * g.depth),
agreed AS (SELECT camera, u, v, count(*) AS n, sum(back) AS s FROM e GROUP BY ALL),
asked AS (SELECT a.camera, count(*) + 1 AS asked FROM cam a JOIN cam b ON abs(a.camera - b.camera) IN (1, 2) GROUP BY 1),
r AS (SELECT px.camera, px.u, px.v, depth, valid AND coalesce(n, 0) + 1 >= 3 AS ok, coalesce(n, 0) + 1 AS k, coalesce(s, 0) AS s, coalesce(asked, 1) AS asked FROM px LEFT JOIN agreed USING (camera, u, v) LEFT JOIN asked USING (camera)),
merged AS (SELECT camera, u, v, CASE WHEN ok THEN round((depth + s) / k, 9) ELSE 0 END::DOUBLE AS depth, ok AS valid, CASE WHEN ok THEN k ELSE 0 END::INT AS support, CASE WHEN ok THEN round(k / asked::DOUBLE, 9) END AS confidence FROM r)"""
SUMS = f"""{SCENE},
g AS (SELECT camera, s, c, t0, t1, t2, u, v, greatest(depth - 0.5, 0) AS n, depth + 0.5 AS f FROM px JOIN cam USING (camera) WHERE valid),
l AS (SELECT *, least((u - 4) / 4 * n, (u - 4) / 4 * f) - t0 AS lx, greatest((u - 3) / 4 * n, (u - 3) / 4 * f) - t0 AS hx, least((v - 3) / 4 * n, (v - 3) / 4 * f) - t1 AS ly, greatest((v - 2) / 4 * n, (v - 2) / 4 * f) - t1 AS hy FROM g),
b AS (SELECT camera, floor((least(c * lx, c * hx) + least(s * ly, s * hy)) / 4)::INT AS x0, floor((greatest(c * lx, c * hx) + greatest(s * ly, s * hy)) / 4)::INT AS x1,
  floor((least(-s * lx, -s * hx) + least(c * ly, c * hy)) / 4)::INT AS y0, floor((greatest(-s * lx, -s * hx) + greatest(c * ly, c * hy)) / 4)::INT AS y1, floor((n - t2) / 4)::INT AS z0, floor((f - t2) / 4)::INT AS z1 FROM l),
touched AS (SELECT DISTINCT camera, bx, "by", bz FROM (SELECT camera, bx, "by", unnest(range(z0, z1 + 1)) AS bz FROM (SELECT camera, bx, unnest(range(y0, y1 + 1)) AS "by", z0, z1 FROM (SELECT camera, unnest(range(x0, x1 + 1)) AS bx, y0, y1, z0, z1 FROM b)))),
e AS (SELECT camera, bx, "by", bz, i, (bx * 8 + i // 64 + 0.5) * 0.5::DOUBLE AS x, ("by" * 8 + i // 8 % 8 + 0.5) * 0.5::DOUBLE AS y, (bz * 8 + i % 8 + 0.5) * 0.5::DOUBLE AS z FROM touched, range(512) r(i)),
a AS (SELECT e.camera, bx, "by", bz, i, c * x - s * y + t0 AS px, s * x + c * y + t1 AS py, z + t2 AS pz FROM e JOIN cam USING (camera) WHERE z + t2 > 0),
d AS (SELECT bx, "by", bz, i, (depth - pz) / 0.5::DOUBLE AS d FROM a JOIN px ON px.camera = a.camera AND u = floor(a.px / pz * 4 + 4)::INT AND v = floor(py / pz * 4 + 3)::INT WHERE valid),
sums AS (SELECT bx::INT AS bx, "by"::INT AS "by", bz::INT AS bz, i::INT AS i, count(*) AS weight, sum(round(least(d, 1.0) * 1048576)::BIGINT)::BIGINT AS distance FROM d WHERE d >= -1 GROUP BY ALL)"""
CROSSINGS = " UNION ALL ".join(
    f"SELECT round((p.x + 0.5 + {'p.d / (p.d - q.d)' if axis == 'x' else '0'}) * 0.5, 6) AS x, round((p.y + 0.5 + {'p.d / (p.d - q.d)' if axis == 'y' else '0'}) * 0.5, 6) AS y, round((p.z + 0.5 + {'p.d / (p.d - q.d)' if axis == 'z' else '0'}) * 0.5, 6) AS z, '{axis}' AS axis "
    f"FROM v p JOIN v q ON q.x = p.x + {int(axis == 'x')} AND q.y = p.y + {int(axis == 'y')} AND q.z = p.z + {int(axis == 'z')} WHERE (p.d >= 0) <> (q.d >= 0)"
    for axis in "xyz"
)

ORACLES = {
    "x18_voxel_sums": f"{SUMS} SELECT * FROM sums",
    "x18_zero_crossings": f"{SUMS}, v AS (SELECT bx * 8 + i // 64 AS x, \"by\" * 8 + i // 8 % 8 AS y, bz * 8 + i % 8 AS z, distance / weight::DOUBLE AS d FROM sums WHERE weight >= 4) {CROSSINGS}",
    "x10_consistent_depth": f"{MERGED} SELECT * FROM merged",
    "a4_consistent_coverage": f"{MERGED} SELECT camera, count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS hole_count, round(avg(confidence) FILTER (valid), 8) AS mean_confidence FROM merged GROUP BY 1",
}
