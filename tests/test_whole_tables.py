"""What a query reads is the whole of its tables, and results over all of it are right."""

from __future__ import annotations

import math
import re
from itertools import combinations
from statistics import correlation, median

import duckdb
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from sightline.operators import geometry
from sightline.plans import depth_queries, pixel_queries, record_queries
from sightline.plans.bindings import bound


def test_every_supplier_is_a_camera(spark):
    found = {r.solution: r.n for r in bound(spark, SF, "poses").groupBy("solution").agg(F.count("*").alias("n")).collect()}
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet")
    n = suppliers.count()
    assert found == {"A": n, "B": suppliers.where("s_suppkey % 4 <> 0").count(), "C": n}


@pytest.mark.parametrize(("cameras", "block"), [(2, 1024), (3, 1), (61, 15), (90, 6)])
def test_pose_medians_over_all_pairs(spark, cameras, block):
    def pose(k, wrong):
        return math.radians(k * 37 % 360 + wrong * (k * k % 11) * 0.25), (k % 7 + wrong * 0.125, float(k % 5), k % 3 - wrong * 0.25)

    def table(wrong):
        rows = [("k", f"c{k:03d}", *pose(k, wrong)) for k in range(cameras)]
        return spark.createDataFrame(rows, "key string, camera string, angle double, t array<double>").select("key", "camera", geometry.rotation_about_z(F.col("angle")).alias("r"), "t")

    def centre(angle, t):
        c, s = math.cos(angle), math.sin(angle)
        return -(c * t[0] + s * t[1]), -(-s * t[0] + c * t[1]), -t[2]

    def direction(angle, a, b):
        x, y, z = (q - p for p, q in zip(a, b, strict=True))
        u = (math.cos(angle) * x - math.sin(angle) * y, math.sin(angle) * x + math.cos(angle) * y, z)
        n = math.hypot(*u)
        return [v / n for v in u] if n > 1e-12 else None

    rotations, directions = [], []
    for j, k in combinations(range(cameras), 2):
        ends = [(pose(j, w), pose(k, w)) for w in (0, 1)]
        turn = (ends[0][1][0] - ends[0][0][0]) - (ends[1][1][0] - ends[1][0][0])
        rotations.append(math.degrees(math.acos(max(-1.0, min(1.0, math.cos(turn))))))
        d, e = (direction(a[0], centre(*a), centre(*b)) for a, b in ends)
        if d and e:
            directions.append(math.degrees(math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(d, e, strict=True)))))))
    found = geometry.pose_agreement(table(0), table(1), block=block).first()
    assert (found.shared, found.pair_count, found.translation_pairs) == (cameras, len(rotations), len(directions))
    assert found.rotation_deg == pytest.approx(median(rotations), abs=1e-6)
    assert found.translation_deg == pytest.approx(median(directions), abs=1e-6)


def test_blocks_of_cameras_are_not_broadcast(spark):
    plan = pixel_queries.a10_geometry_consensus(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(?.*\[key#\d+, i#\d+, j#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[key#\d+, i#\d+", plan)


def test_every_part_is_a_raster(spark, tmp_path):
    spark.range(395, 412).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    rasters = {r.raster_id: r.n for r in bound(spark, str(tmp_path), "rasters").groupBy("raster_id").agg(F.count("*").alias("n")).collect()}
    assert rasters == {f"r{k:06d}": 48 for k in range(395, 412)}
    assert pixel_queries.a1_image_quality(spark, str(tmp_path)).count() == 17
    found = pixel_queries.a2_visual_similarity(spark, str(tmp_path)).collect()
    assert sorted((r.id1, r.id2) for r in found) == [(f"r{k:06d}", f"r{k + 1:06d}") for k in range(395, 411)]


@pytest.mark.parametrize("name", ["a2_visual_similarity", "x18_voxel_sums", "x18_zero_crossings"])
def test_parts_of_seven_digits(spark, tmp_path, name):
    # the rasters' ids have six digits: parts 1000000 to 1000009 are the raster 100000 too, which has several rows for a pixel
    spark.range(60).selectExpr("if(id < 20, 99995 + id, 999990 + id) as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sql = db.execute({**pixel_queries.ORACLES, **depth_queries.ORACLES}[name])
    columns = [d[0] for d in sql.description]
    found = {**pixel_queries.QUERIES, **depth_queries.QUERIES}[name](spark, str(tmp_path)).select(*columns)
    assert rows_of(columns, [tuple(r) for r in found.collect()]) == rows_of(columns, sql.fetchall())


@pytest.mark.parametrize("name", ["x10_consistent_depth", "a4_consistent_coverage"])
def test_consistent_depths_of_parts_of_seven_digits(spark, tmp_path, name):
    # several rows for a pixel of the rasters 100000 and 100001, of which some are valid and some are not
    spark.range(46).selectExpr("if(id < 16, 99995 + id, 999984 + id) as p_partkey", "cast((id * 7) % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sql = db.execute(depth_queries.ORACLES[name])
    columns = [d[0] for d in sql.description]
    found = depth_queries.QUERIES[name](spark, str(tmp_path)).select(*columns)
    rows = found.collect()
    assert rows_of(columns, [tuple(r) for r in rows]) == rows_of(columns, sql.fetchall())
    if name == "x10_consistent_depth":
        assert max(r.support for r in rows) > 5 and len(rows) == 46 * 48 > len({(r.camera, r.u, r.v) for r in rows})


def test_lags_of_whole_tracks(spark, tmp_path):
    n = 150  # samples of one track
    spark.range(n).selectExpr("id as event_id", "7L as user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "0.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    rows = bound(spark, str(tmp_path), "samples").orderBy("n").collect()
    want = {}
    for lag in range(-4, 5):
        x, y = zip(*((r.first, rows[r.n + lag].second) for r in rows if 0 <= r.n + lag < n), strict=True)
        want[lag] = (len(x), correlation(x, y))
    found = {r.lag: (r.overlap, r.correlation) for r in record_queries.sc12_correlations(spark, str(tmp_path)).collect()}
    assert {lag: v[0] for lag, v in found.items()} == {lag: n - abs(lag) for lag in want}
    assert all(found[lag][1] == pytest.approx(want[lag][1], abs=1e-8) for lag in want)
    best = max(want, key=lambda lag: want[lag][1])
    row = record_queries.w6_best_lag(spark, str(tmp_path)).first()
    assert (row.lag, row.overlap) == (best, n - abs(best))


def test_every_order_is_an_artifact(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    nodes = {r.artifact for r in bound(spark, SF, "artifact_nodes").where("kind = 'order'").collect()}
    assert nodes == {f"order:{r.o_orderkey}" for r in orders}
    edges = {(r.artifact, r.dependency) for r in bound(spark, SF, "artifact_edges").where("artifact like 'order:%'").collect()}
    assert edges == {(f"order:{r.o_orderkey}", f"customer:{r.o_custkey}") for r in orders}
    found = {r.artifact for r in record_queries.g3_invalidation(spark, SF).collect()}
    customers = {a for a in found if a.startswith("customer:")}
    assert {a for a in found if a.startswith("order:")} == {f"order:{r.o_orderkey}" for r in orders if f"customer:{r.o_custkey}" in customers}


def test_every_event_has_metadata(spark):
    events = {f"e{r.event_id:08d}" for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    assert {r.observation_id for r in record_queries.d1_metadata(spark, SF).collect()} == events
    assert {r.observation_id for r in record_queries.d4_input_classes(spark, SF).collect()} == events
    synced = {int(r.id1[1:]) % 2 for r in record_queries.j7_capture_time_sync(spark, SF).collect()}
    assert synced == {0, 1}
