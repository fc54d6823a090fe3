"""Cameras that share their poses are compared once for all, with the same medians."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import geometry


@pytest.mark.parametrize("seed", range(4))
def test_pairs_ahead_counts_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(geometry, "RUN", 3)
    rng = random.Random(seed)
    p, q = ([np.array([rng.randrange(20) for _ in range(rng.randrange(9))], np.int64) for _ in range(n)] for n in (4, 5))
    before = np.array([3, 0, 1, 0])
    want = [[sum(int(a < b) for a in x for b in y) + n * len(y) for y in q] for x, n in zip(p, before, strict=True)]
    assert geometry._pairs_ahead(p, before, q, 5).tolist() == want
    assert geometry._pairs_ahead([], before[:0], q, 5).shape == (0, 5) and not geometry._pairs_ahead(p, before, [], 0).size


def poses(spark, n, wrong):
    # two keys, a camera that occurs twice, poses without a value, hardly any order between pose and camera
    k = F.col("id")
    rows = spark.range(n).select(F.when(k % 3 == 0, "x").otherwise("y").alias("key"), F.format_string("c%04d", F.when(k == 7, 4).otherwise((k * 37) % n)).alias("camera"), (k % 5 * 0.3 + wrong * (k % 3) * 0.01).alias("angle"), (k % 7).cast("double").alias("a"))
    t = F.array(F.col("a"), F.when(F.col("a") == 6, F.lit(None)).otherwise(F.col("a") * F.col("a") + wrong), F.lit(0.5) + wrong * F.col("a"))
    return rows.select("key", "camera", geometry.rotation_about_z(F.col("angle")).alias("r"), t.alias("t"))


def test_shared_poses_count_for_all_pairs(spark, monkeypatch):
    tables = [poses(spark, 1009, wrong) for wrong in (0, 1)]
    monkeypatch.setattr(geometry, "REPEATS", 1 << 30)
    want = sorted(map(tuple, geometry.pose_agreement(*tables).collect()))
    monkeypatch.setattr(geometry, "REPEATS", 2)
    monkeypatch.setattr(geometry, "CHUNK_CAMERAS", 150)
    assert sorted(map(tuple, geometry.pose_agreement(*tables, block=20).collect())) == want


def test_pairs_do_not_grow_with_the_square_of_cameras(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(geometry, "_median_degrees", lambda rows, f=geometry._median_degrees: seen.append(rows.count()) or f(rows))
    for n in (1050, 4200):  # 105 poses
        tables = [poses(spark, n, wrong) for wrong in (0, 1)]
        geometry.pose_agreement(*tables).count()
    assert seen[1] <= 1.5 * seen[0]
