"""Nearest neighbours by brute force: dense places, equal places, ties, and what a task gets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import neighbors


def brute_force(rows, most, radius):
    rows = [r for r in rows if r[0] is not None and all(v is not None and np.isfinite(v) for v in r[1:])]
    at = np.array([r[1:] for r in rows], float).reshape(-1, 3)
    out = set()
    for k, (a, *_) in enumerate(rows):
        step = at - at[k]
        far = np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1] + step[:, 2] * step[:, 2])
        near = sorted({(far[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != a and far[j] <= radius})[:most]
        out |= {(a, b, d) for d, b in near}
    return out


@pytest.mark.parametrize("leaf, seed", [(4, 0), (16, 1), (7, 2), (1000, 3)])
def test_neighbours_equal_brute_force(spark, leaf, seed):
    rng = random.Random(seed)
    rows = [(f"p{k:03d}", *(rng.uniform(-500, 500) for _ in range(3))) for k in range(90)]
    rows += [(f"q{k:03d}", *(40 + rng.gauss(0, 0.5) for _ in range(3))) for k in range(80)]  # dense
    rows += [(f"r{k:03d}", 7.0, -0.0, 3.0) for k in range(30)]  # one place
    rows += [(f"s{k:03d}", float(k % 5), float(k // 5 % 5), float(k // 25)) for k in range(50)]  # ties
    rows += [("far", 9e6, 9e6, -9e6), (None, 0.0, 0.0, 0.0), ("nan", float("nan"), 0.0, 0.0), ("null", None, 0.0, 0.0)]
    for most, radius in ((1, 1e9), (4, 60.0)):
        points = spark.createDataFrame(rows, "id string, x double, y double, z double")
        found = neighbors.neighbours(points, "id", most, radius, leaf_places=leaf).collect()
        assert len(found) == len({(r.a, r.b) for r in found})
        assert {tuple(r) for r in found} == brute_force(rows, most, radius)


def test_no_and_single_points(spark):
    points = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "id string, x double, y double, z double")
    assert neighbors.neighbours(points, "id", 3, 10.0).collect() == []
    assert neighbors.neighbours(points.limit(0), "id", 3, 10.0).collect() == []


def test_a_crowded_cube_is_spread(spark, monkeypatch):
    """100,000 points in a cube of one radius, a third of them at one place: same pairs, and no task gets many."""
    n, seen = 100_000, spark.sparkContext.accumulator(0)
    at = lambda k: F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30))
    points = spark.range(n).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), *(at(k).alias(c) for k, c in enumerate("xyz")))
    plain = neighbors._solve

    def counted(own, places, ids, most, limit):
        seen.add(len(own) * len(places))
        assert len(places) <= 1024
        return plain(own, places, ids, most, limit)

    monkeypatch.setattr(neighbors, "_solve", counted)
    found = neighbors.neighbours(points, "name", 2, 1.0, leaf_places=1024).cache()
    assert found.count() == 2 * n
    assert found.where("d = 0").select("a").distinct().count() == (n + 2) // 3
    some = {r.name: r[1:] for r in points.where("id % 997 = 1").collect()}
    all_rows = points.collect()
    names, where = np.array([r[0] for r in all_rows]), np.array([r[1:] for r in all_rows])
    got = {}
    for r in found.where(F.col("a").isin(*some)).collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    for name, place in some.items():
        step = where - np.array(place)
        far = np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1] + step[:, 2] * step[:, 2])
        first = np.lexsort((names, far))[:4]
        want = [(far[k], names[k]) for k in first if names[k] != name][:2]
        assert sorted(got[name]) == want
    assert 0 < seen.value < n * n / 10
