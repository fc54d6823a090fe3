"""Centroid clustering by brute force, and its edges."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from sightline.llm.clustering import centroid_clusters


def brute_force(rows, k, rounds, scale, width, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, some in groups.items():
            centroids[n] = tuple(sum(x) // len(some) for x in zip(*some, strict=True))
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def clustered(spark, rows, **more):
    vectors = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, n int, v string")
    return sorted((tuple(r)[:6] for r in centroid_clusters(vectors, **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    some = [[rng.gauss(c % 5, 0.4) for _ in range(4)] for c in range(60)]
    rows = [(i, rng.choice(some)) for i in range(200)] + [(300 + i, some[0]) for i in range(150)]
    rows += [(500, None), (501, [1.0, 2.0, 3.0]), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (None, [-0.5, 0.0, 0.0, 9.0]), (1, [2.0, 2.0, 2.0, 2.0]), (505, [])]
    how = {"k": 6, "rounds": 4, "scale": 1024, "width": 4, "seed": 3}
    assert clustered(spark, rows, **how) == brute_force(rows, **how)


def test_clusters_of_few_equal_and_no_vectors(spark):
    how = {"k": 8, "rounds": 3, "scale": 1024, "width": 2, "seed": 3}
    for rows in ([(1, [0.5, -0.5])], [(i, [1.0, 1.0]) for i in range(20)], [(1, None)], []):
        assert clustered(spark, rows, **how) == brute_force(rows, **how)


def test_large_components_stay_exact_or_are_refused(spark):
    how = {"k": 2, "rounds": 3, "scale": 1, "width": 2, "seed": 3}
    rows = [(i, [float((1 << 30) + i * 12345), -float(i) * (1 << 22)]) for i in range(30)]
    assert clustered(spark, rows, **how) == brute_force(rows, **how)
    with pytest.raises(Exception, match=r"(?s)Overflow|overflow|too large"):
        clustered(spark, [(1, [2.0**61, 0.0]), (2, [-(2.0**61), 0.0]), (3, [0.0, 0.0])], **{**how, "k": 1})
