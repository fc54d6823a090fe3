"""Groups that would outgrow a task: pairs of a much seen point, classes of equal files; and plans that shuffle once."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import identity, metadata, pairs, photometry
from sightline.operators.checks import InvalidInput


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_pairs_within_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(g, rng.randrange(9), rng.choice("abc")) for g in ("g", "g", "g", "h", "i") for _ in range(9)] + [("j", 1, "a")]
    found = pairs.pairs_within(spark.createDataFrame(rows, "p string, n int, v string"), "p", ["n", "v"], block=block)
    want = Counter()
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        want.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    assert Counter((tuple(r.x), tuple(r.y)) for r in found.collect()) == want


def test_a_much_seen_point_is_many_tasks(spark, monkeypatch):
    n = 2000
    tracks = spark.range(n).select(F.lit(1).alias("point_id"), F.concat(F.lit("o"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("observation_id"))
    tracks = tracks.unionByName(tracks.limit(3).withColumn("point_id", F.lit(2)))
    found = pairs.shared_tracks(tracks, block=100)
    assert found.count() == n * (n - 1) // 2 and found.agg(F.sum("shared_points")).first()[0] == n * (n - 1) // 2 + 3
    met = pairs.pairs_within(tracks, "point_id", ["observation_id"], block=100).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(met) > 1
    samples = tracks.select("*", (F.xxhash64("observation_id") % 128 + 128).cast("int").alias("r"), F.lit(0).alias("g"), F.lit(9).alias("b"))
    monkeypatch.setattr(photometry, "pairs_within", lambda *a: pairs.pairs_within(*a, block=100))
    split = photometry.pixel_deltas(samples).agg(F.count("*"), F.sum("samples"), F.round(F.sum("mean_delta"), 6)).first()
    monkeypatch.setattr(photometry, "pairs_within", pairs.pairs_within)
    assert tuple(split) == tuple(photometry.pixel_deltas(samples).agg(F.count("*"), F.sum("samples"), F.round(F.sum("mean_delta"), 6)).first())


def test_duplicate_classes(spark):
    assets = spark.createDataFrame([(f"o{k:02d}", "h" if k < 30 else f"h{k % 4}", k % 2 if k >= 30 else 7) for k in range(40)] + [("o01", "h", 7)], "observation_id string, sha256 string, byte_length bigint")
    classes, members = identity.duplicate_classes(assets)
    assert sorted((r.class_id, r.n) for r in classes.collect()) == [("o00", 30), ("o30", 3), ("o31", 3), ("o32", 2), ("o33", 2)]
    assert members.count() == 40 and members.where("class_id = 'o00'").count() == 30
    listed = {r.observation_id: r.duplicates for r in identity.with_duplicates(assets).collect()}
    assert listed["o31"] == ["o35", "o39"] and len(listed["o00"]) == 29
    with pytest.raises(InvalidInput, match="too large"):
        identity.with_duplicates(assets, most=20)
    assert identity.duplicate_classes(assets.limit(0))[1].collect() == []


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_metadata_is_read_and_shuffled_once(spark, tmp_path):
    entries = spark.createDataFrame([("o", 0, "EXIF", "GPS GPSLatitude", "[1, 2, 3/2]")], "observation_id string, position int, namespace string, key string, value string")
    entries.write.parquet(str(tmp_path / "entries"))
    plan = plan_of(metadata.interpret_metadata(spark.read.parquet(str(tmp_path / "entries")))).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_image_quality_over_strips(spark):
    rng = random.Random(1)
    for w, h, missing in ((5, 11, ()), (1, 6, ()), (4, 9, ((2, 3), (1, 7)))):
        luma = {(x, y): rng.choice([0, 255, 40, 90]) for x in range(w) for y in range(h) if (x, y) not in missing}
        rows = spark.createDataFrame([("r", x, y, v) for (x, y), v in luma.items()], "raster_id string, x int, y int, luma int")
        r = photometry.image_quality(rows, strip=3).first()
        laps = [sum(luma[p] for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))) - 4 * v for (x, y), v in luma.items() if all(p in luma for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)))]
        mean = sum(laps) / len(laps) if laps else 0
        assert r.sharpness == (pytest.approx(sum((v - mean) ** 2 for v in laps) / len(laps)) if laps else None)
        assert r.black_ratio == pytest.approx(sum(v == 0 for v in luma.values()) / len(luma)) and r.mean_luma == pytest.approx(sum(luma.values()) / len(luma) / 255)
