"""The package's Spark data sources: byte ranges of PLY files, and sets that appear as a whole."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from sightline.plans import file_queries
from sightline.sources import datasource


def ply(values, head="ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex {n}\nproperty float x\nproperty float y\nend_header\n"):
    return head.format(n=len(values)).encode() + b"".join(struct.pack("<2f", *v) for v in values)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_ply_in_ranges(spark, tmp_path, block):
    datasource.register(spark)
    (tmp_path / "deep").mkdir()
    sizes = {"a.ply": 30, "deep/b.ply": 1, "c.ply": 0}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(ply([(k, k / 2) for k in range(n)]))
    (tmp_path / "other.txt").write_text("no")
    rows = spark.read.format("sightline_ply").option("properties", "x, y").option("block_bytes", block).load(str(tmp_path))
    found = sorted((r.path.removeprefix(f"{tmp_path}/"), r.vertex, r.x, r.y) for r in rows.collect())
    assert found == sorted((name, k, float(k), k / 2) for name, n in sizes.items() for k in range(n))
    tasks = rows.select(F.spark_partition_id()).distinct().count()
    assert tasks > 5 if block == 40 else tasks == 1
    one = spark.read.format("sightline_ply").option("properties", "x,y").load(str(tmp_path / "deep" / "b.ply"))
    assert one.count() == 1


def test_malformed_ply(spark, tmp_path):
    datasource.register(spark)
    read = lambda: spark.read.format("sightline_ply").option("properties", "x,y").load(str(tmp_path)).collect()
    good = ply([(1, 2)])
    for bad, message in ((good[:-1], "another size"), (good.replace(b"float y", b"float z"), "expected one"), (ply([(float("nan"), 0)]), "not finite"), (b"", "expected one")):
        (tmp_path / "x.ply").write_bytes(bad)
        with pytest.raises(Exception, match=message):
            read()
    with pytest.raises(Exception, match="properties"):
        spark.read.format("sightline_ply").load(str(tmp_path)).collect()


def test_a_set_appears_as_a_whole(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "sets" / "one"
    path.parent.mkdir()
    rows = spark.range(1000).repartition(4).withColumn("t", F.col("id").cast("string"))
    rows.write.format("sightline_set").mode("append").save(str(path))
    assert spark.read.parquet(str(path)).orderBy("id").collect() == rows.orderBy("id").collect()
    assert [p.name for p in path.parent.iterdir()] == ["one"]
    with pytest.raises(Exception, match="one"):
        rows.write.format("sightline_set").mode("append").save(str(path))
    rows.limit(7).write.format("sightline_set").mode("overwrite").save(str(path))
    assert spark.read.parquet(str(path)).count() == 7 and [p.name for p in path.parent.iterdir()] == ["one"]
    # a write that fails in one task leaves nothing, and not what it would have replaced
    broken = rows.withColumn("t", F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    for target in (path, path.parent / "two"):
        with pytest.raises(Exception, match="broken"):
            broken.write.format("sightline_set").mode("overwrite").save(str(target))
    assert [p.name for p in path.parent.iterdir()] == ["one"] and spark.read.parquet(str(path)).count() == 7


def test_small_files_are_many_tasks(spark, tmp_path):
    datasource.register(spark)
    for k in range(40):
        (tmp_path / str(k % 3)).mkdir(exist_ok=True)
        (tmp_path / str(k % 3) / f"{k}.ply").write_bytes(ply([(k, j) for j in range(k % 4)]))
    rows = spark.read.format("sightline_ply").option("properties", "x,y").option("block_bytes", 10 * datasource.OPEN_BYTES).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4  # ten to a task, though all their bytes are less than a block
    assert sorted((r.path.rsplit("/", 1)[1], r.vertex, r.x, r.y) for r in rows.collect()) == sorted((f"{k}.ply", j, float(k), float(j)) for k in range(40) for j in range(k % 4))


def test_files_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "BUILD_ROWS", 10)
    spark.range(45).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert file_queries._photos(spark, str(tmp_path)).rdd.getNumPartitions() == 5
    assert file_queries.t4_ply_records(spark, str(tmp_path)).count() == sum(k % 4 + 1 for k in range(45))
