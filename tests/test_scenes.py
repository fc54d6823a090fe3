"""Scene labels kept up batch by batch, and the keyed log below them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.checks import InvalidInput
from sightline.operators.clusters import scene_clusters, scene_labels
from sightline.streaming import keyed
from sightline.streaming.live import RecordTable
from sightline.streaming.scenes import RELATION, SceneLog


def relations(spark, rows):
    return spark.createDataFrame([(a, b, d, [("scene.relationship", f"{a}{b}")]) for a, b, d in rows], RELATION)


def observations(spark, names):
    return spark.createDataFrame([(n,) for n in names], "observation_id string")


def labelled(df):
    return sorted(map(tuple, df.select("observation_id", "root").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_labels_equal_those_of_all_so_far_after_every_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = [f"o{i:02d}" for i in range(40)]
    pairs = sorted(rng.sample([(a, b) for a in names for b in names if a < b], 36))
    rows = [(a, b, rng.choice(["SUPPORTED", "SUPPORTED", "UNRESOLVED"])) for a, b in pairs]
    folder = str(tmp_path / "log")
    cuts = [0, 9, 9, 20, 36]  # one batch is empty
    for number, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        log = SceneLog(spark, folder, observations(spark, names))  # a new driver each time
        log.add(relations(spark, rows[lo:hi]), number)
        log.add(relations(spark, rows[lo:hi]), number)  # the same batch again
        assert labelled(log.labels) == labelled(scene_labels(observations(spark, names), relations(spark, rows[:hi])))
    got, want = SceneLog(spark, folder).clusters, scene_clusters(observations(spark, names), relations(spark, rows))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert SceneLog(spark, folder).rows.count() == 36


def test_a_contradiction_stops_the_batch_that_makes_it(spark, tmp_path):
    names = list("abcdefgh")
    log = SceneLog(spark, str(tmp_path / "log"), observations(spark, names))
    log.add(relations(spark, [("a", "b", "SUPPORTED"), ("a", "f", "CONTRADICTED"), ("a", "h", "CONTRADICTED")]), 0)
    log.add(relations(spark, [("c", "d", "SUPPORTED"), ("c", "g", "CONTRADICTED")]), 1)
    log.add(relations(spark, [("d", "e", "SUPPORTED"), ("d", "f", "SUPPORTED")]), 2)  # f hangs on c now
    assert log.touched == {"relations": 2, "edges": 2, "renamed": 2, "tested": 1}
    for bad in ([("d", "g", "SUPPORTED")], [("e", "h", "SUPPORTED"), ("f", "h", "UNRESOLVED"), ("g", "h", "SUPPORTED")], [("e", "f", "CONTRADICTED")]):
        with pytest.raises(InvalidInput, match="contradicted pair"):
            log.add(relations(spark, bad), 3)
        assert SceneLog(spark, log.folder).marks.last()[0] == 2
    with pytest.raises(InvalidInput, match="contradicted pair"):  # b is in the cluster of a, f in that of c
        log.add(relations(spark, [("e", "h", "UNRESOLVED"), ("f", "h", "SUPPORTED"), ("g", "h", "SUPPORTED")]), 3)
    log.add(relations(spark, [("g", "h", "SUPPORTED")]), 3)
    assert labelled(log.labels) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("f", "c"), ("g", "g"), ("h", "g")]


def test_bad_batches_add_nothing(spark, tmp_path):
    log = SceneLog(spark, str(tmp_path / "log"), observations(spark, "abcd"))
    log.add(relations(spark, [("a", "c", "SUPPORTED")]), 0)
    for bad, message in (([("a", "b", "SUPPORTED")], "rise"), ([("b", "c", "SUPPORTED")] * 2, "rise"), ([("d", "b", "SUPPORTED")], "order"), ([("b", "x", "UNRESOLVED")], "unknown"), ([("c", None, "SUPPORTED")], "order")):
        with pytest.raises(InvalidInput, match=message):
            log.add(relations(spark, bad), 1)
    assert labelled(log.labels) == [("a", "a"), ("b", "b"), ("c", "a"), ("d", "d")]
    with pytest.raises(InvalidInput, match="twice"):
        SceneLog(spark, str(tmp_path / "other"), observations(spark, "aab")).add(relations(spark, []), 0)
    with pytest.raises(ValueError, match="needs the observations"):
        SceneLog(spark, str(tmp_path / "third")).add(relations(spark, []), 0)


def test_a_batch_touches_what_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 40)
    names = [f"o{i:04d}" for i in range(900)]
    log = SceneLog(spark, str(tmp_path / "log"), observations(spark, names))
    log.add(relations(spark, [(names[i], names[i + 1], "SUPPORTED") for i in range(500)]), 0)
    log.add(relations(spark, [(names[600], names[601], "CONTRADICTED"), (names[602], names[603], "CONTRADICTED")]), 1)
    log.add(relations(spark, [(names[700], names[701], "SUPPORTED")]), 2)
    assert log.touched == {"relations": 1, "edges": 1, "renamed": 1, "tested": 0}
    assert log.known.read_files < log.known.all_files / 4
    log.add(relations(spark, [(names[701], names[702], "SUPPORTED"), (names[702], names[703], "SUPPORTED")]), 3)
    assert log.touched["renamed"] == 2 and log.renames.read_files <= 4
    assert labelled(log.labels)[699:704] == [(names[699], names[699]), *((n, names[700]) for n in names[700:704])]


def test_keyed_log_reads_only_files_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 100)
    log = keyed.KeyedLog(spark, str(tmp_path / "log"), "kind string, id bigint, v string", ["kind", "id"])
    live = []
    rows = spark.range(3000).select(F.lit("t").alias("kind"), "id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    for lo, hi in ((0, 2000), (2000, 2400), (2400, 2480)):
        live = log.add(live, rows.where(F.col("id").between(lo, hi - 1)), hi - lo)
    assert [s.rows for s in live] == [2000, 400, 80] and [s.buckets for s in live] == [20, 4, 1]
    keys = keyed.stored_keys(spark.createDataFrame([("t", 7), ("t", 2001), ("t", 9999), ("u", 7)], "kind string, id bigint"), ["kind", "id"])
    assert sorted(r.v for r in log.find(live, keys).collect()) == ["v2001", "v7"]
    assert log.read_files <= 5 and log.all_files == 25
    absent = keyed.stored_keys(spark.range(100_000, 100_050).select(F.lit("t").alias("kind"), "id"), ["kind", "id"])
    assert not log.find(live, absent).count() and log.read_files <= 3
    more = log.add(live, rows.where("id >= 2480"), 520)  # takes in its neighbours
    assert [s.rows for s in more] == [3000]
    assert sorted(r.id for r in log.rows(more).collect()) == list(range(3000)) == sorted([*(r.id for r in log.rows(live).collect()), *range(2480, 3000)])
    log.discard([s for s in live if s not in more])
    assert log.rows(more).count() == 3000


def test_record_batches_read_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 50)
    table = RecordTable(spark, str(tmp_path / "records"))
    rows = spark.range(2000).select(F.lit("t").alias("record_type"), F.col("id").cast("string").alias("record_id"), F.lit("x").alias("payload"))
    table.add(rows, 0)
    table.add(spark.createDataFrame([("t", "5", "x"), ("t", "new", "y")], rows.schema), 1)
    assert table.touched["added"] == 1 and table.touched["files"] <= 3 and table.touched["of"] == 40
    with pytest.raises(InvalidInput):
        table.add(spark.createDataFrame([("t", "new", "z")], rows.schema), 2)
    for number in range(2, 6):
        table.add(spark.createDataFrame([("u", str(number), "x")], rows.schema), number)
    assert table.rows.count() == 2005 and len(table.marks.numbers()) == 2
    folders = {p.name for p in (tmp_path / "records" / "records").iterdir()}
    named = {s.name for k in table.marks.numbers() for s in keyed.segments_of(table.marks.read(k), "records")}
    assert named <= folders and len(folders) == len(named)
