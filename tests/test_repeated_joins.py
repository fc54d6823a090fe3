"""What each round or batch joins does not go through the driver once it has more than a few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import scratch as tables
from sightline.operators import checks, clusters, graph
from sightline.streaming import keyed, scenes

NAMES = [f"o{i:04d}" for i in range(300)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_met_broadcasts_few_rows_only(spark):
    small = tables.scratch(spark.range(50).withColumnRenamed("id", "k"), "few")
    joined = lambda limit: plan_of(spark.range(1000).join(tables.met(small, limit), F.col("id") == F.col("k")))
    assert "BroadcastHashJoin" in joined(50) and "BroadcastHashJoin" not in joined(49)


def test_batches_of_scenes_broadcast_nothing_large(spark, tmp_path, monkeypatch):
    seen = []
    for module in (graph, scenes, keyed, clusters):
        monkeypatch.setattr(module, "scratch", lambda df, *a, **b: seen.append(plan_of(df)) or tables.scratch(df, *a, **b))
    monkeypatch.setattr(tables, "REPEATED_ROWS", -1)  # not even empty ones
    monkeypatch.setattr(scenes, "FEW_EDGES", 0)
    monkeypatch.setattr(keyed, "FILE_ROWS", 100)
    observations = spark.createDataFrame([(n,) for n in NAMES], "observation_id string")
    rows = [(NAMES[i], NAMES[i + 1], "CONTRADICTED" if i % 50 == 49 else "SUPPORTED", [("k", str(i))]) for i in range(250)]
    log = scenes.SceneLog(spark, str(tmp_path / "log"), observations)
    for number, some in enumerate((rows[:120], rows[120:])):
        log.add(spark.createDataFrame(some, scenes.RELATION), number)
    found, records = log.labels, log.clusters
    assert len(seen) > 20 and not [p for p in (*seen, plan_of(found), plan_of(records)) if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
    assert {r.observation_id: r.root for r in found.collect()} == {n: NAMES[i // 50 * 50] if i < 250 else n for i, n in enumerate(NAMES)}
    assert sorted((len(r.members), len(r.evidence)) for r in records.collect()) == [(1, 0)] * 50 + [(50, 49)] * 5


def test_clusters_broadcast_neither_labels_nor_evidence(spark):
    labels = tables.scratch(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "observation_id string, root string"), "few-labels")
    relations = tables.scratch(spark.createDataFrame([("a", "b", "SUPPORTED", [("k", "1")]), ("b", "c", "UNRESOLVED", [("k", "2")])], scenes.RELATION), "few-relations")
    found = clusters.clusters_of(labels, relations)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert sorted((r.members, [e.id for e in r.evidence]) for r in found.collect()) == [(["a", "b"], ["1"]), (["c"], [])]


def test_labels_of_all_relations_broadcast_nothing_large(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clusters, "assert_empty", lambda df, message: seen.append(plan_of(df)) or checks.assert_empty(df, message))
    monkeypatch.setattr(tables, "REPEATED_ROWS", -1)  # not even empty ones
    observations = tables.scratch(spark.createDataFrame([(n,) for n in "abcd"], "observation_id string"), "few-observations")
    rows = [("a", "b", "SUPPORTED", [("k", "1")]), ("b", "c", "CONTRADICTED", [("k", "2")])]
    relations = tables.scratch(spark.createDataFrame(rows, scenes.RELATION), "few-relations")
    found = clusters.scene_labels(observations, relations)
    assert len(seen) == 3 and not [p for p in seen if "BroadcastHashJoin" in p]
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert not clusters.is_connected(observations, relations) and clusters.is_connected(spark.createDataFrame([("a",), ("b",)], "observation_id string"), relations.where("disposition = 'SUPPORTED'"))
