from __future__ import annotations

import math

import pytest

from sightline.operators import clusters, graph, pairs
from sightline.operators.checks import InvalidInput


def sequence(spark, ids):
    return spark.createDataFrame([("s", x, i) for i, x in enumerate(ids)], "sequence_id string, observation_id string, position bigint")


@pytest.mark.parametrize(("quadratic", "edges"), [(False, "01 02 03 12 13 14 23 24 34"), (True, "01 02 04 12 13 23 24 34")])
def test_sequential_offsets(spark, quadratic, edges):
    found = pairs.sequential_pairs(sequence(spark, "zamby"), 3, quadratic=quadratic).collect()
    assert sorted(f"{min(r.index1, r.index2)}{max(r.index1, r.index2)}" for r in found) == edges.split()
    assert all(r.id1 < r.id2 and {"zamby"[r.index1], "zamby"[r.index2]} == {r.id1, r.id2} for r in found)


def test_sequential_repeated_id_fails(spark):
    with pytest.raises(InvalidInput):
        pairs.sequential_pairs(sequence(spark, "aba"), 2)


def points(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, latitude_deg double, longitude_deg double")


def test_pairs_across_the_antimeridian(spark):
    row = pairs.nearby_pairs(points(spark, [("a", 0.0, 179.9995), ("b", 0.0, -179.9995)]), 1, 150.0).first()
    assert (row.id1, row.id2) == ("a", "b")
    assert math.isclose(row.distance_m, 111.31949, rel_tol=1e-5)


def test_nearest_neighbour_cap(spark):
    found = pairs.nearby_pairs(points(spark, [("a", 0.0, 0.0), ("b", 0.0, 0.0001), ("c", 0.0, 0.0002)]), 1, 1000.0)
    assert sorted((r.id1, r.id2) for r in found.collect()) == [("a", "b"), ("b", "c")]


def test_coordinates_out_of_range_fail(spark):
    with pytest.raises(InvalidInput):
        pairs.nearby_pairs(points(spark, [("a", 91.0, 0.0)]), 1, 1.0)


def test_cosine_rejects_other_lengths(spark):
    with pytest.raises(InvalidInput):
        pairs.cosine_pairs(spark.createDataFrame([("a", [1.0, 1.0])], "observation_id string, descriptor array<float>"), 1)


def test_cosine_blocks_agree(spark):
    rows = [(f"o{i:02d}", [math.cos(i * 0.7), math.sin(i * 0.7)]) for i in range(23)]
    df = spark.createDataFrame(rows, "observation_id string, descriptor array<double>")
    one, many = (sorted((r.id1, r.id2, round(r.similarity, 9)) for r in pairs.cosine_pairs(df, 3, block=b).collect()) for b in (1000, 4))
    assert one == many


def test_cosine_rows_are_not_copied_to_meet(spark, monkeypatch):
    # rows were sent once for each block, and every pair of blocks sent on the best of its rows
    n, seen, made = 60, [], {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pairs, "scratch", lambda df, label, *a, f=pairs.scratch: seen.append(plan(df)) or made.setdefault(label, f(df, label, *a)))
    angles = [(k * 7 % 20) * 0.3 for k in range(n)]  # of each vector there are three
    names = [f"o{k:02d}" for k in range(n - 1)] + ["o03"]  # an id with two rows
    df = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in zip(names, angles, strict=True)], "observation_id string, descriptor array<double>")
    found = {(r.a, r.k): (r.b, round(r.s, 9)) for r in pairs.cosine_neighbours(df, 4, block=4).collect()}
    want = {}
    for name in set(names):
        ranked = sorted((-round(math.cos(a - b), 9) + 0.0, other) for i, a in zip(names, angles, strict=True) if i == name for other, b in zip(names, angles, strict=True) if other != name)
        want |= {(name, k + 1): (b, -s + 0.0) for k, (s, b) in enumerate(ranked[:4])}
    assert found == want
    assert made["cosine-found"].count() == 4 * n and len(made["cosine-rows"].inputFiles()) > 5
    assert not [p for p in seen if "Generate" in p]


def test_recall_without_relevant_pairs_has_no_recall(spark):
    none = spark.createDataFrame([], "id1 string, id2 string")
    cand = spark.createDataFrame([("a", "b", "x")], "id1 string, id2 string, source_id string")
    found = {(r.source_id, r.metric): r.value for r in pairs.recall(none, cand).collect()}
    assert ("x", "recall") not in found and found["x", "candidate_count"] == 1.0


def relations(spark, rows):
    ref = "array<struct<kind:string,id:string>>"
    return spark.createDataFrame([(a, b, d, [("m", f"{a}{b}")]) for a, b, d in rows], f"id1 string, id2 string, disposition string, evidence {ref}")


def observations(spark, ids):
    return spark.createDataFrame([(x,) for x in ids], "observation_id string")


def test_look_alikes_stay_apart_and_conflicts_raise(spark):
    ids = ["a1", "a2", "b1", "b2"]
    rows = [("a1", "a2", "SUPPORTED"), ("b1", "b2", "SUPPORTED"), ("a2", "b1", "UNRESOLVED")]
    found = clusters.scene_clusters(observations(spark, ids), relations(spark, rows)).collect()
    assert sorted(r.members for r in found) == [["a1", "a2"], ["b1", "b2"]]
    with pytest.raises(InvalidInput):
        clusters.scene_clusters(observations(spark, ids), relations(spark, [*rows[:2], ("a2", "b1", "SUPPORTED"), ("a1", "b2", "CONTRADICTED")]))


@pytest.mark.parametrize("rows", [[("b", "a", "SUPPORTED")], [("a", "b", "SUPPORTED"), ("a", "b", "UNRESOLVED")], [("a", "z", "SUPPORTED")]])
def test_malformed_relations_fail(spark, rows):
    with pytest.raises(InvalidInput):
        clusters.scene_clusters(observations(spark, "ab"), relations(spark, rows))


def test_alone_is_a_cluster(spark):
    row = clusters.scene_clusters(observations(spark, "a"), relations(spark, [])).first()
    assert row.members == ["a"] and row.evidence == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_connectivity(spark):
    edges = spark.createDataFrame([("a", "b")], "id1 string, id2 string")
    assert clusters.is_connected(observations(spark, "ab"), edges)
    assert not clusters.is_connected(observations(spark, "abc"), edges)


def test_tracks_keep_the_least_feature(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 2), (1, "b", 0)], "point_id long, observation_id string, feature_index int")
    assert sorted(tuple(r) for r in pairs.canonical_tracks(rows).collect()) == [(1, "a", 2), (1, "b", 0)]
    with pytest.raises(InvalidInput):
        pairs.canonical_tracks(spark.createDataFrame([(1, "a", -1)], "point_id long, observation_id string, feature_index int"))


def test_scene_labels_are_the_clusters(spark):
    rel = "id1 string, id2 string, disposition string, evidence array<struct<kind:string,id:string>>"
    rows = [("a", "b", "SUPPORTED", [("k", "1")]), ("b", "c", "SUPPORTED", [("k", "2")]), ("d", "e", "UNRESOLVED", [])]
    obs, relations = spark.createDataFrame([(x,) for x in "abcde"], "observation_id string"), spark.createDataFrame(rows, rel)
    labels = {r.observation_id: r.root for r in clusters.scene_labels(obs, relations).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert sorted(tuple(r.members) for r in clusters.scene_clusters(obs, relations).collect()) == [("a", "b", "c"), ("d",), ("e",)]
    with pytest.raises(InvalidInput):
        clusters.scene_labels(obs, spark.createDataFrame([*rows, ("a", "c", "CONTRADICTED", [])], rel))


def test_recall_by_label_is_recall(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 1), ("e", None)], "observation_id string, label int")
    relevant = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "d")], "id1 string, id2 string")
    found = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "d", "y"), ("a", "b", "y"), ("a", "e", "y"), ("e", "e", "x")], "id1 string, id2 string, source_id string")
    for some in (found, found.limit(0)):
        one, two = (sorted(map(tuple, x.collect())) for x in (pairs.recall(relevant, some, "x"), pairs.recall_by_label(labels, some, "x")))
        assert one == two


def test_tables_are_broadcast_by_rows_and_bytes(spark):
    from sightline import scratch

    small = scratch.scratch(spark.range(100), "small", rows=100)
    assert 0 < scratch.stored_bytes(small) < 100_000 and "Hint broadcast" in scratch.lookup(small)._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" not in scratch.lookup(small, limit=99)._jdf.queryExecution().logical().toString()
    made = spark.createDataFrame([(1,)], "a int")  # a source that does not know its size
    assert scratch.stored_bytes(made) >= 1 << 62 and scratch.stored_bytes(made, unknown=0) == 0
    assert len(small.inputFiles()) <= scratch.LEAST_PARTS
