from __future__ import annotations

import pytest

from sightline.operators import contracts, ingest
from sightline.operators.checks import InvalidInput
from sightline.plans import contract_queries


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_environment():
    contracts.check_environment({"a": "1"}, {"a": "1", "b": "2"}, ("b",))
    for found in ({"a": "2", "b": "2"}, {"a": "1"}):
        with pytest.raises(InvalidInput):
            contracts.check_environment({"a": "1"}, found, ("b",))


def test_membership(spark):
    want = frame(spark, "k string", ("a",), ("b",))
    contracts.check_membership(want, want, ["k"])
    for bad in ([("a",)], [("a",), ("b",), ("c",)], [("a",), ("b",), ("b",)]):
        with pytest.raises(InvalidInput):
            contracts.check_membership(want, frame(spark, "k string", *bad), ["k"])


def test_matches_and_geometry(spark):
    matches = contracts.canonical_matches(frame(spark, "a string, b string, raw_matches long", ("y", "x", 5)))
    assert [tuple(r) for r in matches.collect()] == [("x", "y", 5, True)]
    geometry = "id1 string, id2 string, configuration string, inliers long"
    assert contracts.verified_geometry(matches, frame(spark, geometry, ("x", "y", "PLANAR", 5))).count() == 1
    for bad in ([], [("x", "y", "PLANAR", 6)], [("x", "y", "PLANAR", 5), ("x", "z", "PLANAR", 1)]):
        with pytest.raises(InvalidInput):
            contracts.verified_geometry(matches, frame(spark, geometry, *bad))
    for bad in ([("x", "x", 1)], [("x", "y", 1), ("y", "x", 1)]):
        with pytest.raises(InvalidInput):
            contracts.canonical_matches(frame(spark, "a string, b string, raw_matches long", *bad))


def test_publication(spark):
    plans = frame(spark, "key string, configuration string, parent string", ("k", "c", None))
    contracts.check_publication(plans, plans)
    for bad in (("k", "c", "p"), ("k", "d", None), ("z", "c", None)):
        with pytest.raises(InvalidInput):
            contracts.check_publication(frame(spark, "key string, configuration string, parent string", bad), plans)


def test_derived_artifacts(spark):
    ids = lambda *x: frame(spark, "id string", *((v,) for v in x))
    refs = frame(spark, "id string, kind string", ("a", "k"))
    contracts.check_derived(refs, refs, ids("new"), ids("old"), (ids("f"), ids("f")))
    contracts.check_refinement(ids("new"), ids("old"), "UNRESOLVED")
    with pytest.raises(InvalidInput):
        contracts.check_derived(refs, refs, ids("new"), ids("old"), (ids("f"), ids("g")))
    with pytest.raises(InvalidInput):
        contracts.check_refinement(ids("new"), ids("old"), "METRIC")
    with pytest.raises(InvalidInput):
        contracts.check_refinement(ids("old"), ids("old"), "UNRESOLVED")


def test_canonical_model(spark):
    cameras = frame(spark, "name string, f double", ("n1", 1.0))
    row = contracts.canonical_model(cameras, frame(spark, "name string, observation_id string", ("n1", "o1"))).first()
    assert (row.observation_id, row.scale_status) == ("o1", "UNRESOLVED")
    with pytest.raises(InvalidInput):
        contracts.canonical_model(cameras, frame(spark, "name string, observation_id string", ("n2", "o1")))


REQUEST = "observation_id string, source_id string, uri string, sha256 string, byte_length long, mime_type string, received_us long"


def test_ingest_reports_and_keeps_duplicates(spark):
    row = lambda i, c: (i, "s", "u", c * 64, 3, "image/png", 1)
    stored = ingest.observations(frame(spark, REQUEST, row("b", "A"), row("a", "a")), "image")
    batch = ingest.observations(frame(spark, REQUEST, row("c", "a"), row("d", "b")), "image")
    after, report = ingest.ingest(stored, batch)
    assert after.count() == 4 and {r.observation_id: r.duplicates for r in report.collect()} == {"c": ["a", "b"], "d": []}
    for bad in (row("a b", "a"), row("a", "g"), ("a", "s", "u", "a" * 64, -1, "m", 1)):
        with pytest.raises(InvalidInput):
            ingest.observations(frame(spark, REQUEST, bad), "image")


def test_two_runs_may_give_the_same_pair(spark, tmp_path):
    # 2750 gives (i2750, i2250), and 2250 gives (i2250, i2750)
    spark.createDataFrame([(2250,), (2750,), (7,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = sorted((r.id1, r.id2, r.raw_matches) for r in contract_queries.x2_matches(spark, str(tmp_path)).collect())
    assert found == sorted([("i2250", "i2750", 10), ("i2250", "i2750", 60), ("i0007", "i0049", 17)])
