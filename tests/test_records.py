from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import decisions, geometry, identity, metadata, photometry
from sightline.operators.checks import InvalidInput

RECORD = "record_type string, record_id string, payload string"


def test_put_is_idempotent_and_conflicts_fail(spark):
    stored = spark.createDataFrame([("t", "1", "a")], RECORD)
    assert identity.put_records(stored, spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "2", "b")], RECORD)).count() == 2
    for rows in ([("t", "1", "x")], [("t", "3", "x"), ("t", "3", "y")]):
        with pytest.raises(InvalidInput):
            identity.put_records(stored, spark.createDataFrame(rows, RECORD))


def test_key_json_is_that_of_python(spark):
    rows = spark.createDataFrame([("x", None, 3)], "b string, a string, c int")
    row = rows.select(identity.canonical_key_json(rows, ["b", "a", "c"]).alias("j")).first()
    assert row.j == identity.canonical_json({"a": None, "b": "x", "c": 3}, ascii_only=True)
    assert identity.canonical_json({"b": "é"}) == '{"b":"é"}' and identity.canonical_json({"b": "é"}, ascii_only=True) == '{"b":"\\u00e9"}'
    with pytest.raises(InvalidInput):
        identity.parse_json_object("[1]")


def dag(spark, edges, nodes):
    return spark.createDataFrame([(n, "k") for n in nodes], "artifact string, kind string"), spark.createDataFrame(edges, "artifact string, dependency string")


def test_dag_checks(spark):
    nodes, edges = dag(spark, [("b", "a"), ("c", "b"), ("c", "a")], "abc")
    assert identity.check_dag(nodes, edges) == 3
    for bad in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "z")]):
        with pytest.raises(InvalidInput):
            identity.check_dag(*dag(spark, bad, "ab"))
    found = {r.artifact: r.depth for r in identity.invalidation_closure(nodes, edges, nodes.where("artifact = 'a'").select("artifact")).collect()}
    assert found == {"a": 0, "b": 1, "c": 1}
    with pytest.raises(InvalidInput):
        identity.invalidation_closure(nodes, edges, spark.createDataFrame([("z",)], "artifact string"))


@pytest.mark.parametrize(("path", "safe"), [("a/b.txt", True), ("", False), ("/a", False), ("a/../b", False), ("./a", False), ("a//b", False), ("a\\b", False), ("C:/a", False), ("a/", False), ("a..b", True), (".hidden", True)])
def test_paths(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(identity.safe_path(F.col("p")).alias("s")).first().s is safe
    assert identity.safe_path_text(path) is safe


def entries(spark, **values):
    rows = [("o", i, "EXIF", k, v) for i, (k, v) in enumerate(values["pairs"])]
    return spark.createDataFrame(rows, "observation_id string, position int, namespace string, key string, value string")


POSITION = [(metadata.LATITUDE, "[10, 30, 36]"), (metadata.LATITUDE_REF, "S"), (metadata.LONGITUDE, "[20, 15, 27/5]"), (metadata.LONGITUDE_REF, "E")]


@pytest.mark.parametrize(
    ("pairs", "gps", "time"),
    [
        (POSITION, "RESOLVED", "ABSENT"),
        (POSITION[:3], "INCOMPLETE", "ABSENT"),
        ([*POSITION, POSITION[0]], "INVALID", "ABSENT"),
        ([(metadata.LATITUDE, "[1, 60, 0]"), *POSITION[1:]], "INVALID", "ABSENT"),
        ([("GPS GPSAltitude", "5")], "INCOMPLETE", "ABSENT"),
        ([("Image Make", "x")], "ABSENT", "ABSENT"),
        ([(metadata.TIME, "2024:02:29 10:00:00")], "ABSENT", "LOCAL_AMBIGUOUS"),
        ([(metadata.TIME, "2024:02:30 10:00:00")], "ABSENT", "INVALID"),
        ([(metadata.OFFSET, "+01:00")], "ABSENT", "INVALID"),
        ([(metadata.TIME, "2024:02:29 10:00:00"), (metadata.OFFSET, "+01:00")], "ABSENT", "RESOLVED"),
        ([(metadata.TIME, "2024:02:29 10:00:00"), (metadata.OFFSET, "+24:00")], "ABSENT", "INVALID"),
    ],
)
def test_metadata_states(spark, pairs, gps, time):
    row = metadata.interpret_metadata(entries(spark, pairs=pairs)).first()
    assert (row.gps_status, row.time_status) == (gps, time)
    if gps == "RESOLVED":
        assert row.latitude_deg == pytest.approx(-10.51) and row.longitude_deg == pytest.approx(20.2515)
    if time == "RESOLVED":
        assert row.instant_us == 1709197200 * 1_000_000


def policy(spark, metrics, failures=()):
    rules = spark.createDataFrame([("m", True, "higher_is_better", 1.0, "retry")], "metric string, required boolean, direction string, threshold double, decision string")
    mapped = spark.createDataFrame([("timeout", "escalate")], "failure string, decision string")
    m = spark.createDataFrame([("s", *x) for x in metrics], "subject string, metric string, direction string, value double")
    f = spark.createDataFrame([("s", x) for x in failures], "subject string, failure string")
    row = decisions.evaluate_policy(m, f, rules, mapped).first()
    return row.decision, row.reasons.split("|")[0].split(":")[0]


def test_policy_precedence(spark):
    up, down = "higher_is_better", "lower_is_better"
    assert policy(spark, [("m", up, 1.0)]) == ("pass", "")
    assert policy(spark, [("m", up, 0.5)]) == ("retry", "metric_threshold_violation")
    assert policy(spark, [("m", up, 0.5)], ["timeout"]) == ("escalate", "mapped_failure")
    assert policy(spark, [("m", down, 0.5)]) == ("unresolved", "metric_direction_mismatch")
    assert policy(spark, [("x", up, 0.5)]) == ("unresolved", "missing_required_metric")
    assert policy(spark, [("m", up, 2.0)], ["other"]) == ("unresolved", "unmapped_failure")


def test_photometric_masks(spark):
    row = spark.createDataFrame([([0, 255, 255, 64, 255, 128], 1.0, [1.0, 0.5, 2.0])], "codes array<int>, ev double, gains array<double>")
    row = row.withColumn("n", photometry.normalize_linear(photometry.linear_rgb(F.col("codes")), F.pow(F.lit(2.0), F.col("ev")), F.col("gains")))
    masks = row.select(photometry.validity_masks(F.col("codes"), F.col("n")).alias("m")).first().m
    assert ("".join(map(str, masks.low)), "".join(map(str, masks.high)), "".join(map(str, masks.above_one))) == ("100000", "011010", "001000")


def test_pyramid(spark):
    found = photometry.pyramid_levels(spark.createDataFrame([("a", 10, 3), ("b", 1, 1)], "image_id string, width int, height int"), 2).orderBy("image_id", "level").collect()
    assert [(r.image_id, r.level, r.width, r.height) for r in found] == [("a", 0, 10, 3), ("a", 1, 5, 1), ("a", 2, 2, 1), ("b", 0, 1, 1)]


def test_consensus_does_not_depend_on_the_frame(spark):
    rows = [(s, f"c{k}", k * 0.3 + (0.01 * k if s == "B" else 0), [float(k), float(k * k % 5), 0.5]) for s in "AB" for k in range(5)]
    df = spark.createDataFrame(rows, "solution string, camera string, angle double, t array<double>")
    df = df.withColumn("r", geometry.rotation_about_z(F.col("angle")))
    turned = df.withColumn("r", F.when(F.col("solution") == "B", geometry.rotation_about_z(F.col("angle") + 0)).otherwise(F.col("r")))
    same = [{(r.metric): round(r.value, 9) for r in geometry.geometry_consensus(x.select("solution", "camera", "r", "t")).collect()} for x in (df, turned)]
    assert same[0] == same[1] and same[0]["shared_camera_ratio"] == 1.0


def test_consensus_of_one_shared_camera_has_the_ratio_alone(spark):
    df = spark.createDataFrame([("A", "x", 0.0), ("B", "x", 0.1), ("B", "y", 0.2)], "solution string, camera string, angle double").select("solution", "camera", geometry.rotation_about_z(F.col("angle")).alias("r"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("t"))
    assert [(r.metric, r.value) for r in geometry.geometry_consensus(df).collect()] == [("shared_camera_ratio", 0.5)]


def test_depth_errors_without_joint_pixels_are_null(spark):
    row = geometry.depth_errors(spark.createDataFrame([("c", 1.0, True, 2.0, False), ("c", 0.0, False, 2.0, True)], "camera string, depth double, valid boolean, reference_depth double, reference_valid boolean")).first()
    assert (row.reference_coverage, row.median_abs_error, row.median_rel_error) == (0.0, None, None)
    with pytest.raises(InvalidInput):
        geometry.check_depth(spark.createDataFrame([(0.0, True, None)], "depth double, valid boolean, confidence double"))


def test_surface_ratios_of_no_edges_are_left_out(spark):
    cols = "triangle_count vertex_count finite_vertex_count degenerate_triangle_count unique_edge_count boundary_edge_count non_manifold_edge_count connected_component_count largest_component_triangle_count".split()
    df = spark.createDataFrame([("s", 4, 5, 5, 1, 0, 0, 0, 1, 4)], "surface_id string, " + ", ".join(f"{c} bigint" for c in cols))
    assert sorted(r.metric for r in decisions.surface_metrics(df).collect()) == ["connected_component_count", "degenerate_triangle_ratio", "finite_vertex_ratio", "largest_component_triangle_ratio"]


def test_references_must_be_unique_and_ordered(spark):
    refs = lambda rows: spark.createDataFrame([("o", i, k, x) for i, (k, x) in enumerate(rows)], "owner string, position int, kind string, id string")
    identity.check_references(refs([("a", "2"), ("b", "1")]))
    identity.check_references(refs([("b", "1"), ("a", "2")]), order=("id", "kind"))
    for bad in ([("b", "1"), ("a", "2")], [("a", "1"), ("a", "1")]):
        with pytest.raises(InvalidInput):
            identity.check_references(refs(bad))


def test_ancestry(spark):
    rows = lambda *x: spark.createDataFrame([tuple(v) for v in x], "id string, kind string")
    identity.check_ancestry(rows("ak", "bk"), rows("bk", "ak", "ak"))
    for result, inputs in ((rows("ak"), rows("ak", "bk")), (rows("ak", "bk"), rows("ak"))):
        with pytest.raises(InvalidInput):
            identity.check_ancestry(result, inputs)
    with pytest.raises(InvalidInput):
        identity.check_new_identity(rows("ak").select("id"), rows("ak").select("id"))


def test_router_checks(spark):
    arts = spark.createDataFrame([("x", "k"), ("x", "j")], "artifact_id string, kind string")
    with pytest.raises(InvalidInput):
        decisions.check_router_input(arts)
    reasons = spark.createDataFrame([("r", "c", "y", "k")], "reason_id string, code string, artifact_id string, kind string")
    with pytest.raises(InvalidInput):
        decisions.check_route_reasons(reasons, arts)


def test_payload_is_json(spark):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(rows.select(identity.canonical_key_json(rows, ["b", "a"]).alias("j")).first().j) == {"a": 1, "b": None}
