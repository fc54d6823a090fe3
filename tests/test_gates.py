"""Gates and record codecs on single cases, and on nothing."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sightline.operators import gates, records
from sightline.operators.checks import InvalidInput
from sightline.plans import gate_queries


def problems(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_order_problems(spark):
    rows = table(spark, "g string, position int, a string, b int", ("x", 0, "k", 1), ("x", 1, "k", 2), ("x", 2, "k", 2), ("y", 1, "b", 0), ("y", 0, "c", 0), ("z", 0, "a", 0))
    assert problems(gates.order_problems(rows, "g", ["a", "b"], "thing")) == [("x", "repeated_thing"), ("y", "thing_order")]
    assert problems(gates.order_problems(rows.limit(0), "g", ["a", "b"], "thing")) == []


def test_passed_raises_with_the_first_problem(spark):
    gates.passed(table(spark, "a string, problem string"), "no")
    with pytest.raises(InvalidInput, match="stale"):
        gates.passed(table(spark, "a string, problem string", ("x", "stale")), "no")


def test_membership(spark):
    want, have = table(spark, "k int", (1,), (2,), (2,)), table(spark, "k int", (2,), (3,), (3,))
    assert problems(gates.membership_problems(want, have, ["k"])) == [(1, "missing"), (3, "repeated"), (3, "unexpected")]


@pytest.mark.parametrize(("edges", "found"), [
    ([("a", "b"), ("b", "c")], []), ([("a", "b"), ("b", "a")], ["cycle"]), ([("a", "a")], ["cycle"]), ([("a", "x")], ["unknown_end"]), ([("b", "c"), ("a", "b")], ["edge_order"]), ([("a", "b"), ("a", "b")], ["repeated_edge"]), ([], []),
])
def test_route_graphs(spark, edges, found):
    nodes = table(spark, "graph_id int, position int, node string", *((1, i, x) for i, x in enumerate("abc")), (2, 0, "a"))
    rows = table(spark, "graph_id int, position int, source string, target string", *((1, i, *e) for i, e in enumerate(edges)))
    assert problems(gates.route_graph_problems(table(spark, "graph_id int", (1,), (2,), (3,)), nodes, rows)) == [*((1, p) for p in found), (3, "no_node")]


def test_router_inputs(spark):
    inputs = table(spark, "input_id int, gpu_count int, vram_bytes bigint", (1, 0, 0), (2, 0, 5), (3, 1, 5))
    profiles = table(spark, "input_id int, position int, observation_id string", (1, 0, "a"), (2, 0, "a"), (2, 1, "a"))
    artifacts = table(spark, "input_id int, position int, artifact_id string, kind string", (1, 0, "a", "k"), (1, 1, "a", "l"))
    failures = table(spark, "input_id int, position int, failure string", (1, 0, "b"), (1, 1, "a"))
    assert problems(gates.router_input_problems(inputs, profiles, artifacts, failures)) == [(1, "failure_order"), (1, "two_kinds"), (2, "budget"), (2, "repeated_profile"), (3, "no_profile")]


def test_source_pins(spark):
    pins = table(spark, "path string, byte_length bigint, blob_sha1 string", ("p/a", 1, "x"), ("p/b", 2, "y"), ("c", 3, "z"), ("d", 4, "w"))
    found = table(spark, "path string, byte_length bigint, blob_sha1 string, is_link boolean", ("p/a", 1, "x", False), ("p/b", 3, "y", False), ("c", 3, "q", False), ("p/new", 1, "x", False), ("other", 1, "x", False), ("d", 4, "w", True))
    assert problems(gates.source_pin_problems(pins, found, closed=("^p/",))) == [("c", "other_content"), ("d", "link"), ("p/b", "other_length"), ("p/new", "unlisted")]
    assert ("p/new", "unlisted") not in problems(gates.source_pin_problems(pins, found))


def test_preflight_of_a_good_set(spark):
    requested = table(spark, "position int, observation_id string", (0, "a"))
    images = table(spark, "position int, observation_id string, name string, sha256 string, byte_length bigint", (0, "a", "a.png", "s", 5))
    cameras = table(spark, "observation_id string, model string, parameters array<double>, width int, height int", ("a", "pinhole", [1.0, 1.0, 0.0, 0.0], 4, 3))
    read = table(spark, "name string, sha256 string, byte_length bigint, width int, height int", ("a.png", "s", 5, 4, 3))
    ask = lambda **k: problems(gates.preflight_problems(requested, images, cameras, read, **({"registered_images": 1, "sparse_points": 9} | k)))
    assert ask() == []
    assert ask(registered_images=2, sparse_points=0) == [(None, "no_points"), (None, "registered_images")]
    assert ask(most_bytes=4) == [("a", "too_large")]
    assert problems(gates.preflight_problems(requested, images, cameras.unionAll(cameras), read, registered_images=2, sparse_points=1)) == [("a", "two_cameras")]


OBSERVATION = {
    "observation_id": "o1", "asset": {"byte_length": 3, "mime_type": None, "sha256": "ab", "uri": "u ü"}, "captured_at": None, "kind": "image",
    "received_at": datetime.datetime(2024, 1, 5, 8, 20, 30, 7, tzinfo=datetime.UTC), "source": {"locator": None, "source_id": "s"},
}


def observation(spark, **more):
    return spark.createDataFrame([OBSERVATION | more], "source struct<source_id:string,locator:string>, observation_id string, asset struct<uri:string,sha256:string,byte_length:bigint,mime_type:string>, captured_at timestamp, kind string, received_at timestamp, extra string")


def test_records_round_trip(spark):
    stored = records.encode_records(observation(spark), "observation")
    row = stored.first()
    assert row.payload == '{"asset":{"byte_length":3,"mime_type":null,"sha256":"ab","uri":"u ü"},"captured_at":null,"kind":"image","observation_id":"o1","received_at":"2024-01-05T08:20:30.000007+00:00","source":{"locator":null,"source_id":"s"}}'
    back = records.decode_records(stored, "observation")
    assert records.encode_records(back, "observation").first() == row and back.first().received_at.microsecond == 7
    with pytest.raises(InvalidInput):
        records.encode_records(observation(spark, kind=None), "observation")
    for wrong in (row.payload[:-1], "[]", row.payload.replace("3", '"3"'), row.payload.replace('"kind":"image",', ""), row.payload.replace("{", '{"a":1,', 1), row.payload.replace("+00:00", ""), row.payload.replace(",", ", ", 1)):
        bad = spark.createDataFrame([("observation", "o1", wrong)], stored.schema)
        with pytest.raises(InvalidInput):
            records.decode_records(bad, "observation")
    with pytest.raises(InvalidInput):
        records.decode_records(spark.createDataFrame([("observation", "o2", row.payload)], stored.schema), "observation")


@pytest.mark.parametrize("record_type", sorted(records.RECORD_TYPES))
def test_every_record_type_round_trips(spark, record_type):
    """A full row of each type, made of its fields' types."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType, TimestampType

    def value(kind):
        if isinstance(kind, StructType):
            return tuple(value(f.dataType) for f in kind.fields)
        if isinstance(kind, ArrayType):
            return [value(kind.elementType)] * 2
        if isinstance(kind, TimestampType):
            return datetime.datetime(2025, 12, 31, 23, 59, 59, 999_999)
        return 1.25 if isinstance(kind, DoubleType) else 7 if isinstance(kind, (IntegerType, LongType)) else 'te"xt\n ü'

    schema = records.record_schema(record_type)
    rows = spark.createDataFrame([value(schema)], schema)
    stored = records.encode_records(rows, record_type)
    assert records.decode_records(stored, record_type).collect() == rows.collect()
    assert records.get_typed(stored, record_type, stored.select("record_id")).count() == 1
    twice = records.put_typed(stored, rows, record_type)
    assert twice.count() == 1
    assert records.decode_records(stored.limit(0), record_type).collect() == []


def test_json_objects(spark):
    rows = table(spark, "t string", ('{"a":1,"b":"x"}',), ("[1]",), ("nonsense",), (None,), ('{"a":',))
    assert [r.o and dict(r.o) for r in rows.select(records.json_object(F.col("t")).alias("o")).collect()] == [{"a": "1", "b": "x"}, None, None, None, None]


def test_images_of_one_name_are_not_the_same_bytes(spark, tmp_path):
    # part 930 assesses the image of 931, which has the same name; part 931 assesses another
    spark.createDataFrame([(930, "alike"), (931, "alike")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.observation_id: r.problem for r in gate_queries.d14_source_photometry(spark, str(tmp_path)).collect()}
    assert found == {"i930": "no_assessment", "i931": "other_source", "i-931": "no_image"}
