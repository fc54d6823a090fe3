"""Artifact keys, canonical JSON, case folding and datum names of any characters, against Python's own."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import identity, metadata, pairs

TEXTS = ["", "plain", 'quo"te\\back', "é", "\U0001f600 x", "\n\r\t\b\f\x00\x1f\x7f", "  ", "a\x80b", "[]^~!#", "퟿￿"]


def test_json_text_is_that_of_the_library(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    for r in rows.select("t", identity.json_text(F.col("t")).alias("j")).collect():
        assert r.j == (None if r.t is None else json.dumps(r.t))


def test_canonical_json_of_nested_columns(spark):
    kind = "b string, a struct<z:int,y:array<string>>, c boolean, d double, e array<struct<k:string>>, f bigint"
    values = [("é", (1, ["x", None, "ü"]), True, 0.5, [("q",)], 1 << 40), (None, None, None, None, None, None), ("", (None, []), False, -1234.25, [], -1)]
    rows = spark.createDataFrame(values, kind)
    got = sorted(r.j for r in rows.select(identity.canonical_key_json(rows, ["a", "b", "c", "d", "e", "f"]).alias("j")).collect())

    def plain(v):
        a = None if v[1] is None else {"z": v[1][0], "y": v[1][1]}
        e = None if v[4] is None else [{"k": x[0]} for x in v[4]]
        return identity.canonical_json({"b": v[0], "a": a, "c": v[2], "d": v[3], "e": e, "f": v[5]}, ascii_only=True)

    # array_join leaves nulls of strings out unless they are written: elements are JSON texts, so none is null
    assert got == sorted(map(plain, values))
    with pytest.raises(Exception, match="several ways"):
        spark.createDataFrame([(1e20,)], "d double").select(identity.json_value(F.col("d"), rows.schema["d"].dataType)).collect()
    with pytest.raises(TypeError):
        identity.json_value(F.lit(1), spark.createDataFrame([], "d date").schema["d"].dataType)


MATERIAL = "output_kind string, inputs array<struct<artifact_kind:string,sha256:string>>, producer struct<implementation:string,version:string,revision:string>, configuration_sha256 string, model struct<name:string,version:string,revision:string>, checkpoint struct<identifier:string,sha256:string>, hardware_runtime_sha256 string"


def plain_key(m):
    payload = {
        "domain": "d.é", "schema_version": 1, "output_kind": m[0], "inputs": [{"artifact_kind": k, "sha256": s} for k, s in m[1]],
        "producer": dict(zip(("implementation", "version", "revision"), m[2], strict=True)), "configuration_sha256": m[3],
        "model": None if m[4] is None else dict(zip(("name", "version", "revision"), m[4], strict=True)), "checkpoint": None if m[5] is None else {"identifier": m[5][0], "sha256": m[5][1]},
    }
    if m[6] is not None:
        payload["hardware_runtime_sha256"] = m[6]
    return "artifact-key:v1:" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_artifact_keys(spark):
    d = ["%x" % k * 64 for k in range(16)]
    good = [
        ("geometry.solution", [("media.image", d[1]), ("feature.matches", d[2])], ("p.q", "1.2", "c:abc"), d[3], ("m", "4.5", "r"), ("w:q", d[4]), None),
        ("geometry.solution", [("feature.matches", d[2]), ("media.image", d[1])], ("p.q", "1.2", "c:abc"), d[3], ("m", "4.5", "r"), ("w:q", d[4]), None),  # the order of inputs counts
        ("k", [], ("\U0001f600\"\n", "ü", None), d[5], None, None, d[6]),
        ("k", [("é", d[1])] * 3, ("p", "1", None), d[5], ("m", None, None), None, None),
    ]
    found = [r[0] for r in spark.createDataFrame(good, MATERIAL).coalesce(1).select(identity.artifact_key("d.é")).collect()]
    assert found == [plain_key(m) for m in good] and len(set(found)) == 4
    bad = [("k", [], ("p", "1", None), d[5][:-1], None, None, None), ("k", [], (None, "1", None), d[5], None, None, None), ("k", [("a", None)], ("p", "1", None), d[5], None, None, None), ("k", None, ("p", "1", None), d[5], None, None, None), (None, [], ("p", "1", None), d[5], None, None, None), ("k", [], ("p", "1", None), d[5], None, ("w", d[4].replace("4", "G")), None)]
    for m in bad:
        with pytest.raises(Exception, match="missing|malformed"):
            spark.createDataFrame([m], MATERIAL).select(identity.artifact_key("d.é")).collect()


def test_case_folding_of_every_character(spark):
    letters = [chr(n) for n in range(0x20000) if not 0xD800 <= n < 0xE000 and n]
    texts = ["".join(letters[k : k + 97]) for k in range(0, len(letters), 97)] + ["Straße", "ΟΔΟΣ", "ſhutter", "İı", "", "ABC xyz"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in rows.select("t", metadata.casefold(F.col("t")).alias("f")).collect():
        assert r.f == (None if r.t is None else r.t.casefold())


def test_normalised_text_and_phrases(spark):
    texts = ["Straße Fish Eye", "ſhutter", "  A-b__C\t\n ", "x　 y\x1cz", "Rolling—Shutter", "ROLLING SHUTTER", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", metadata.normalized_text(F.col("t")).alias("n")).collect():
        assert r.n == " ".join(r.t.casefold().replace("-", " ").replace("_", " ").split())
    entries = [[("EXIF", "Image Model", "xmavic pro")], [("exıf", "Image Model", "Mavic")], [("EXIF", "IMAGE MODEL", "DJI MAVIC é")], [("EXIF", "Image Model", "émavic")], [("X", "k", "fish-eye FISHEYE")], [("X", "Rolling ſhutter", "1")]]
    observed = spark.createDataFrame([(str(i), "image", 10, 10, e) for i, e in enumerate(entries)], "observation_id string, kind string, width int, height int, entries array<struct<namespace:string,key:string,value:string>>")
    found = {(r.observation_id, r.input_class) for r in metadata.input_classes(observed).collect() if r.evidence_kind == "candidate"}
    assert found == {("2", "drone_aerial"), ("4", "fisheye"), ("5", "rolling_shutter")}


def test_datum_names(spark):
    names = ["WGS84", "wgs-84", " W G S _ 8 4 ", "WGS84é", "WGS８４", "ＷＧＳ84", "wgs84²", "NAD27", ""]
    rows = spark.createDataFrame([("resolved", n) for n in names], "status string, datum string")
    for r in rows.select("datum", pairs.gps_eligibility(F.col("status"), F.col("datum")).alias("e")).collect():
        assert r.e == ("eligible" if "".join(c for c in r.datum.upper() if c.isalnum()) == "WGS84" else "datum_unsupported")


def test_offsets_of_a_video(spark):
    frames = spark.createDataFrame([("v", i, t) for i, t in enumerate([5, 5, 9, 14])] + [("w", 0, 7)], "video_id string, frame_index bigint, frame_time_us bigint")
    assert sorted((r.video_id, r.frame_index, r.offset_us) for r in metadata.video_offsets(frames).collect()) == [("v", 0, 0), ("v", 1, 0), ("v", 2, 4), ("v", 3, 9), ("w", 0, 0)]
    asked = spark.createDataFrame([("v", 0, 3), ("v", 3, 0), ("v", 1, 9), ("w", 0, 0), ("v", 1, 2)], "video_id string, index1 bigint, index2 bigint")
    assert sorted(map(tuple, metadata.same_video_sync(frames, asked).collect())) == [("v", 0, 3, 9, "SUPPORTED"), ("v", 1, 2, 4, "SUPPORTED")]
