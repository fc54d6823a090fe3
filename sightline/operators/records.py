"""Stored records by type: canonical JSON out, strictly typed columns back, puts and gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType, TimestampType

from .checks import InvalidInput, assert_empty
from .identity import put_records

#: The record types, their fields and which of these must be there. The first field, or its part id, names a record.
_ASSET = "struct<byte_length: bigint not null, mime_type: string, sha256: string not null, uri: string not null>"
_REF = "struct<artifact_id: string not null, artifact_kind: string not null>"
_PRODUCER = "struct<implementation: string not null, revision: string, version: string not null>"
_OBSERVATION = f"observation_id string not null, asset {_ASSET} not null, captured_at timestamp, kind string not null, received_at timestamp not null, source struct<locator: string, source_id: string not null> not null"
RECORD_TYPES = {
    "observation": _OBSERVATION,
    "video_frame": f"{_OBSERVATION}, frame_index bigint not null, frame_time_us bigint not null, video_asset {_ASSET} not null",
    "camera": "camera_id string not null, manufacturer string, model string, serial_number string",
    "observation_metadata": "observation_id string not null, camera_id string, dimensions struct<height_px: int not null, width_px: int not null>, raw_entries array<struct<key: string not null, namespace: string not null, value: string not null>> not null",
    "metadata_interpretation": "observation_id string not null, capture_time struct<evidence_keys: array<string> not null, instant: timestamp, issue: string, raw_datetime: string, raw_offset: string, status: string not null> not null, gps struct<evidence_keys: array<string> not null, issue: string, latitude_deg: double, longitude_deg: double, map_datum: string, status: string not null> not null",
    "spatial_fragment": "fragment_id string not null, local_frame_id string not null, observation_ids array<string> not null",
    "reconstruction_run": f"run_id string not null, completed_at timestamp, configuration_sha256 string, input_observation_ids array<string> not null, producer {_PRODUCER} not null, started_at timestamp not null",
    "derived_artifact_provenance": "producing_run_id string not null, source_observation_ids array<string> not null",
    "scene_project": "project_id string not null",
    "artifact_metadata": f"artifact_ref {_REF} not null, artifact_key_sha256 string not null, producer struct<checkpoint: struct<identifier: string not null, sha256: string not null>, configuration_sha256: string not null, model: struct<name: string not null, revision: string, version: string>, producer: {_PRODUCER} not null> not null, project_id string not null, provenance_class string not null",
    "artifact_dependencies": f"artifact_ref {_REF} not null, dependencies array<{_REF}> not null",
    "artifact_materialization": f"artifact_ref {_REF} not null, entries array<struct<byte_length: bigint not null, relative_path: string not null, sha256: string not null>> not null",
}
#: How an instant is written, always in UTC.
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def record_schema(record_type: str) -> StructType:
    if record_type not in RECORD_TYPES:
        raise InvalidInput(f"unknown record type: {record_type}")
    return StructType.fromDDL(RECORD_TYPES[record_type])


def _stored(kind: DataType) -> DataType:
    """The type that JSON holds for a type: fields in order of their names, instants as texts."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _stored(f.dataType), True) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, ArrayType):
        return ArrayType(_stored(kind.elementType))
    return StringType() if isinstance(kind, TimestampType) else kind


def _out(value: Column, kind: DataType) -> Column:
    """A value as JSON holds it."""
    if isinstance(kind, StructType):
        fields = [_out(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _out(x, kind.elementType))
    if isinstance(kind, TimestampType):
        return F.concat(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), INSTANT), F.lit("+00:00"))
    return value.cast(kind)


def _back(value: Column, kind: DataType) -> Column:
    """A value as columns hold it."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_back(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _back(x, kind.elementType))
    return F.try_to_timestamp(value) if isinstance(kind, TimestampType) else value


def _lacks(value: Column, kind: DataType) -> Column:
    """Whether something is null in a value that must not be."""
    if isinstance(kind, StructType):
        found = F.lit(False)
        for f in kind.fields:
            inner = _lacks(value[f.name], f.dataType)
            found = found | (value[f.name].isNull() | inner if not f.nullable else value[f.name].isNotNull() & inner)
        return found
    if isinstance(kind, ArrayType):
        return F.exists(value, lambda x: x.isNull() | _lacks(x, kind.elementType))
    return F.lit(False)


def record_json(record: Column, record_type: str) -> Column:
    """Canonical JSON of a record (a struct): names in order, no spaces, null kept, what is not ASCII kept."""
    return F.to_json(_out(record, record_schema(record_type)), {"ignoreNullFields": "false"})


def encode_records(rows: DataFrame, record_type: str) -> DataFrame:
    """record_type, record_id, payload of rows with the type's columns and their parts, found by name; others are left out.

    A row that lacks what its type must have is an error.
    """
    schema = record_schema(record_type)
    whole = rows.select(F.struct(*(F.col(f.name) for f in schema.fields)).alias("r"))
    assert_empty(whole.where(_lacks(F.col("r"), schema)).select("r"), f"a record of type {record_type} lacks a field")
    return whole.select(F.lit(record_type).alias("record_type"), _named(F.col("r"), schema).alias("record_id"), record_json(F.col("r"), record_type).alias("payload"))


def _named(record: Column, schema: StructType) -> Column:
    first = schema.fields[0]
    return record[first.name]["artifact_id"] if isinstance(first.dataType, StructType) else record[first.name]


def decode_records(records: DataFrame, record_type: str) -> DataFrame:
    """The type's columns of its records (record_type, record_id, payload).

    A payload must be the canonical JSON of what is read from it: unknown and
    missing fields, other types, other order and text that is no JSON object
    are errors.
    """
    schema = record_schema(record_type)
    own = records.where(F.col("record_type") == record_type)
    read = own.select("record_id", "payload", _back(F.from_json("payload", _stored(schema)), schema).alias("r"))
    same = F.coalesce(record_json(F.col("r"), record_type).eqNullSafe(F.col("payload")), F.lit(False)) & F.col("r").isNotNull()
    bad = ~same | F.coalesce(_lacks(F.col("r"), schema), F.lit(True)) | ~F.coalesce(_named(F.col("r"), schema) == F.col("record_id"), F.lit(False))
    assert_empty(read.where(bad).select("record_id"), f"a record is not one of type {record_type}")
    return read.select("r.*")


def put_typed(stored: DataFrame, rows: DataFrame, record_type: str) -> DataFrame:
    """stored with rows of a type; equal records change nothing, conflicting ones are errors."""
    return put_records(stored, encode_records(rows, record_type))


def get_typed(stored: DataFrame, record_type: str, ids: DataFrame | None = None) -> DataFrame:
    """The stored records of a type, or those of ids (record_id), as columns."""
    own = stored.where(F.col("record_type") == record_type)
    return decode_records(own if ids is None else own.join(ids.select("record_id").distinct(), "record_id", "left_semi"), record_type)


def json_object(text: Column) -> Column:
    """Names and values (as JSON) of an object, as a map; null for whatever is no object."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
