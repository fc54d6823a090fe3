"""WARC archives with an index: written by partition, read by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import filesystem_of, lookup, mark_members, member_bits, prepare, scratch, shared_path, text_of

#: Fixed by the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 1000, filter_bits: int = 1 << 23) -> DataFrame:
    """What to write for each row: id, url, payload, digest, record_type, refers_to, and whether others refer to it.

    Of rows with equal payloads of at least least_bytes bytes, that with the
    largest id is the response and the others revisit it; all others are
    responses. Null payload is empty; a null id is never referred to unless all
    of its group are null. Rows that repeat an id stay apart, and all that have
    the response's id are responses. Rows are decided on by their digests
    alone; a payload is shuffled at most if its digest occurs twice (or a
    filter of filter_bits bits takes it for one that does) and such digests are
    too many to broadcast.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.encode(text_of(payload_col), "utf-8").alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload")).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    copies = rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(F.count("*").alias("_n"), F.max("_id").alias("_to"))
    copies = scratch(copies.where("_n > 1").select("_digest", "_to"), "warc-copies")
    bits = scratch(member_bits(copies, ["_digest"], filter_bits), "warc-bits")
    marked = mark_members(rows, bits, ["_digest"], filter_bits)
    # by the digest alone: equal digests have equal lengths
    again = marked.where("_maybe").drop("_maybe").join(lookup(copies).withColumn("_several", F.lit(True)), "_digest", "left")
    alone = marked.where("not _maybe").drop("_maybe").withColumn("_to", F.lit(None).cast(copies.schema["_to"].dataType)).withColumn("_several", F.lit(None).cast("boolean"))
    revisit = F.col("_several").isNotNull() & ~F.col("_to").eqNullSafe(F.col("_id"))
    return again.unionByName(alone).select(
        "_id", "_url", F.when(~revisit, F.col("_payload")).alias("_payload"), "_bytes", "_digest", F.when(revisit, "revisit").otherwise("response").alias("_type"),
        F.when(revisit, F.col("_to")).alias("_refers"), (F.col("_several").isNotNull() & ~revisit).alias("_referred"),
    )


def _packed(head: list[str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([VERSION, *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def _record(row: dict, record_id: str, date: str) -> bytes:
    head = [
        f"WARC-Type: {row['_type']}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {row['_uri']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['_digest'])).decode()}",
        f"X-Page-ID: {'' if row['_id'] is None else row['_id']}",
        f"X-Payload-Length: {row['_bytes']}",
    ]
    if row["_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {row['_to_record']}", f"WARC-Refers-To-Target-URI: {row['_to_uri']}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {'' if row['_refers'] is None else row['_refers']}"]
    head.append("Content-Type: application/http;msgtype=response")
    return _packed(head, HTTP.format(row["_bytes"]).encode() + (row.get("_payload") or b""))


def _index_type(id_type) -> StructType:
    return StructType([StructField("file", StringType()), StructField("offset", LongType()), StructField("length", LongType()), StructField("url", StringType()), StructField("digest", StringType()), StructField("record_type", StringType()), StructField("id", id_type), StructField("record_id", StringType()), StructField("referred", BooleanType())])


def write_warc(records: DataFrame, folder: str | None = None, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the planned records, archives by partition, and return the index.

    Index rows: file, offset, length, url, digest, record_type, id, record_id.
    Responses are written first; revisits, which need no payload, then name the
    record that they refer to. An archive begins with a warcinfo record, a
    response holds an HTTP response of the payload, a revisit its head alone.
    Record ids are made of the archive's name and the offset, so rows that
    repeat everything have different ones. Each attempt of a task writes an
    archive of its own name; the index, a table, holds those of the attempts
    that Spark committed. date is when the pages were fetched. A row without
    url gets urn:page:<id>. No rows give no archive.
    """
    prepare(records.sparkSession)
    folder = folder or shared_path(records.sparkSession, "warc")
    schema = _index_type(records.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        named = lambda at: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{at}')}>"
        out, at = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = filesystem_of(file)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                about = _packed(["WARC-Type: warcinfo", f"WARC-Record-ID: {named(0)}", f"WARC-Date: {date}", f"WARC-Filename: {path.rpartition('/')[2]}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")
                out.write(about)
                at = len(about)
            held: dict[str, list] = {name: [] for name in schema.names}
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                row["_uri"] = "".join(row["_url"].split()) or f"urn:page:{row['_id']}"
                data = _record(row, named(at), date)
                out.write(data)
                for name, value in zip(schema.names, (file, at, len(data), row["_uri"], row["_digest"], row["_type"], row["_id"], named(at), row.get("_referred", False)), strict=True):
                    held[name].append(value)
                at += len(data)
            if batch.num_rows:
                kinds = {"offset": pa.int64(), "length": pa.int64(), "referred": pa.bool_(), "id": batch.schema.field("_id").type}
                yield pa.RecordBatch.from_arrays([pa.array(held[name], kinds.get(name, pa.string())) for name in schema.names], names=schema.names)
        if out is not None:
            out.close()

    responses = records.where("_type = 'response'").drop("_refers", "_type").withColumn("_type", F.lit("response"))
    responses = scratch(responses.mapInArrow(run, schema), "warc-responses")
    targets = responses.where("referred").groupBy("digest").agg(F.min(F.struct("record_id", "url")).alias("t"))
    targets = scratch(targets.select(F.col("digest").alias("_digest"), F.col("t.record_id").alias("_to_record"), F.col("t.url").alias("_to_uri")), "warc-targets")
    revisits = records.where("_type = 'revisit'").select("_id", "_url", "_bytes", "_digest", "_type", "_refers").join(lookup(targets), "_digest")
    revisits = scratch(revisits.mapInArrow(run, schema), "warc-revisits")
    return responses.unionByName(revisits).drop("referred")


def _parse(data: bytes) -> dict:
    """A record's headers and block, from its gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    return fields | {"block": block}


RECORD = StructType([StructField("page", StringType()), StructField("url", StringType()), StructField("record_type", StringType()), StructField("refers_to", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("payload", BinaryType())])


def read_warc(index: DataFrame, *, gap: int = 1 << 16, most: int = 1 << 23, stretch: int = 1 << 26) -> DataFrame:
    """The records of the index rows: page, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Rows are dealt out by archive and stretch of it and sorted by offset; ranges
    that lie within gap bytes are read in one request of up to most bytes, so a
    selection costs few requests and a whole archive is read in sequence. The
    digest of a response is taken from the payload read and must equal the one
    in the record; a revisit has the digest and length of the payload it
    stands for, and no payload.
    """
    prepare(index.sparkSession)
    parallel = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else few index rows end up in one task
    bytes_ = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    rows = index.select("file", "offset", "length").repartition(max(parallel, -(-bytes_ // stretch)), "file", F.expr(f"offset div {stretch}")).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, run_of = None, None, []

        def fetch() -> pa.RecordBatch:
            first, last = run_of[0][0], run_of[-1][0] + run_of[-1][1]
            data = source.read_at(last - first, first)
            out = []
            for at, n in run_of:
                x = _parse(data[at - first : at - first + n])
                digest, response = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), x["WARC-Type"] == "response"
                payload = x["block"].partition(b"\r\n\r\n")[2] if response else None
                if response and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{opened} at {at}: the payload has another digest")
                out.append({"page": x["X-Page-ID"] or None, "url": x["WARC-Target-URI"], "record_type": x["WARC-Type"], "refers_to": x.get("X-Refers-To-Page") or None, "payload_bytes": len(payload) if response else int(x["X-Payload-Length"]), "payload_digest": digest, "payload": payload})
            run_of.clear()
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([(f.name, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(f.name, pa.string())) for f in RECORD.fields]))

        for batch in batches:
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if run_of and (file != opened or at > run_of[-1][0] + run_of[-1][1] + gap or at + n > run_of[0][0] + most):
                    yield fetch()
                if file != opened:
                    fs, path = filesystem_of(file)
                    opened, source = file, fs.open_input_file(path)
                run_of.append((at, n))
        if run_of:
            yield fetch()

    return rows.mapInArrow(run, RECORD)
