"""From requests to stored observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import assert_empty, assert_unique
from .identity import with_duplicates

#: What ids and digests look like.
OPAQUE_ID = "^[A-Za-z0-9._:-]{1,128}$"
SHA256 = "^[0-9a-fA-F]{64}$"


def observations(requests: DataFrame, kind: str) -> DataFrame:
    """Requests (observation_id, source_id, uri, sha256, byte_length, mime_type, received_us) as observations of a kind."""
    assert_empty(requests.where(~F.col("observation_id").rlike(OPAQUE_ID) | ~F.col("source_id").rlike(OPAQUE_ID) | ~F.col("sha256").rlike(SHA256) | (F.col("byte_length") < 0) | F.col("received_us").isNull()), "a request is malformed")
    assert_unique(requests, ["observation_id"], "an id comes twice")
    asset = F.struct("uri", F.lower("sha256").alias("sha256"), "byte_length", "mime_type")
    return requests.select("observation_id", F.lit(kind).alias("kind"), "source_id", asset.alias("asset"), "received_us")


def ingest(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is stored afterwards, and for each new observation the ids of equal content stored before.

    Duplicates are reported, never dropped; the lookup sees what was stored before the batch.
    """
    flat = lambda df: df.select("observation_id", F.col("asset.sha256").alias("sha256"), F.col("asset.byte_length").alias("byte_length"))
    report = with_duplicates(flat(batch), flat(stored)).select("observation_id", "duplicates")
    return stored.unionByName(batch.join(stored.select("observation_id"), "observation_id", "left_anti")), report
