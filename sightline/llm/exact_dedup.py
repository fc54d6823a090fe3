"""Exact dedup by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, mark_members, maybe_member, member_bits, scratch, text_of, without_space


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    digest_all: bool = False,
    prefix_chars: int = 64,
    filter_bits: int = 1 << 23,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, chars, text_hash, text_sha256.

    Texts are equal when they are identical without white space (space and TAB
    to CR). Rows are grouped by the length of that text; lengths that occur
    once are settled. The rest is grouped by length and a hash of the first
    prefix_chars characters. Only texts of groups that still have two rows are
    read again and hashed in full (SHA-256). Between the steps travels a filter
    of at most filter_bits bits; its false positives cost work and change
    nothing. text_sha256 is the lowercase hex digest of the text without white
    space where it was taken, else null; with digest_all every row is hashed, on
    the first reading.

    Of equal texts the row with the most characters stays, then the smallest
    id. Null text counts as empty; empty texts are equal to one another. A null
    id stays only if all of its group are null. Rows that repeat the id that
    stays are all marked kept; chars (length of the text as it is) and
    text_hash (its xxhash64) tell them apart where their texts differ. No rows
    give no rows. Other columns are ignored.
    """
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    plain = text.select("_id", F.char_length("_text").alias("_chars"), F.xxhash64("_text").alias("_raw"), without_space(F.col("_text")).alias("_norm"))
    key = [F.char_length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix")]
    full = F.sha2(F.encode("_norm", "utf-8"), 256).alias("_sha")

    rows = scratch(plain.select("_id", "_chars", "_raw", *key, *([full] if digest_all else [])), "exact-keys")
    lengths = member_bits(rows.groupBy("_len").count().where("count > 1"), ["_len"], filter_bits)
    prefixes = maybe_member(rows.select("_len", "_prefix"), lengths, ["_len"], filter_bits).groupBy("_len", "_prefix").count().where("count > 1")
    open_keys = scratch(member_bits(prefixes, ["_len", "_prefix"], filter_bits), "exact-open")
    marked = mark_members(rows, open_keys, ["_len", "_prefix"], filter_bits)

    if digest_all:
        again, settled = marked.where("_maybe"), marked.where("not _maybe")
    else:
        wanted = scratch(member_bits(marked.where("_maybe"), ["_raw"], filter_bits), "exact-wanted")
        read = maybe_member(text.withColumn("_raw", F.xxhash64("_text")), wanted, ["_raw"], filter_bits)
        read = read.select("_id", F.char_length("_text").alias("_chars"), "_raw", without_space(F.col("_text")).alias("_norm"))
        again = scratch(read.select("_id", "_chars", "_raw", F.char_length("_norm").alias("_len"), full), "exact-hashed")
        settled = mark_members(rows, wanted, ["_raw"], filter_bits).where("not _maybe")
    groups = again.groupBy("_len", "_sha").agg(F.count("*").alias("_n"), F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("o"), F.col("_id").alias("i"))).alias("_best"))
    groups = scratch(groups.where("_n > 1").select("_sha", "_n", F.col("_best.i").alias("_keep")), "exact-groups")

    nothing = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in ("_n", "_keep")]
    sha = F.col("_sha") if digest_all else F.lit(None).cast("string").alias("_sha")
    joined = again.join(lookup(groups), "_sha", "left").select("_id", "_chars", "_raw", "_sha", "_n", "_keep")
    joined = joined.unionByName(settled.select("_id", "_chars", "_raw", sha, *nothing))
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_chars").alias("chars"),
        F.col("_raw").alias("text_hash"),
        F.col("_sha").alias("text_sha256"),
    )
