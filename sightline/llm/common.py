"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, discard_scratch, lookup, scratch, shared_path, shared_root, stored_bytes
from ..shipping import ship_package
from ..storage import filesystem_of

#: The white space of all text contracts: space and TAB to CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
T = TypeVar("T")

__all__ = ["BROADCAST_ROWS", "discard_scratch", "filesystem_of", "lookup", "mark_members", "maybe_member", "member_bits", "n_words", "prepare", "scratch", "shared_path", "shared_root", "stored_bytes", "text_of", "without_space", "worker_state"]


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: send them the package, and hold the
    session's Arrow batches to so many rows, as whole texts are large."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


_STATE: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], T]) -> T:
    """What make returns, kept in the Python worker from task to task.

    A worker serves one operator after another; what another operator left
    there is dropped first and given back to the system, so the memory of two
    never adds up.
    """
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        _STATE[key] = make()
    return _STATE[key]


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_space(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def n_words(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def member_bits(keys: DataFrame, columns: list[str], n_bits: int) -> DataFrame:
    """A one-hash Bloom filter of the keys: rows (_word, _mask) of 64 bits each.

    It has at most n_bits / 64 rows, whatever the number of keys.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(n_bits))
    bits = keys.select(slot.alias("_s")).select(F.shiftright("_s", 6).alias("_word"), F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_bit"))
    return bits.groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))


def mark_members(df: DataFrame, bits: DataFrame, columns: list[str], n_bits: int) -> DataFrame:
    """df with _maybe: whether the row's key may be in the filter; false is certain."""
    keyed = df.withColumn("_s", F.pmod(F.xxhash64(*columns), F.lit(n_bits))).withColumn("_word", F.shiftright("_s", 6))
    hit = keyed.join(F.broadcast(bits), "_word", "left")
    return hit.withColumn("_maybe", F.expr("coalesce(shiftright(_mask, cast(_s & 63 as int)) & 1L, 0L) = 1")).drop("_s", "_word", "_mask")


def maybe_member(df: DataFrame, bits: DataFrame, columns: list[str], n_bits: int) -> DataFrame:
    """Rows of df whose key may be in the filter; no row whose key is in it is lost."""
    return mark_members(df, bits, columns, n_bits).where("_maybe").drop("_maybe")
