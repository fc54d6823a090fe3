"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, scratch, text_of

#: Expected copies are held as whole numbers of 2**-24, so sums are exact.
UNIT_BITS = 24


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share_percent: int = 150,
    cap: int = 2,
    seed: int = 0,
    slice_rows: int = 1_000_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each row: id, the columns of keep, source, size, source_size, target, copies, taken.

    Sources, by code point with null last, weigh weights in turn and share
    share_percent of all words. A target stops at cap times its source's size
    and the excess is shared again by weight. Every row of a source is expected
    target / source_size times; these expectations are summed up in the order
    of (size, id), one offset of the source (from the seed) is added, and a row
    is taken once per whole number that its part of the sum crosses. Sorting by
    size keeps the words taken within about the longest text of the target.

    Texts are read once, for their sizes. The sum runs over slices of about
    slice_rows rows that range partitioning makes, so no source is ever in one
    task. Null text and text without words have size
    0; null sources are one source; null ids come first in the order; rows that
    repeat an id are ordered arbitrarily but have equal sizes or differ in it.
    No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(text_of(text_col)).alias("_size"))
    rows = rows.withColumn("_key", F.when(F.col("_source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("_source").cast("string"))))
    rows = scratch(rows, "mix-sizes")
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slice_rows))
    rows = scratch(rows.repartitionByRange(slices, "_key", "_size", "_id").withColumn("_slice", F.spark_partition_id()), "mix-rows")

    parts = rows.groupBy("_key", "_slice").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"), F.first("_source").alias("_source"))
    parts = scratch(parts, "mix-parts")

    # one row per source from here on; all sums are whole numbers, so order does not matter
    sources = parts.groupBy("_key").agg(F.sum("_words").alias("source_size"), F.first("_source").alias("_source"))
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    sources = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    # sources that reach their cap are those with the least size per weight
    order = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").isNull(), "_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = sources.withColumn("_total", F.sum("source_size").over(everything) * share_percent / F.lit(100.0))
    sources = sources.withColumn("_level", (F.col("_total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(onward))
    sources = sources.withColumn("_open", F.col("_level") * F.col("_weight") <= cap * F.col("source_size"))
    sources = sources.withColumn("_final", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("_final") * F.col("_weight"), (cap * F.col("source_size")).cast("double")))
    sources = sources.withColumn("target", target)
    one = 1 << UNIT_BITS
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * one)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_key")), 1, 6), 16, 10).cast("long")
    sources = scratch(sources.select("_key", "source_size", "target", rate.alias("_rate"), offset.alias("_offset")), "mix-sources")

    ahead = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(sources, "_key").withColumn("_start", F.col("_offset") + F.col("_rate") * F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    starts = scratch(starts.select("_key", "_slice", "source_size", "target", "_rate", "_start"), "mix-starts")

    within = Window.partitionBy("_key", "_slice").orderBy("_size", "_id")
    placed = rows.join(starts, ["_key", "_slice"])
    upto = F.col("_start") + F.sum("_rate").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_upto", upto)
    copies = F.shiftright("_upto", UNIT_BITS) - F.shiftright(F.col("_upto") - F.col("_rate"), UNIT_BITS)
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select(
        F.col("_id").alias(id_col),
        *keep,
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )
