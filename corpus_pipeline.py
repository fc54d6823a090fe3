"""From documents to tokens: drop toxic texts, exact and near copies, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.bpe import bpe_encode
from sightline.llm.common import lookup, scratch, text_of
from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.mixing import mix_sources
from sightline.llm.near_dedup import near_duplicates
from sightline.llm.toxicity import fit_toxicity, score_toxicity


#: A row is known by its id and this hash of its text, as ids may repeat.
HASH = "_corpus_text_hash"
KEY = ["doc_id", HASH]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(HASH, F.xxhash64(text_of("text")))


def _matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join on the rows' key; null equals null. Keys that are few are sent to the rows, so texts aren't shuffled."""
    keys = lookup(scratch(keys.select(*(F.col(c).alias(f"_to{c}") for c in KEY), *(c for c in keys.columns if c not in KEY)), "pipeline-keys"))
    return rows.join(keys, [F.col(c).eqNullSafe(F.col(f"_to{c}")) for c in KEY], how)


def _one_of_twins(docs: DataFrame, twins: DataFrame) -> DataFrame:
    """docs with one row for each key of twins: keys that several rows have, usually none."""
    twins = scratch(twins.select(*KEY), "pipeline-twins")
    if not twins.limit(1).count():
        return docs
    one = _matched(docs, twins, "left_semi").groupBy(*KEY).agg(F.min(F.struct(*(F.col(c) for c in docs.columns if c not in KEY))).alias("_row"))
    return _matched(docs, twins, "left_anti").unionByName(one.select(*KEY, "_row.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5; learned from the labels of rows that are not held out."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, score_col="_score").where(F.col("_score") < 0.5).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the longest text, then the smallest id.

    Of rows that share that id too, the longest text stays, then that with the
    least hash; rows that repeat id and text are one. Null counts as empty.
    """
    found = scratch(exact_dedup(docs), "pipeline-exact").withColumnRenamed("text_hash", HASH)
    kept = found.where("kept and group_size > 1").groupBy("text_sha256", *KEY).agg(F.count("*").alias("_n"), F.first("chars").alias("_chars"))
    best = kept.groupBy("text_sha256").agg(F.min(F.struct((-F.col("_chars")).alias("c"), F.col(HASH).alias("h"))).alias("_best"))
    kept = scratch(kept.join(best, "text_sha256"), "pipeline-exact-kept")
    gone = found.where("not kept").unionByName(kept.where(F.col(HASH) != F.col("_best.h")), allowMissingColumns=True)
    rows = _matched(_hashed(docs), gone.select(*KEY).distinct(), "left_anti")
    return _one_of_twins(rows, kept.where((F.col(HASH) == F.col("_best.h")) & (F.col("_n") > 1))).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 on five-word shingles join: that with the smallest id, then the least hash of its text.

    Documents with a null id or without words are in no group and stay.
    """
    found = scratch(near_duplicates(_hashed(docs), shingle_words=5, percent=80, keep=(HASH,)), "pipeline-near")
    groups = found.where("group is not null").groupBy("group").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", HASH)).alias("_stays"))
    groups = scratch(groups.where("_n > 1").select("group", "_stays"), "pipeline-near-groups")
    gone = found.join(lookup(groups), "group").where(F.struct("doc_id", HASH) != F.col("_stays"))
    rows = _matched(_hashed(docs), gone.select(*KEY).distinct(), "left_anti")
    twins = found.join(lookup(groups), "group").where(F.struct("doc_id", HASH) == F.col("_stays")).groupBy(*KEY).count().where("count > 1")
    return _one_of_twins(rows, twins).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, up to twice. Rows that repeat id and text are taken as often as the one taken most."""
    copies = mix_sources(_hashed(docs), keep=(HASH,)).groupBy(*KEY).agg(F.max("copies").cast("int").alias("_copies"))
    joined = _matched(_hashed(docs), copies.where("_copies > 0"), "inner")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, little-endian unsigned 32-bit, and whether they decode to it."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = docs.withColumn("_digest", F.sha2(F.encode(text_of("text"), "utf-8"), 256))
    encoded = bpe_encode(kept, ranks, public_tokenizers.PATTERN, keep=("lang", "source", "_digest"), decoded_col="decoded", remember=250_000)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("byte-level BPE", tokens)]

#: Neither a learned score nor signatures nor merges can be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
