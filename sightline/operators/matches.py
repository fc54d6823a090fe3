"""Mutual nearest matches of feature descriptors for candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch
from ..shipping import ship_package
from .checks import assert_empty

#: Descriptor bytes of a block of observations, and features compared at a time.
BLOCK_BYTES, STEP = 32 << 20, 1024


def _two_nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: its nearest row of y (ties: the first), the squared distance, and that of the second (infinite without one)."""
    near, first, second = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), np.inf)
    own = (y * y).sum(axis=1)
    for k in range(0, len(x), STEP):
        some = x[k : k + STEP]
        far = (some * some).sum(axis=1)[:, None] - 2 * some @ y.T + own  # whole numbers below 2**53
        at = np.arange(len(some))
        near[k : k + STEP] = far.argmin(axis=1)
        first[k : k + STEP] = far[at, near[k : k + STEP]]
        if len(y) > 1:
            far[at, near[k : k + STEP]] = np.inf
            second[k : k + STEP] = far.min(axis=1)
    return near, first, second


def mutual_nearest(x: np.ndarray, y: np.ndarray, ratio_percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y that are each other's nearest and pass the ratio test from both sides, and their squared distance."""
    if not len(x) or not len(y):
        return (np.zeros(0, np.int64),) * 3
    to, first, second = _two_nearest(x, y)
    back, first_back, second_back = _two_nearest(y, x)

    def passes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one * 10_000 < two * ratio_percent**2

    mutual = back[to] == np.arange(len(x))
    good = np.flatnonzero(mutual & passes(first, second) & passes(first_back, second_back)[to])
    return good, to[good], first[good].astype(np.int64)


def mutual_matches(candidates: DataFrame, features: DataFrame, *, ratio_percent: int = 80) -> DataFrame:
    """id1, id2, feature1, feature2, distance of the raw matches of candidate pairs.

    features is whole_features (see vocabulary); candidates id1 < id2, each
    once, with known observations. A match joins two features that are each
    other's nearest by squared distance (ties: the smaller index), each nearer than
    ratio_percent of the distance to its second nearest; a lone feature of the
    other side has no second. Observations are dealt out to blocks of about
    BLOCK_BYTES of descriptors; the candidates of a pair of blocks are one
    group, and an observation's descriptors are sent to it once, however many
    of its pairs are there. An observation without features matches nothing.
    """
    spark = features.sparkSession
    ship_package(spark)
    candidates = scratch(candidates.select("id1", "id2"), "match-candidates")
    assert_empty(candidates.where("id1 is null or id2 is null or id1 >= id2"), "a pair is not in order")
    assert_empty(candidates.groupBy("id1", "id2").count().where("count > 1"), "a pair occurs twice")
    n, width = features.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pairs = candidates.withColumn("p", F.least(block("id1"), block("id2"))).withColumn("q", F.greatest(block("id1"), block("id2")))
    needed = pairs.select("p", "q", F.col("id1").alias("observation_id")).union(pairs.select("p", "q", "id2")).distinct()
    held = scratch(features.select("observation_id", "feature_index", "v"), "match-features")
    sent = held.join(needed, "observation_id").select("p", "q", "observation_id", "feature_index", "v")
    schema = "id1 string, id2 string, feature1 long, feature2 long, distance long"

    def match(key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by([("observation_id", "ascending"), ("feature_index", "ascending")])
        ids = given.column("observation_id").to_pylist()
        starts = {i: k for k, i in reversed(list(enumerate(ids)))}
        ends = {i: k + 1 for k, i in enumerate(ids)}
        index = given.column("feature_index").to_numpy()
        x = given.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), width or 1)
        out: tuple[list, ...] = ([], [], [], [], [])
        for a, b in zip(asked.column("id1").to_pylist(), asked.column("id2").to_pylist(), strict=True):
            if a in starts and b in starts:
                one, two = slice(starts[a], ends[a]), slice(starts[b], ends[b])
                i, j, d = mutual_nearest(x[one], x[two], ratio_percent)
                for column, values in zip(out, ([a] * len(i), [b] * len(i), index[one][i].tolist(), index[two][j].tolist(), d.tolist()), strict=True):
                    column.extend(values)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("id1", "id2", "feature1", "feature2", "distance"), out, (pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)})

    asked = pairs.select("id1", "id2", F.col("p").alias("p"), F.col("q").alias("q"))  # columns of its own, as it meets what it asked for
    return asked.groupBy("p", "q").cogroup(sent.groupBy("p", "q")).applyInArrow(match, schema)


def match_counts(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """id1, id2, raw_matches of every candidate pair, 0 included."""
    counts = matches.groupBy("id1", "id2").agg(F.count("*").alias("n"))
    return candidates.select("id1", "id2").join(counts, ["id1", "id2"], "left").select("id1", "id2", F.coalesce("n", F.lit(0)).alias("raw_matches"))
