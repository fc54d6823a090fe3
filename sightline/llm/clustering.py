"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import lookup, prepare, scratch
from .topk import quantised

#: Distances of so many vectors are computed at a time.
BLOCK = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(rows: np.ndarray, centroids: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and the squared distance to it, both exact.

    spread: no two components of a row and a centroid differ by more.
    Distances beyond 64 bits raise OverflowError.
    """
    exact = rows.shape[1] * spread * spread
    if exact < 1 << 53:
        far = ((rows.astype(float)[:, None, :] - centroids.astype(float)) ** 2).sum(axis=2)
    else:
        far = ((rows.astype(object)[:, None, :] - centroids.astype(object)) ** 2).sum(axis=2)
    near = far.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
    return near, far[np.arange(len(rows)), near].astype(np.int64)


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    width: int = 64,
    seed: int = 3,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of each vector that takes part.

    Components become floor(scale * x), x as double. Equal quantised vectors
    are counted once (partial counts first, so a vector that a third of the
    rows share is no load) and all rounds run over distinct vectors, each
    weighing its count. The first centroids are the k vectors whose ids have
    the least SHA-256 of "seed:id", in that order. A round assigns every
    distinct vector to its nearest centroid (squared Euclidean distance, ties to
    the smaller number) and makes each centroid the exact floor of the weighted
    mean; one without vectors stays. After the last round vectors are assigned
    once more, and the assignments are joined back to the ids on the vector.

    A round is one job: a task adds up its vectors by centroid, k * width whole
    numbers, and Spark adds these up, so neither driver nor task holds more than
    k centroids, whatever the number of vectors. The sums are exact at any size.

    Vectors that are null, of another width, or hold null or non-finite
    components are left out. Fewer vectors than k give as many centroids. Rows
    with a null id are clustered but chosen last as centroids; rows that repeat
    an id are rows of their own, chosen in the order of their vectors. A
    component beyond 2**62 after scaling, or a distance or inertia beyond 64
    bits, is an error. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark, BLOCK)
    whole = F.when(F.size(vector_col) == width, quantised(vector_col, scale))
    rows = scratch(vectors.select(F.col(id_col).alias("_id"), whole.alias("v")).where("v is not null"), "cluster-rows")
    schema = StructType([vectors.schema[id_col], *StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>").fields])
    high, low = rows.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if high is None:
        return spark.createDataFrame([], schema)
    spread, most = high - low, max(high, -low)
    kind = "array<int>" if most < 1 << 31 else "array<bigint>"
    rows = rows.select("_id", F.col("v").cast(kind).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64)
    distinct = scratch(rows.groupBy("v").agg(F.count("*").alias("n")), "cluster-distinct")

    def sums_of(held: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(held), np.int64), np.zeros((len(held), width), object)
            for batch in batches:
                x, n = _matrix(batch.column(0), width), batch.column(1).to_numpy()
                for at in range(0, len(x), BLOCK):
                    some, weight = x[at : at + BLOCK], n[at : at + BLOCK]
                    fits = most * int(weight.sum()) < 1 << 62
                    near, _ = nearest(some, held, spread)
                    for c in np.unique(near):
                        mine = near == c
                        count[c] += weight[mine].sum()
                        total[c] += (weight[mine] @ some[mine] if fits else weight[mine].astype(object) @ some[mine].astype(object)).astype(object)
            for c in np.flatnonzero(count):
                sums = [format(s, "d") for s in total[c]]  # as text: they may take more than 64 bits
                yield pa.RecordBatch.from_arrays([pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([count[c]] * width, pa.int64()), pa.array(sums, pa.string())], names=["cluster", "dim", "n", "s"])

        return run

    for _ in range(rounds):
        parts = distinct.mapInArrow(sums_of(centroids), "cluster int, dim int, n long, s string")
        sums = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for r in sums.collect():  # k * width rows
            centroids[r.cluster, r.dim] = int(r.s) // r.n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            found = [nearest(x[at : at + BLOCK], centroids, spread) for at in range(0, len(x), BLOCK)]
            cluster, distance = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["v", "n", "cluster", "distance"])

    given = StructType([*distinct.schema.fields, StructField("cluster", IntegerType()), StructField("distance", LongType())])
    assigned = scratch(distinct.mapInArrow(assign, given), "cluster-assigned")
    within = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))).collect())
    about = [(c, int(s), int(sum(within.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, s in within.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>")
    found = rows.join(lookup(assigned.select("v", "cluster", "distance")), "v").join(F.broadcast(about), "cluster")
    return found.select(F.col("_id").alias(id_col), *schema.names[1:])
