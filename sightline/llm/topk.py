"""Exact top-k search by inner product: a Voronoi join in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import prepare, scratch

#: Rings of equal angle around a pivot for which rows are counted.
RINGS = 256
#: Numbers that a group holds of its rows, or of its queries, whatever the width of the vectors.
GROUP_NUMBERS = 1 << 21
#: How far rounding may be off in a bound, as a share of the product of the norms.
SLACK = 2e-6


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a long; null for vectors that take no part.

    A component that does not fit is an error, not another number.
    """
    kind = F.col(vector)
    usable = kind.isNotNull() & F.forall(kind, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.abs(scale * x.cast("double")) < float(1 << 62)
    whole = F.transform(kind, lambda x: F.when(fits(x), F.floor(scale * x.cast("double"))).otherwise(F.raise_error(F.lit("a vector component is beyond 2**62")).cast("long")))
    return F.when(usable, whole)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1)[:, None], norm


def _dots(a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as int64; one that does not fit raises OverflowError, unless it is to be skipped."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.where(skip, 0, a.astype(object) @ b.astype(object).T).astype(np.int64)


def _packed(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of a binary column as int64, filled up with 0 to width."""
    cells, size = column.to_pylist(), np.dtype(kind).itemsize
    if all(len(x) == size * width for x in cells):
        return np.frombuffer(b"".join(cells), kind).reshape(-1, width).astype(np.int64)
    out = np.zeros((len(cells), width), np.int64)
    for k, x in enumerate(cells):
        out[k, : len(x) // size] = np.frombuffer(x, kind)
    return out

def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row of scores: highest first, ties by id."""
    if len(scores) > 4 * k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Chunks:
    """The rows cut by cell and, within a cell, by angle to its pivot.

    A chunk is a run of rings of one cell that hold at most `most` rows together,
    or one ring of more, which is dealt out over several salts. Of a chunk are
    known its rows and the range of their angles and norms. There are at most
    as many chunks as pivots times RINGS, however many rows there are.
    """

    def __init__(self, rings: list, pivots: int, most: int):
        self.of = np.zeros((pivots, RINGS), np.int32)
        runs: list[list] = []
        for r in sorted(rings, key=lambda r: (r.cell, r.ring)):
            if runs and runs[-1][0] == r.cell and runs[-1][5] + r.n <= most:
                c = runs[-1]
                runs[-1] = [r.cell, min(c[1], r.near), max(c[2], r.far), min(c[3], r.small), max(c[4], r.large), c[5] + r.n]
            else:
                runs.append([r.cell, r.near, r.far, r.small, r.large, r.n])
            self.of[r.cell, r.ring] = len(runs) - 1
        table = np.array(runs, float).reshape(-1, 6)
        self.cell, self.rows = table[:, 0].astype(int), table[:, 5].astype(np.int64)
        self.near, self.far, self.small, self.large = table[:, 1:5].T
        self.salts = -(-self.rows // most)

    def bounds(self, angle: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The highest inner product that a row of each chunk can have with queries of these
        norms and angles to the pivots, by the triangle inequality of angles."""
        of_cell = angle[:, self.cell]
        gap = np.maximum(0, np.maximum(of_cell - self.far, self.near - of_cell))
        cosine = np.cos(np.minimum(gap, math.pi))
        best = norm[:, None] * cosine * np.where(cosine >= 0, self.large, self.small)
        return best + SLACK * norm[:, None] * self.large


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    pivots: int = 128,
    group_queries: int = 4096,
    chunk_rows: int = 16384,
    stats: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product.

    Components become floor(scale * x), x as double. Queries are the rows whose
    id is divisible by every; candidates are all rows but those with the
    query's own id. Ties go to the smaller id.

    Up to pivots rows, chosen by a hash of the id, split the space into Voronoi
    cells by angle, and rings of angle cut the cells into chunks of chunk_rows
    rows. First each query is solved in the chunk that it lies in; its k-th
    best score there is what a row must reach. The summaries of the other
    chunks (the range of angles to the pivot and of norms) bound what their
    rows can reach; a query is sent to the chunks that may hold a result and to
    no others. The queries of a chunk are dealt out in groups of group_queries,
    its rows are sent once to each group and not at all if no query needs them,
    and each group is solved alone. Rows of one vector, however many, are
    dealt out by their place in the table. The result is exact for any
    pivots; how much is compared depends on how well the rows fall into cells.
    stats, where given, gets "share": of all pairs of a query and a row, those compared.

    Vectors that are null or hold null, NaN or infinite components take no
    part, nor do null ids. Shorter vectors are filled up with 0. A component
    beyond 2**62 after scaling or a score beyond 64 bits is an error. Rows that
    repeat an id are separate candidates; as queries they are one, that of the
    least vector by its bytes. No rows give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v")).where("id is not null and v is not null")
    rows = scratch(rows, "topk-rows")
    n, width, high, low = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, kind = max(width or 0, 1), "<i4" if max(high or 0, -(low or 0)) < 1 << 31 else "<i8"
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(min(pivots, math.isqrt(n) + 1)).collect()  # bounded by the parameter
    points = np.zeros((len(chosen), width), np.int64)
    for at, row in enumerate(chosen):
        points[at, : len(row.v)] = row.v
    held = spark.sparkContext.broadcast(_unit(points.astype(np.float64))[0])

    # cell, ring and norm of each row
    schema = StructType([StructField("id", LongType()), StructField("packed", BinaryType()), StructField("cell", IntegerType()), StructField("ring", IntegerType()), StructField("angle", DoubleType()), StructField("norm", DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
            cells = pa.array([flat[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            unit, norm = _unit(_packed(cells, width, kind).astype(np.float64))
            cosine = unit @ held.value.T
            cell = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
            ring = np.minimum(angle / math.pi * RINGS, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(angle), pa.array(norm)], names=schema.names)

    placed = scratch(rows.mapInArrow(place, schema), "topk-placed")
    rings = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.min("norm").alias("small"), F.max("norm").alias("large"))
    rings = rings.collect()
    chunks = Chunks(rings, max(len(points), 1), min(chunk_rows, max(1, GROUP_NUMBERS // width)))  # at most RINGS rows for each pivot
    group_queries = min(group_queries, max(1, GROUP_NUMBERS // width))
    summary = spark.sparkContext.broadcast(chunks)
    of = spark.createDataFrame([(c, r, int(chunks.of[c, r]), int(chunks.salts[chunks.of[c, r]])) for c, r in sorted((x.cell, x.ring) for x in rings)], "cell int, ring int, chunk int, salts int")

    def in_chunks(df: DataFrame, *by: Column) -> DataFrame:
        return df.join(F.broadcast(of), ["cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64(*by), F.col("salts")).cast("int"))

    candidates = in_chunks(placed.withColumn("_row", F.col("_metadata.row_index")), F.col("id"), F.col("_row")).select("id", "packed", "chunk", "salt")
    queries = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("packed", "cell", "ring")).alias("q")).select("id", "q.*")
    asked = in_chunks(queries, F.col("id")).select(*(F.col(c).alias(c) for c in ("id", "packed", "chunk", "salt")))  # columns of its own, as it meets the candidates

    def solved(asked_part: pa.Table, sent_part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's best rows."""
        q, q_ids = _packed(asked_part.column("packed"), width, kind), asked_part.column("id").to_numpy()
        x, x_ids = _packed(sent_part.column("packed"), width, kind), sent_part.column("id").to_numpy()
        for at in range(0, len(q), 256):
            own = q_ids[at : at + 256, None] == x_ids[None, :]
            for itself, row in zip(own, _dots(q[at : at + 256], x, own), strict=True):
                others = np.flatnonzero(~itself)
                row, ids = (row, x_ids) if len(others) == len(row) else (row[others], x_ids[others])
                best = _best(row, ids, k)
                yield ids[best], row[best]

    # each query in its own chunk; what it finds there bounds what others must reach
    own = StructType([*asked.schema.fields, StructField("vec_ids", ArrayType(LongType())), StructField("scores", ArrayType(LongType()))])

    def at_home(key: tuple, asked_part: pa.Table, sent_part: pa.Table) -> pa.Table:
        found = list(solved(asked_part, sent_part))
        columns = [pa.array([f[c].tolist() for f in found], pa.list_(pa.int64())) for c in (0, 1)]
        return pa.table([*asked_part.columns, *columns], names=own.names)

    home = scratch(asked.groupBy("chunk", "salt").cogroup(candidates.groupBy("chunk", "salt")).applyInArrow(at_home, own), "topk-home")

    # the other chunks that may hold a result of a query
    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        directions, chunks = held.value, summary.value
        for batch in batches:
            step = max(1, GROUP_NUMBERS // max(1, len(chunks.rows)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit, norm = _unit(_packed(part.column("packed"), width, kind).astype(np.float64))
                least = np.array([x[-1] if len(x) >= k else -np.inf for x in part.column("scores").to_pylist()], float)
                bounds = chunks.bounds(np.arccos(np.clip(unit @ directions.T, -1, 1)), norm)
                may = bounds >= least[:, None]
                alone = np.flatnonzero(chunks.salts == 1)  # the query's own chunk is done, unless it has several salts
                mine = part.column("chunk").to_numpy()
                may[np.arange(len(mine)), mine] &= ~np.isin(mine, alone)
                yield part, *np.nonzero(may)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(summary.value.rows), np.int64)
        for _, _, chunk in needed(batches):
            total += np.bincount(chunk, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["chunk", "n"])

    wanted = home.mapInArrow(count, "chunk int, n long").groupBy("chunk").agg(F.sum("n").alias("n")).collect()  # a row for each chunk
    blocks = {r.chunk: -(-r.n // group_queries) for r in wanted}
    if stats is not None:
        n_queries = home.count()
        compared = sum(r.n * int(chunks.rows[r.chunk]) for r in wanted) + home.join(candidates.groupBy("chunk", "salt").count(), ["chunk", "salt"]).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        stats["share"] = compared / (n_queries * n) if n_queries else 0.0
    plan = spark.createDataFrame([(c, int(chunks.salts[c]), b) for c, b in blocks.items()], "chunk int, salts int, blocks int")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, chunk in needed(batches):
            took = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([took.column("id"), took.column("packed"), took.column("chunk"), took.column("salt"), pa.array(chunk.astype(np.int32))], names=["id", "packed", "home", "home_salt", "chunk"])

    sent = home.mapInArrow(send, "id long, packed binary, home int, home_salt int, chunk int").join(F.broadcast(plan), "chunk")
    sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("not (chunk = home and salt = home_salt)")
    sent = sent.select("id", "packed", "chunk", "salt", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int").alias("block"))
    rest = candidates.join(F.broadcast(plan.select("chunk", "blocks")), "chunk").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def away(key: tuple, asked_part: pa.Table, sent_part: pa.Table) -> pa.Table:
        ids = asked_part.column("id").to_numpy()
        found = list(solved(asked_part, sent_part))
        columns = (np.repeat(ids, [len(f[0]) for f in found]), *(np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in (0, 1)))
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    key = ("chunk", "salt", "block")
    others = sent.groupBy(*key).cogroup(rest.groupBy(*key)).applyInArrow(away, "query_id long, vec_id long, score long")
    near = home.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("vec_ids", "scores")).alias("r")).select("query_id", F.col("r.vec_ids").alias("vec_id"), F.col("r.scores").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.unionByName(others).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
