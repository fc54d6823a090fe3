"""Candidate pairs: sequence, distance and cosine neighbours, their merging and their recall."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import lookup, scratch, spread
from ..shipping import ship_package
from ..storage import filesystem_of
from .checks import assert_empty, assert_unique
from .neighbors import neighbours

#: Fixed values of the WGS 84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def canonical_pair(a: str, b: str) -> list[Column]:
    """id1, id2 in code point order."""
    return [F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")]


def sequential_pairs(items: DataFrame, overlap: int, *, quadratic: bool = False, by: tuple[str, ...] = ("sequence_id",)) -> DataFrame:
    """Pairs of items whose positions differ by an offset: 1 to overlap, or 2**0 to 2**(overlap - 1).

    items has the columns of by, position (0, 1, ...) and observation_id. Each
    item is sent once per offset, so the join is an equi-join on the position.
    Returns by, id1, id2, index1, index2 (which follow the ids) and distance.
    """
    if overlap < 1:
        raise ValueError("overlap must be positive")
    assert_unique(items, [*by, "observation_id"], "an id occurs twice in a sequence")
    offsets = [1 << k if quadratic else k + 1 for k in range(overlap)]
    left = items.select(*by, F.col("position").alias("i"), F.col("observation_id").alias("a"), F.explode(F.array(*map(F.lit, offsets))).alias("distance"))
    left = left.withColumn("j", F.col("i") + F.col("distance"))
    right = items.select(*by, F.col("position").alias("j"), F.col("observation_id").alias("b"))
    pairs = left.join(right, [*by, "j"])
    straight = F.col("a") < F.col("b")
    return pairs.select(*by, *canonical_pair("a", "b"), F.when(straight, F.col("i")).otherwise(F.col("j")).alias("index1"), F.when(straight, F.col("j")).otherwise(F.col("i")).alias("index2"), F.col("distance").cast("bigint").alias("distance"))


def exhaustive_pair_count(n: Column) -> Column:
    """How many unordered pairs n items have."""
    return (n * (n - 1) / 2).cast("bigint")


def gps_eligibility(status: Column, datum: Column) -> Column:
    """Whether a point may be paired: its interpretation must be resolved and its datum WGS 84."""
    plain = F.regexp_replace(F.upper(datum), r"[^\p{L}\p{N}]", "")
    return (
        F.when(status == "absent", "gps_absent")
        .when(status == "incomplete", "gps_incomplete")
        .when(status == "invalid", "gps_invalid")
        .when(datum.isNull(), "datum_missing")
        .when(plain != "WGS84", "datum_unsupported")
        .otherwise("eligible")
    )


def ecef(latitude: Column, longitude: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres of a point at height 0."""
    e2 = WGS84_F * (2 - WGS84_F)
    lat, lon = F.radians(latitude), F.radians(longitude)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)


def nearby_pairs(points: DataFrame, neighbors: int, radius_m: float) -> DataFrame:
    """Pairs within radius_m where one is among the other's nearest `neighbors`, by chord length, ties by id.

    points has observation_id, latitude_deg, longitude_deg. Dense places are
    cut finer than thin ones, see neighbours. Returns id1, id2, distance_m.
    """
    if neighbors < 1 or not radius_m > 0:
        raise ValueError("neighbors and radius_m must be positive")
    assert_empty(points.where("latitude_deg not between -90 and 90 or longitude_deg not between -180 and 180"), "a coordinate is out of range")
    x, y, z = ecef(F.col("latitude_deg"), F.col("longitude_deg"))
    found = neighbours(points.select("observation_id", x.alias("x"), y.alias("y"), z.alias("z")), "observation_id", neighbors, radius_m)
    return found.select(*canonical_pair("a", "b"), "d").groupBy("id1", "id2").agg(F.min("d").alias("distance_m"))


def cosine_neighbours(descriptors: DataFrame, neighbors: int, *, block: int = 4096) -> DataFrame:
    """a, b, s, k: the `neighbors` most similar of each a, by cosine, ties by id; k counts from 1. A stored table.

    descriptors has observation_id and descriptor (unit length within 1e-4,
    finite). Rows are written once, in order of their ids and in files of about
    block rows. A file is one task, which goes through all files in order and
    keeps the best so far of its own rows, so n rows cost n * n products, but no
    row is copied or shuffled to meet others: what is stored grows with n * neighbors,
    and a task holds two pieces of at most block rows. Products are made in
    single precision; what may be among the best by that, give or take its
    error, is made again in double precision.
    """
    spark = descriptors.sparkSession
    ship_package(spark)
    norm2 = F.aggregate("descriptor", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    assert_empty(descriptors.where(~(F.abs(F.sqrt(norm2) - 1) <= 1e-4) | F.exists("descriptor", lambda v: v.isNull() | F.isnan(v))).select("observation_id"), "a descriptor is not of unit length")
    given = scratch(descriptors.select("observation_id", "descriptor"), "cosine-given")
    rows = given.repartitionByRange(max(1, -(-given.count() // block)), "observation_id").sortWithinPartitions("observation_id")
    number = lambda uri: int(re.search(r"part-(\d+)[^/]*$", uri)[1])
    files = sorted(scratch(rows, "cosine-rows").inputFiles(), key=lambda uri: (number(uri), uri))  # in order of the ids

    def pieces(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        system, path = filesystem_of(unquote(uri))
        with system.open_input_file(path) as file:
            for part in pq.ParquetFile(file).iter_batches(block, columns=["observation_id", "descriptor"]):
                if part.num_rows:
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    yield np.array(part.column(0).to_pylist(), object), x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def solve(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """The best of these rows among all. Others come in order of their ids, so an equal score later on changes nothing."""
        best, names = np.full((len(ids), neighbors), -np.inf), np.full((len(ids), neighbors), None, object)
        narrow, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-22
        for uri in files:
            for others, y in pieces(uri):
                flat = y.astype(np.float32).T.copy()
                same: dict[str, list[int]] = {}
                if others[0] <= ids[-1] and ids[0] <= others[-1]:
                    for j, name in enumerate(others):
                        same.setdefault(name, []).append(j)
                for at in range(0, len(ids), 256):
                    rough = narrow[at : at + 256] @ flat
                    for i, name in enumerate(ids[at : at + 256] if same else ()):
                        if name in same:
                            rough[i, same[name]] = -np.inf
                    least = best[at : at + 256, -1]
                    if len(others) > neighbors:  # what is surely not among the best of this piece alone
                        if (least == -np.inf).any():
                            least = np.maximum(least, np.partition(rough, len(others) - neighbors, axis=1)[:, len(others) - neighbors] - slack)
                    row, col = np.nonzero(rough >= (least - slack).astype(np.float32)[:, None])
                    for k in range(0, len(row), 1 << 16):
                        r, c = row[k : k + (1 << 16)], col[k : k + (1 << 16)]
                        met = rough[r, c] > -np.inf
                        r, c = r[met], c[met]
                        exact = np.round(np.einsum("ij,ij->i", x[at + r], y[c]), 12)  # equal ones tie, however they were summed
                        better = exact > best[at + r, -1]
                        r, c, exact = r[better], c[better], exact[better]
                        begins = np.flatnonzero(np.diff(r, prepend=-1))
                        for first, end in zip(begins, [*begins, len(r)][1:], strict=True):
                            i = at + r[first]
                            scores = np.concatenate([best[i], exact[first:end]])
                            order = np.argsort(-scores, kind="stable")[:neighbors]
                            best[i], names[i] = scores[order], np.concatenate([names[i], others[c[first:end]]])[order]
        row, col = np.nonzero(best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.string()), pa.array(names[row, col], pa.string()), pa.array(best[row, col], pa.float64())], names=["a", "b", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for ids, x in pieces(files[k]):
                    yield solve(ids, x)

    found = spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "a string, b string, s double")  # a task for each file
    place = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")  # an id may have several rows
    return scratch(scratch(found, "cosine-found").withColumn("k", F.row_number().over(place)).where(F.col("k") <= neighbors), "cosine-ranked")


def neighbour_pairs(ranked: DataFrame) -> DataFrame:
    """id1, id2, similarity of the pairs in rows of cosine_neighbours, which are stored."""
    return spread(ranked.select(*canonical_pair("a", "b"), "s"), ranked.count(), "id1", "id2").groupBy("id1", "id2").agg(F.max("s").alias("similarity"))


def cosine_pairs(descriptors: DataFrame, neighbors: int, *, block: int = 4096) -> DataFrame:
    """Pairs where one is among the other's `neighbors` most similar, see cosine_neighbours. Returns id1, id2 and the similarity."""
    return neighbour_pairs(cosine_neighbours(descriptors, neighbors, block=block))


def as_candidates(pairs: DataFrame, source_id: str, kind: str, artifact_id: str) -> DataFrame:
    """Adapter of any pairing result: id1, id2, source_id and evidence; scores are dropped, self-pairs and repeats too."""
    ref = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(artifact_id).alias("id")))
    return pairs.where("id1 <> id2").select(*canonical_pair("id1", "id2")).distinct().withColumn("source_id", F.lit(source_id)).withColumn("evidence", ref)


def merge_candidates(*sets: DataFrame) -> DataFrame:
    """One row per pair: id1, id2 and sources, an array of (source_id, evidence).

    Evidence of one source is united; sources are in order of their id,
    evidence in order of (kind, id).
    """
    rows = sets[0]
    for more in sets[1:]:
        rows = rows.unionByName(more)
    flat = rows.select("id1", "id2", "source_id", F.explode("evidence").alias("e"))
    by_source = flat.groupBy("id1", "id2", "source_id").agg(F.array_sort(F.collect_set("e")).alias("evidence"))
    return by_source.groupBy("id1", "id2").agg(F.array_sort(F.collect_list(F.struct("source_id", "evidence"))).alias("sources"))


def union_sets(named: dict[str, DataFrame]) -> DataFrame:
    """merge_candidates of retrieval sets by distinct source ids."""
    for name, rows in named.items():
        assert_empty(rows.where(F.col("source_id") != name), f"{name} holds pairs of another source")
    return merge_candidates(*named.values())


def recall(relevant: DataFrame, candidates: DataFrame, baseline: str | None = None) -> DataFrame:
    """Per source, and for their union: source_id, metric, value.

    relevant has id1, id2; candidates id1, id2, source_id. Metrics are
    candidate_count, hit_count, relevant_count and recall; of the union also
    source_count and, with a baseline, incremental_recall.
    """
    relevant = relevant.select("id1", "id2").distinct()
    total = relevant.count()
    marked = _candidate_pairs(candidates).join(relevant.withColumn("hit", F.lit(1)), ["id1", "id2"], "left")
    return _recall_metrics(marked, total, baseline)


def recall_by_label(labels: DataFrame, candidates: DataFrame, baseline: str | None = None) -> DataFrame:
    """recall where any two observations of one label are relevant to one another.

    labels has observation_id (once) and label. The relevant pairs are counted,
    not made: a label of n observations has n * (n - 1) / 2 of them.
    """
    total = labels.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(exhaustive_pair_count(F.col("n"))), F.lit(0))).first()[0]
    one, two = labels.select(F.col("observation_id").alias("id1"), F.col("label").alias("l1")), labels.select(F.col("observation_id").alias("id2"), F.col("label").alias("l2"))
    marked = _candidate_pairs(candidates).join(one, "id1", "left").join(two, "id2", "left").withColumn("hit", F.when((F.col("l1") == F.col("l2")) & (F.col("id1") != F.col("id2")), 1))
    return _recall_metrics(marked, total, baseline)


def _candidate_pairs(candidates: DataFrame) -> DataFrame:
    """The distinct pairs of each source, and those of all as source union."""
    pairs = scratch(candidates.select("id1", "id2", "source_id").distinct(), "recall-pairs")
    return pairs.unionByName(pairs.select("id1", "id2").distinct().withColumn("source_id", F.lit("union")))


def _recall_metrics(marked: DataFrame, total: int, baseline: str | None) -> DataFrame:
    counts = marked.groupBy("source_id").agg(F.count("*").cast("double").alias("candidate_count"), F.count("hit").cast("double").alias("hit_count"))
    counts = scratch(counts.withColumn("relevant_count", F.lit(total).cast("double")).withColumn("recall", F.expr("try_divide(hit_count, relevant_count)")), "recall-counts")
    long = counts.select("source_id", F.expr("stack(4, 'candidate_count', candidate_count, 'hit_count', hit_count, 'relevant_count', relevant_count, 'recall', recall) as (metric, value)"))
    sources = counts.where("source_id <> 'union'").agg(F.lit("union").alias("source_id"), F.lit("source_count").alias("metric"), F.count("*").cast("double").alias("value"))
    out = long.unionByName(sources)
    if baseline is not None:
        gain = counts.agg((F.max(F.when(F.col("source_id") == "union", F.col("recall"))) - F.max(F.when(F.col("source_id") == baseline, F.col("recall")))).alias("value"))
        out = out.unionByName(gain.select(F.lit("union").alias("source_id"), F.lit("incremental_recall").alias("metric"), "value"))
    return out.where("value is not null")


def benchmark_record(metrics: DataFrame, record_id: str, source_id: str = "union") -> DataFrame:
    """The metrics of one source as a single record, sorted by name."""
    vector = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return metrics.where(F.col("source_id") == source_id).groupBy("source_id").agg(vector.alias("metrics")).withColumn("record_id", F.lit(record_id))


def canonical_tracks(elements: DataFrame) -> DataFrame:
    """Per point and observation the least feature index. Negative or missing indexes are an error."""
    assert_empty(elements.where("feature_index is null or feature_index < 0 or observation_id is null"), "a track element is malformed")
    return elements.groupBy("point_id", "observation_id").agg(F.min("feature_index").alias("feature_index"))


def pairs_within(rows: DataFrame, group: str, columns: list[str], *, block: int = 1024) -> DataFrame:
    """x, y: every unordered pair of the rows of a group, as structs of the columns with x before y in their order.

    A group of at most block rows becomes one list. A larger one is dealt out to
    blocks of about that many rows, and every pair of its blocks is a group of
    its own that holds the rows of both, so a group of any size is many tasks
    of block * block pairs at most. Rows that repeat are rows of their own.
    """
    rows = scratch(rows.select(F.col(group).alias("_g"), *columns), "pair-rows")
    item = F.struct(*columns)
    sizes = scratch(rows.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > block), "large-groups")
    large = lookup(sizes)
    lists = spread(rows, rows.count(), "_g").join(large, "_g", "left_anti").groupBy("_g").agg(F.array_sort(F.collect_list(item)).alias("s")).where("size(s) > 1")
    dealt = rows.join(large, "_g").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).withColumn("_own", F.pmod(F.monotonically_increasing_id(), F.col("_blocks")).cast("int"))
    dealt = scratch(dealt, "large-dealt")  # a row's block is settled before it meets others
    met = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("_g", F.least("_own", "_k").alias("_p"), F.greatest("_own", "_k").alias("_q"), (F.col("_own") > F.col("_k")).alias("_right"), item.alias("_i"))
    met = met.groupBy("_g", "_p", "_q").agg(F.array_sort(F.collect_list(F.when(~F.col("_right"), F.col("_i")))).alias("s"), F.collect_list(F.when(F.col("_right"), F.col("_i"))).alias("t"))
    lists = lists.select("s").unionByName(met.where("_p = _q and size(s) > 1").select("s"))
    first = lists.select("s", F.posexplode("s").alias("i", "x"))
    within = first.select("x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))
    across = met.where("_p < _q").select(F.explode("s").alias("a"), "t").select("a", F.explode("t").alias("b"))
    return within.unionByName(across.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))


def shared_tracks(tracks: DataFrame, *, block: int = 1024) -> DataFrame:
    """id1, id2, shared_points of observations that see the same points.

    A point that many see is many tasks (pairs_within); pairs are counted before the shuffle by pair.
    """
    met = pairs_within(tracks.select("point_id", "observation_id").distinct(), "point_id", ["observation_id"], block=block)
    return met.groupBy(F.col("x.observation_id").alias("id1"), F.col("y.observation_id").alias("id2")).agg(F.count("*").alias("shared_points"))


def unordered_pairs(items: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (id1, id2) of the few distinct values of column, in order."""
    named = items.select(*by, F.col(column)).distinct()
    grouped = named.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("ids"))
    first = grouped.select(*by, "ids", F.posexplode("ids").alias("i", "id1"))
    return first.select(*by, "id1", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("id2"))


