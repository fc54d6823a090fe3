"""Nearest neighbours in space: cells that split where points are dense, solved leaf by leaf."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import lookup, scratch
from ..shipping import ship_package

#: A cell of more places is split; where the leaves would be more than MOST_LEAVES, a cell may hold more.
LEAF_PLACES, MOST_LEAVES = 2048, 1 << 17
#: The side of the cells of level 0, in the unit of the coordinates, and how often a cell is halved at most.
ROOT_SIDE, DEEPEST = float(1 << 24), 60
#: Places that a task compares with at a time.
BLOCK = 512
AXES = ("x", "y", "z")


def _cell(level: int) -> list:
    return [F.floor(F.col(c) / F.lit(ROOT_SIDE / 2.0**level)).alias(f"c{c}") for c in AXES]


def _leaves(places: DataFrame, most: int) -> DataFrame:
    """places with leaf (level and cell): the largest cell around a place that holds at most so many places.

    All cells of a level that hold too many are split in one step, and only
    their places go into it. Places are distinct, so cells run out of them; what
    is left at DEEPEST is a leaf however full it is.
    """
    found: list[DataFrame] = []
    open_places, level = places, 0
    while True:
        here = open_places.withColumns({f"c{c}": v for c, v in zip(AXES, _cell(level), strict=True)})
        key = [f"c{c}" for c in AXES]
        counts = scratch(here.groupBy(*key).agg(F.count("*").alias("_n")), "cell-counts")
        full = counts.where(F.col("_n") > most) if level < DEEPEST else counts.limit(0)
        split = scratch(full.drop("_n"), "cells-to-split")
        leaf = F.struct(F.lit(level).alias("level"), *key)
        found.append(scratch(here.join(lookup(split), key, "left_anti").withColumn("leaf", leaf).drop(*key), "leaf-places"))
        if not split.limit(1).count():
            break
        open_places = scratch(here.join(lookup(split), key, "left_semi").drop(*key), "open-places")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class Boxes:
    """The leaves: the box of each one's places, and how many candidates it has. At most MOST_LEAVES of them."""

    def __init__(self, rows: list):
        self.low = np.array([[r[f"low_{c}"] for c in AXES] for r in rows]).reshape(-1, 3)
        self.high = np.array([[r[f"high_{c}"] for c in AXES] for r in rows]).reshape(-1, 3)
        self.n = np.array([r.n for r in rows], np.int64)

    def nearest(self, low: np.ndarray, high: np.ndarray, some: np.ndarray) -> np.ndarray:
        """How far these leaves are, at least, from boxes (rows of low and high)."""
        gap = np.maximum(0, np.maximum(self.low[some] - high[:, None], low[:, None] - self.high[some]))
        return np.sqrt((gap * gap).sum(axis=2))

    def farthest(self, at: np.ndarray, some: np.ndarray) -> np.ndarray:
        reach = np.maximum(np.abs(self.low[some] - at[:, None]), np.abs(self.high[some] - at[:, None]))
        return np.sqrt((reach * reach).sum(axis=2))


def _points(part: pa.Table) -> np.ndarray:
    return np.stack([part.column(c).to_numpy() for c in AXES], axis=1) if part.num_rows else np.zeros((0, 3))


def _solve(at: np.ndarray, places: np.ndarray, ids: list, most: int, limit: np.ndarray) -> Iterator[list[tuple[float, str]]]:
    """For each place of at: the first `most` of (distance, id) among the ids at places within limit."""
    for k in range(0, len(at), BLOCK):
        some = at[k : k + BLOCK]
        total = np.zeros((len(some), len(places)))
        for axis in range(3):
            step = some[:, axis, None] - places[None, :, axis]
            total += step * step
        far = np.sqrt(total)
        edge = np.partition(far, most - 1, axis=1)[:, most - 1] if len(places) > most else np.full(len(some), np.inf)
        for row, bound in zip(far, np.minimum(edge, limit[k : k + BLOCK]), strict=True):
            near = np.flatnonzero(row <= bound)
            yield sorted((float(row[j]), i) for j in near for i in ids[j])[:most]


def neighbours(points: DataFrame, id_col: str, most: int, radius: float, *, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """a, b, d: of every point the `most` nearest others within radius, by distance, ties by id.

    points has id_col, x, y, z. Points of one place are nearest to the same
    others, so a place is solved once, and as candidates its most + 1 least ids
    are enough: a place with a million points costs no more than one with few.
    Space is cut into cells that are halved until each holds at most leaf_places
    places (more, if there would be too many leaves to send to every task). A
    leaf is solved alone; the distance of a place's last neighbour there, or
    the far corner of leaves with enough candidates, bounds what is still of
    use. Places go on to the other leaves whose nearest corner is within that
    bound, in groups of equal size, and the results are merged. Exact for any leaf_places.

    Null or non-finite coordinates and null ids take no part. Points that repeat
    an id are never each other's neighbours. No points give no rows.
    """
    spark = points.sparkSession
    ship_package(spark)
    keep = most + 1
    usable = points.select(F.col(id_col).cast("string").alias("id"), *((F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in AXES))
    usable = scratch(usable.where("id is not null and " + " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in AXES)), "neighbour-points")
    ranked = usable.distinct().withColumn("k", F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))).where(F.col("k") <= keep)
    places = scratch(ranked.groupBy(*AXES).agg(F.array_sort(F.collect_list("id")).alias("ids")), "neighbour-places")
    n = places.count()
    # a row of its own for each place, by which results are put together
    places = scratch(places.withColumn("place", F.monotonically_increasing_id()), "neighbour-places", n)
    while True:
        placed = _leaves(places, leaf_places)
        boxes = placed.groupBy("leaf").agg(F.count("*").alias("places"), F.sum(F.size("ids")).alias("n"), *(F.min(c).alias(f"low_{c}") for c in AXES), *(F.max(c).alias(f"high_{c}") for c in AXES))
        boxes = scratch(boxes, "neighbour-leaves")
        if boxes.count() <= MOST_LEAVES:
            break
        leaf_places *= 4
    rows = boxes.collect()  # at most MOST_LEAVES
    held = spark.sparkContext.broadcast(Boxes(rows))
    numbers = spark.createDataFrame([(tuple(r.leaf), i) for i, r in enumerate(rows)], "leaf struct<level:int,cx:bigint,cy:bigint,cz:bigint>, number int") if rows else None
    if numbers is None:
        return spark.createDataFrame([], "a string, b string, d double")
    placed = scratch(placed.join(lookup(scratch(numbers, "leaf-numbers", len(rows))), "leaf").drop("leaf"), "neighbour-placed")
    schema = "place long, x double, y double, z double, ds array<double>, found array<string>, bound double, to array<int>"
    names = ["place", *AXES, "ds", "found", "bound", "to"]

    def at_home(key: tuple, part: pa.Table) -> pa.Table:
        all_boxes, own = held.value, key[0].as_py()
        at = _points(part)
        found = list(_solve(at, at, part.column("ids").to_pylist(), keep, np.full(len(at), radius)))
        bound = np.array([min(f[-1][0], radius) if len(f) == keep else radius for f in found])
        near = np.flatnonzero(all_boxes.nearest(at.min(axis=0)[None], at.max(axis=0)[None], np.arange(len(all_boxes.n)))[0] <= bound.max())
        enough = near[all_boxes.n[near] >= keep]
        to: list[list[int]] = []
        others = near[near != own]
        for k in range(0, len(at), BLOCK):
            some = at[k : k + BLOCK]
            if len(enough):  # a leaf with enough candidates bounds the distance, too
                step = max(1, (1 << 22) // len(some))
                for j in range(0, len(enough), step):
                    bound[k : k + BLOCK] = np.minimum(bound[k : k + BLOCK], all_boxes.farthest(some, enough[j : j + step]).min(axis=1) * (1 + 1e-12))
            step = max(1, (1 << 22) // len(some))
            lists: list[list[int]] = [[] for _ in some]
            for j in range(0, len(others), step):
                within = all_boxes.nearest(some, some, others[j : j + step]) <= bound[k : k + BLOCK, None] * (1 + 1e-12)
                for row, col in zip(*np.nonzero(within), strict=True):
                    lists[row].append(int(others[j + col]))
            to += lists
        return pa.table([part.column("place"), *(part.column(c) for c in AXES), pa.array([[d for d, _ in f] for f in found], pa.list_(pa.float64())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.string())), pa.array(bound, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=names)

    home = scratch(placed.groupBy("number").applyInArrow(at_home, schema), "neighbour-home")
    sent = scratch(home.select("place", *AXES, "bound", F.explode("to").alias("number")), "neighbour-sent")
    blocks = sent.groupBy("number").agg(F.ceil(F.count("*") / F.lit(2 * leaf_places)).cast("int").alias("blocks"))  # a row for each leaf
    blocks = F.broadcast(scratch(blocks, "neighbour-blocks", len(rows)))
    asked = sent.join(blocks, "number").select("place", *AXES, "bound", F.col("number").alias("number"), F.pmod(F.xxhash64("place"), F.col("blocks")).alias("block"))
    given = placed.join(blocks, "number").select("ids", *(F.col(c).alias(c) for c in AXES), F.col("number").alias("number"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("block"))

    def away(key: tuple, asking: pa.Table, part: pa.Table) -> pa.Table:
        found = list(_solve(_points(asking), _points(part), part.column("ids").to_pylist(), keep, asking.column("bound").to_numpy() * (1 + 1e-12)))
        return pa.table({"place": asking.column("place"), "ds": pa.array([[d for d, _ in f] for f in found], pa.list_(pa.float64())), "found": pa.array([[i for _, i in f] for f in found], pa.list_(pa.string()))})

    others = asked.groupBy("number", "block").cogroup(given.groupBy("number", "block")).applyInArrow(away, "place long, ds array<double>, found array<string>")
    lists = home.select("place", "ds", "found").unionByName(others)
    each = lists.select("place", F.explode(F.arrays_zip("ds", "found")).alias("f")).select("place", F.col("f.ds").alias("d"), F.col("f.found").alias("b")).where(F.col("d") <= radius)
    best = each.withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("d", "b"))).where(F.col("k") <= keep)
    best = scratch(best.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("best")), "neighbour-best")
    by_place = places.select("place", *(F.col(c).alias(f"_{c}") for c in AXES)).join(best, "place").drop("place")
    own = usable.join(by_place, [F.col(c) == F.col(f"_{c}") for c in AXES])
    mine = F.slice(F.filter("best", lambda x: x["b"] != F.col("id")), 1, most)
    return own.select(F.col("id").alias("a"), F.explode(mine).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
