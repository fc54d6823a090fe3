"""Connected components of an edge table: distributed union-find by star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..scratch import lookup, scratch
from ..shipping import ship_package

#: What callers give as few: edges that one task joins up sooner than rounds do.
FEW_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task; the least node of a component is its root."""
    parent: dict = {}

    def find(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 10_000):
        some = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(n) for n in some], kind)], names=["node", "root"])


def components(edges: DataFrame, left: str, right: str, *, few: int = 0, meet: Callable[[DataFrame], DataFrame] = lookup) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Large-star and small-star steps hang every node on ever smaller neighbours
    until the edges stop changing; then each edge leads from a node to its root.
    A step takes minima by node, combined before the shuffle, and joins them
    back, so a node with many edges is never gathered in one task. Nothing is
    collected but a count and a checksum. At most few edges, which are counted
    first, are one task's union-find. meet says how the minima are joined. Nodes must not be null. No edges give no rows.
    """
    kind = edges.select(F.greatest(left, right).alias("node")).schema["node"]
    edges = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    edges = scratch(edges, "cc-edges")
    state = _state(edges)
    if state[0] <= few:
        ship_package(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_joined, StructType([kind, StructField("root", kind.dataType)]))
    while True:
        # large star: every larger neighbour is hung on the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = 2 * state[0]  # a step makes no more rows than that
        least = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least", most)
        hung = both.where("b > a").join(meet(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch(hung.where("a <> b").distinct(), "cc-large", most)
        # small star: smaller neighbours and the node itself are hung on the least of them
        least = scratch(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-small", most)
        joined = edges.join(meet(least), "a")
        edges = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch(edges, "cc-edges", most)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
