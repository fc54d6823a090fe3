"""Retrieval by a vocabulary tree: hierarchical k-means, an inverted index, and tf-idf scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import lookup, scratch
from ..shipping import ship_package
from .checks import assert_empty, assert_unique
from .pairs import canonical_pair

#: A tree is sent to all tasks; it may take so many bytes.
TREE_BYTES = 256 << 20
#: Scores are compared after rounding to so many digits, so that the order of a sum decides nothing.
DIGITS = 9


def whole_features(features: DataFrame, scale: int = 1024) -> DataFrame:
    """observation_id, feature_index, v: the descriptors as whole numbers, floor(scale * x).

    A feature occurs once, all have one width and finite components, else InvalidInput is raised.
    """
    bad = F.col("descriptor").isNull() | F.exists("descriptor", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale >= float(1 << 24)))
    assert_empty(features.where(bad | F.col("observation_id").isNull()).select("observation_id", "feature_index"), "a descriptor is malformed")
    assert_unique(features, ["observation_id", "feature_index"], "a feature occurs twice")
    rows = features.select("observation_id", "feature_index", F.transform("descriptor", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    rows = scratch(rows, "features")
    assert_empty(rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).where("least <> most"), "descriptors differ in width")
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class Level:
    """Centroids of the children of each node of a level; absent ones are infinitely far. At most TREE_BYTES."""

    def __init__(self, rows: list, branching: int):
        width = len(rows[0].x) if rows else 1
        self.at = {n: k for k, n in enumerate(sorted({r.node for r in rows}))}
        if len(self.at) * branching * width * 8 > TREE_BYTES:
            raise ValueError("the tree is too large to be sent to all tasks")
        self.centroids = np.full((len(self.at), branching, width), np.inf)
        for r in rows:
            self.centroids[self.at[r.node], r.child] = r.x

    def children(self, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The nearest child of each row's node (ties: the smaller)."""
        out = np.zeros(len(rows), np.int64)
        for node in np.unique(nodes):
            mine = np.flatnonzero(nodes == node)
            for k in range(0, len(mine), 4096):
                some = mine[k : k + 4096]
                out[some] = ((rows[some][:, None] - self.centroids[self.at[int(node)]]) ** 2).sum(axis=2).argmin(axis=1)
        return out


def train_tree(features: DataFrame, *, branching: int = 8, depth: int = 3, rounds: int = 5, seed: int = 3) -> DataFrame:
    """level, node, child, x: the tree of centroids, from whole_features.

    Level by level, all nodes of a level at once. A node's first centroids are
    the branching of its distinct vectors with the least hash of (seed, vector);
    each round makes a centroid the floor of its features' mean (one without
    features stays). A round is one job that adds up by node, child and
    component before the shuffle. Node n has the children n * branching + child
    on the next level, the root is 0; a child of the last level is a word.
    """
    spark = features.sparkSession
    ship_package(spark)
    held = features.select("v", F.lit(0).cast("long").alias("node"))
    out: list[DataFrame] = []
    for level in range(depth):
        named = held.select("node", "v").distinct().withColumn("h", F.sha2(F.concat_ws(",", F.lit(str(seed)), F.col("v").cast("array<string>")), 256))
        first = named.withColumn("child", F.row_number().over(Window.partitionBy("node").orderBy("h", "v")) - 1).where(F.col("child") < branching)
        rows = {(r.node, r.child): r.v for r in first.select("node", "child", "v").collect()}  # the tree's size, checked below

        def table(rows: dict) -> Level:
            from pyspark.sql import Row

            return Level([Row(node=n, child=c, x=x) for (n, c), x in rows.items()], branching)

        for _ in range(rounds):
            tree = spark.sparkContext.broadcast(table(rows))

            def sums(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    x, nodes = _matrix(batch.column(0)), batch.column(1).to_numpy()
                    keys = nodes * branching + tree.value.children(nodes, x)
                    for key in np.unique(keys):
                        mine = x[keys == key]
                        part = np.append(mine.sum(axis=0), len(mine))  # whole numbers below 2**53
                        total[int(key)] = total[int(key)] + part if int(key) in total else part
                for key, part in total.items():
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(part.astype(np.int64))], names=["key", "dim", "s"])

            summed = held.mapInArrow(sums, "key long, dim int, s long").groupBy("key", "dim").agg(F.sum("s").alias("s"))
            means: dict[int, dict[int, int]] = {}
            for r in summed.collect():  # a row for each component of the level's centroids
                means.setdefault(r.key, {})[r.dim] = r.s
            for key, by in means.items():
                n = by[len(by) - 1]
                rows[key // branching, key % branching] = [by[d] // n for d in range(len(by) - 1)]
        out.append(spark.createDataFrame([(level, n, c, [int(v) for v in x]) for (n, c), x in sorted(rows.items())], "level int, node long, child int, x array<int>"))
        held = scratch(_descended(held, table(rows), branching), "tree-features")
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return scratch(made, "vocabulary-tree")


def _descended(rows: DataFrame, level: Level, branching: int) -> DataFrame:
    """rows (last columns v and node) with node one level down."""
    tree = rows.sparkSession.sparkContext.broadcast(level)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(names.index("node")).to_numpy()
            down = nodes * branching + tree.value.children(nodes, _matrix(batch.column(names.index("v"))))
            yield pa.RecordBatch.from_arrays([pa.array(down) if c == "node" else batch.column(k) for k, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, rows.schema)


def feature_words(features: DataFrame, tree: DataFrame, *, branching: int) -> DataFrame:
    """observation_id, word, n: how often each word occurs among an observation's features."""
    ship_package(features.sparkSession)
    rows = features.select("observation_id", "v", F.lit(0).cast("long").alias("node"))
    by_level: dict[int, list] = {}
    for r in tree.collect():  # at most TREE_BYTES, as Level checks
        by_level.setdefault(r.level, []).append(r)
    for level in sorted(by_level):
        rows = _descended(rows, Level(by_level[level], branching), branching)
    return rows.groupBy("observation_id", F.col("node").alias("word")).agg(F.count("*").alias("n"))


def tree_pairs(words: DataFrame, neighbors: int, *, heavy: int = 4096) -> DataFrame:
    """id1, id2, similarity: pairs where one is among the other's `neighbors` best by tf-idf, ties by id.

    words is feature_words. A word weighs n / total of the observation times
    ln(observations / those that have it), and the vectors are scaled to
    length 1; the score is their product, rounded to DIGITS digits, and pairs
    without a common word of weight have none.

    Words are an inverted index, joined on the word. A word that more than
    heavy observations have would meet itself in too many pairs, and weighs
    little: it is left aside at first. What all such words of a query can add to any
    score bounds what a pair may still gain; only pairs whose score with that
    could reach the query's last place get it added. Queries for which that decides
    nothing (the bound is beyond their last place) are compared with all
    observations, block by block (best_in_blocks). So the result is exact for any heavy.

    Observations with the same words, each as often, are compared once: the
    least of their ids stands for them, and of the neighbors + 1 best of such a
    kind (itself among them) as many of the least ids are all that can be of use.
    """
    words = scratch(words, "tree-words")
    n = words.select("observation_id").distinct().count()
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    total = words.groupBy("observation_id").agg(F.sum("n").alias("total"))
    raw = words.join(df, "word").join(total, "observation_id").withColumn("t", F.col("n") / F.col("total") * F.log(F.lit(n) / F.col("df")))
    norm = raw.groupBy("observation_id").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("norm"))
    index = raw.join(norm, "observation_id").where("norm > 0 and t > 0").select("observation_id", "word", "df", (F.col("t") / F.col("norm")).alias("w"))
    index = scratch(index, "tree-index")
    told = index.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("x"))
    told = told.join(words.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("counts")), "observation_id")
    told = scratch(told.select("observation_id", F.sha2(F.to_json(F.struct("counts")), 256).alias("kind"), F.aggregate("x", F.lit(0.0), lambda t, e: t + e["w"] * e["w"]).alias("own")), "tree-kinds")
    kinds = scratch(told.groupBy("kind").agg(F.min("observation_id").alias("first"), F.count("*").alias("members"), F.max("own").alias("own")), "tree-kinds-first")
    index = scratch(index.join(kinds.select(F.col("first").alias("observation_id")), "observation_id", "left_semi"), "tree-index-of-kinds")
    asked_for, neighbors = neighbors, neighbors + 1
    light, large = index.where(F.col("df") <= heavy), index.where(F.col("df") > heavy)

    def scores(queries: DataFrame, rows: DataFrame) -> DataFrame:
        q, d = queries.select("word", F.col("observation_id").alias("a"), F.col("w").alias("wa")), rows.select("word", F.col("observation_id").alias("b"), F.col("w").alias("wb"))
        return q.join(d, "word").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))

    met = scratch(scores(light, light), "tree-light")
    place = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    last = met.withColumn("k", F.row_number().over(place)).where(F.col("k") == neighbors).select("a", F.col("s").alias("least"))
    most = large.groupBy("word").agg(F.max("w").alias("m"))
    gain = large.join(lookup(scratch(most, "tree-heavy")), "word").groupBy(F.col("observation_id").alias("a")).agg(F.sum(F.col("w") * F.col("m")).alias("gain"))
    about = index.select(F.col("observation_id").alias("a")).distinct().join(last, "a", "left").join(gain, "a", "left")
    slack = 10.0 ** (1 - DIGITS)
    about = scratch(about.select("a", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.col("least"), (F.coalesce("gain", F.lit(0.0)) > 0).alias("gains")), "tree-bounds")
    settled = about.where(f"not gains or least > gain + {slack}")
    near = met.join(settled, "a").where(f"least is null or s + gain >= least - {slack}").select("a", "b", "s", "gains")
    near = scratch(near, "tree-near")
    one = near.where("gains").select("a", "b").join(large.select(F.col("observation_id").alias("a"), "word", F.col("w").alias("wa")), "a")
    more = one.join(large.select(F.col("observation_id").alias("b"), "word", F.col("w").alias("wb")), ["b", "word"]).select("a", "b", (F.col("wa") * F.col("wb")).alias("s"))
    asked = about.where(f"gains and (least is null or least <= gain + {slack})").select(F.col("a").alias("observation_id"))
    vectors = index.groupBy("observation_id").agg(F.collect_list(F.struct("word", "w")).alias("x"))
    vectors = scratch(vectors.select("observation_id", F.transform("x", lambda x: x["word"]).alias("words"), F.transform("x", lambda x: x["w"]).alias("weights")), "tree-vectors")
    opened = best_in_blocks(vectors.join(lookup(scratch(asked, "tree-open")), "observation_id", "left_semi"), vectors, neighbors)
    settled_scores = near.select("a", "b", "s").unionByName(more).groupBy("a", "b").agg(F.round(F.sum("s"), DIGITS).alias("s"))
    own = kinds.where("members > 1").select(F.col("first").alias("a"), F.col("first").alias("b"), F.round("own", DIGITS).alias("s"))
    best = settled_scores.unionByName(opened).unionByName(own).withColumn("k", F.row_number().over(place)).where(F.col("k") <= neighbors).drop("k")
    placed = told.join(kinds.select("kind", F.col("first").alias("b")), "kind").withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("observation_id")))
    placed = scratch(placed.where(F.col("k") <= neighbors).select("b", F.col("observation_id").alias("member")), "tree-members")
    best = best.join(placed, "b").select("a", F.col("member").alias("b"), "s").withColumn("k", F.row_number().over(place)).where(F.col("k") <= neighbors)
    best = best.select(F.col("a").alias("first"), "b", "s")
    each = told.join(kinds.select("kind", "first"), "kind").select("first", F.col("observation_id").alias("a")).join(best, "first").where("a <> b").select("a", "b", "s")
    best = each.withColumn("k", F.row_number().over(place)).where(F.col("k") <= asked_for)
    return best.select(*canonical_pair("a", "b"), "s").groupBy("id1", "id2").agg(F.max("s").alias("similarity"))


def _dense(given: pa.Table, at: dict[int, int]) -> np.ndarray:
    """A row for each vector, a column for each word of at; other words are left out."""
    out = np.zeros((given.num_rows, max(1, len(at))))
    words = given.column("words").combine_chunks()
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    columns = np.array([at.get(w, -1) for w in words.flatten().to_pylist()], np.int64)
    held = columns >= 0
    out[np.repeat(np.arange(given.num_rows), lengths)[held], columns[held]] = given.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[held]
    return out


def best_in_blocks(queries: DataFrame, rows: DataFrame, neighbors: int, *, block: int = 4096, strip: int = 256, words_at_once: int = 512) -> DataFrame:
    """a, b, s: for each query the `neighbors` others of highest score, ties by id, and some more.

    Both have observation_id, words, weights (all above 0). Queries and rows
    are dealt to blocks by a hash, and each pair of blocks is a group that gives its
    own best; those of a query are picked from them by the caller. A score is
    the sum over common words, rounded to DIGITS digits; without one there is none.
    Work grows with the product of both; memory is a block of each, and
    strip x block scores and words_at_once words of them at a time.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n_queries, n_rows = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("observation_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["observation_id", "words", "weights"]
    own_names = [F.col(c).alias(c) for c in columns]  # queries may be rows themselves, and meet them
    left = queries.select(*own_names, deal(n_queries).alias("i")).select(*columns, "i", every(n_rows).alias("j"))
    right = rows.select(*columns, deal(n_rows).alias("j")).select(*columns, every(n_queries).alias("i"), "j")

    def solve(key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and given.num_rows:
            given = given.sort_by("observation_id")
            a, b = asked.column("observation_id").to_pylist(), given.column("observation_id").to_pylist()
            place = {name: k for k, name in enumerate(b)}
            for first in range(0, len(a), strip):
                some = asked.slice(first, strip)
                known = sorted(set(some.column("words").combine_chunks().flatten().to_pylist()))
                raw = np.zeros((some.num_rows, len(b)))
                for k in range(0, len(known), words_at_once):
                    at = {w: c for c, w in enumerate(known[k : k + words_at_once])}
                    raw += _dense(some, at) @ _dense(given, at).T
                for k in range(some.num_rows):
                    own = place.get(a[first + k])
                    if own is not None:
                        raw[k, own] = 0.0
                score = np.where(raw > 0, np.round(raw, DIGITS), -1.0)
                if len(b) > neighbors:
                    least = np.partition(score, len(b) - neighbors, axis=1)[:, len(b) - neighbors, None]
                else:
                    least = np.full((some.num_rows, 1), -0.5)
                row, col = np.nonzero((score >= least) & (score >= 0))
                order = np.lexsort((col, -score[row, col], row))  # rows of given are in order of their ids
                row, col = row[order], col[order]
                begins = np.searchsorted(row, row)
                kept = np.arange(len(row)) - begins < neighbors
                row, col = row[kept], col[kept]
                found[0].extend(a[first + k] for k in row)
                found[1].extend(b[k] for k in col)
                found[2].extend(score[row, col].tolist())
        return pa.table([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["a", "b", "s"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(solve, "a string, b string, s double")
