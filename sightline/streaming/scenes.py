"""Scene labels that are kept up batch by batch: incremental merging of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import InvalidInput, assert_empty
from ..operators.clusters import clusters_of
from ..operators.graph import FEW_EDGES, components
from ..scratch import met, scratch
from .keyed import KeyedLog, Marks, Segment, segments_of, stored_keys

RELATION = "id1 string, id2 string, disposition string, evidence array<struct<kind:string,id:string>>"


def _after(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Renames of older, then of newer, as one: a node leads to where its root leads."""
    onward = newer.select(F.col("node").alias("_root"), F.col("root").alias("_to"))
    return older.join(onward.hint("merge"), older["root"] == onward["_root"], "left").select("node", F.coalesce("_to", "root").alias("root")).unionByName(newer)


class SceneLog:
    """Scene relations that arrive in batches, and the label of every observation after each.

    A label is the least member of the component of SUPPORTED relations, as
    scene_labels gives it for all relations at once. Kept are renames, from what
    was a root to the root that took it in. A batch's edges are contracted to
    the current roots, components run over these contracted edges alone, and
    what they rename is all that a batch adds. The renames lie in segments; a
    node's root is found by going through the few segments in order, and only
    files that may hold the nodes asked for are read. CONTRADICTED pairs are
    stored under both their roots, so a batch tests again only pairs of a root
    that it renames.

    Pairs must rise strictly from batch to batch, lie in order and join known
    observations, and a contradicted pair must not end up under one root: else
    InvalidInput is raised before the batch's mark, so that nothing of it counts.
    A batch of a number that has a mark adds nothing. All state is in the folder.

    observations has observation_id, each once; it is stored with the first
    batch and taken from there later.
    """

    def __init__(self, spark: SparkSession, folder: str, observations: DataFrame | None = None):
        self.spark, self.folder, self.given = spark, folder.rstrip("/"), observations
        self.marks = Marks(spark, self.folder)
        self.known = KeyedLog(spark, f"{self.folder}/known", "observation_id string", ["observation_id"])
        self.renames = KeyedLog(spark, f"{self.folder}/renames", "node string, root string", ["node"], _after)
        self.contradictions = KeyedLog(spark, f"{self.folder}/contradictions", "root string, id1 string, id2 string", ["root"])

    def _start(self, mark: dict) -> list[Segment]:
        if "known" in mark:
            return segments_of(mark, "known")
        if self.given is None:
            raise ValueError("the first batch needs the observations")
        known = scratch(self.given.select("observation_id"), "scene-known")
        assert_empty(known.groupBy("observation_id").count().where("count > 1 or observation_id is null"), "an observation occurs twice")
        return self.known.add([], known, known.count())

    def roots_of(self, live: list[Segment], nodes: DataFrame) -> DataFrame:
        """node, root of these nodes (column node, distinct), as a written table."""
        found = scratch(nodes.select("node", F.col("node").alias("root")), "scene-roots")
        for segment in live:
            on = self.renames.find([segment], stored_keys(found.select(F.col("root").alias("node")), ["node"]))
            on = scratch(on.select(F.col("node").alias("_root"), F.col("root").alias("_to")), "scene-renamed")
            found = scratch(found.join(met(on), F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_to", "root").alias("root")), "scene-roots")
        return found

    @staticmethod
    def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """pairs (id1, id2) with r1 and r2."""
        roots = met(roots)
        one, two = roots.select(F.col("node").alias("id1"), F.col("root").alias("r1")), roots.select(F.col("node").alias("id2"), F.col("root").alias("r2"))
        return pairs.join(one, "id1").join(two, "id2")

    def add(self, batch: DataFrame, number: int) -> None:
        last, mark = self.marks.last()
        if number <= last:
            return
        batch = scratch(batch.select("id1", "id2", "disposition", "evidence"), "scene-batch")
        ends = batch.agg(F.count("*").alias("n"), F.count_distinct("id1", "id2").alias("d"), F.min(F.struct("id1", "id2")).alias("low"), F.max(F.struct("id1", "id2")).alias("high")).first()
        if ends.n:
            assert_empty(batch.where("id1 is null or id2 is null or id1 >= id2"), "a pair is not in order")
            if ends.n != ends.d or ("high" in mark and tuple(ends.low) <= tuple(mark["high"])):
                raise InvalidInput("pairs must rise from batch to batch")
        known = self._start(mark)
        nodes = scratch(batch.select(F.col("id1").alias("node")).union(batch.select("id2")).distinct(), "scene-nodes")
        asked = nodes.select(F.col("node").alias("observation_id"))
        held = self.known.find(known, scratch(asked, "scene-asked"))
        assert_empty(asked.join(held.hint("merge"), "observation_id", "left_anti"), "a relation has an unknown observation")

        live, pairs = segments_of(mark, "renames"), segments_of(mark, "contradictions")
        roots = self.roots_of(live, nodes)
        joined = self._rooted(batch.select("id1", "id2", "disposition"), roots)
        edges = scratch(joined.where("disposition = 'SUPPORTED' and r1 <> r2").select("r1", "r2").distinct(), "scene-edges")
        renamed = components(edges, "r1", "r2", few=FEW_EDGES, meet=met).where("node <> root")
        renamed = scratch(renamed, "scene-renames")

        # contradicted pairs of this batch, and earlier ones under a root that changes
        keys = stored_keys(renamed.select(F.col("node").alias("root")), ["root"])
        again = self.contradictions.find(pairs, keys).select("id1", "id2", F.lit(False).alias("fresh")).distinct()
        tested = again.union(batch.where("disposition = 'CONTRADICTED'").select("id1", "id2", F.lit(True)))
        tested = scratch(tested, "scene-tested")
        n_tested, n_renamed, moved, n_moved = tested.count(), renamed.count(), None, 0
        if n_tested:
            ends_of = scratch(tested.select(F.col("id1").alias("node")).union(tested.select("id2")).distinct(), "scene-ends")
            before = self.roots_of(live, ends_of)
            now = before.join(met(renamed.select(F.col("node").alias("_root"), F.col("root").alias("_to"))), F.col("root") == F.col("_root"), "left")
            now = scratch(now.select("node", F.struct(F.coalesce("_to", "root").alias("to"), F.col("_to").isNotNull().alias("new")).alias("root")), "scene-now")
            rooted = scratch(self._rooted(tested, now), "scene-tested")
            assert_empty(rooted.where("r1.to = r2.to").select("id1", "id2"), "a contradicted pair is in one cluster")
            sides = [rooted.where(f"fresh or {r}.new").select(F.col(f"{r}.to").alias("root"), "id1", "id2") for r in ("r1", "r2")]
            moved = scratch(sides[0].union(sides[1]), "scene-contradictions")
            n_moved = moved.count()

        batch.write.mode("overwrite").parquet(f"{self.folder}/rows/{number:012d}")
        content = {
            "known": known,
            "renames": self.renames.add(live, renamed, n_renamed),
            "contradictions": pairs if moved is None else self.contradictions.add(pairs, moved, n_moved),
            "high": list(ends.high) if ends.n else mark.get("high"),
            "touched": {"relations": ends.n, "edges": edges.count(), "renamed": n_renamed, "tested": n_tested},
        }
        earlier = [self.marks.read(k) for k in self.marks.numbers()]
        self.marks.write(number, {k: v for k, v in content.items() if v is not None})
        if len(earlier) >= Marks.KEPT:  # the oldest of these marks is gone now
            for log, name in ((self.renames, "renames"), (self.contradictions, "contradictions")):
                kept = {s.name for m in (*earlier[1:], content) for s in segments_of(m, name)}
                log.discard([s for s in segments_of(earlier[0], name) if s.name not in kept])

    @property
    def touched(self) -> dict:
        """Of the last batch: relations, contracted edges, renamed roots, contradicted pairs tested."""
        return self.marks.last()[1].get("touched", {})

    @property
    def rows(self) -> DataFrame:
        """The relations of all batches that count."""
        last, _ = self.marks.last()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        numbers = sorted(int(x.getPath().getName()) for x in store.listStatus(root)) if last >= 0 else []
        some = [f"{self.folder}/rows/{k:012d}" for k in numbers if k <= last]
        return self.spark.read.schema(RELATION).parquet(*some) if some else self.spark.createDataFrame([], RELATION)

    @property
    def labels(self) -> DataFrame:
        """observation_id, root of every observation after the last batch."""
        _, mark = self.marks.last()
        known = self.known.rows(self._start(mark))
        renames = self.renames.rows(segments_of(mark, "renames"))
        return known.join(renames.hint("merge"), F.col("observation_id") == F.col("node"), "left").select("observation_id", F.coalesce("root", "observation_id").alias("root"))

    @property
    def clusters(self) -> DataFrame:
        """cluster_id, members, evidence, as scene_clusters gives them."""
        return clusters_of(scratch(self.labels, "scene-labels"), self.rows)


def stream_scenes(relations: DataFrame, log: SceneLog, checkpoint: str) -> StreamingQuery:
    """Feed a stream of relations to the log."""
    return relations.writeStream.foreachBatch(log.add).option("checkpointLocation", checkpoint).start()
