"""Scene relations and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import met, scratch
from .checks import assert_empty, assert_unique
from .graph import FEW_EDGES, components

#: Fixed value: two-view configurations that support a shared scene.
SUPPORTED_CONFIGURATIONS = ("CALIBRATED", "CALIBRATED_RIG", "UNCALIBRATED", "PLANAR", "PANORAMIC", "PLANAR_OR_PANORAMIC")


def scene_relations(candidates: DataFrame, geometry: DataFrame) -> DataFrame:
    """id1, id2, disposition, evidence of merged candidates, by their two-view geometry.

    geometry has id1, id2, configuration, inliers and a reference (kind, id). A
    relation is SUPPORTED with inliers in a configuration that allows it, else
    UNRESOLVED. Evidence unites all source references and that of the geometry, in order of (kind, id).
    """
    joined = candidates.join(geometry, ["id1", "id2"], "left")
    supported = (F.col("inliers") > 0) & F.col("configuration").isin(*SUPPORTED_CONFIGURATIONS)
    refs = F.flatten(F.transform("sources", lambda s: s["evidence"]))
    own = F.when(F.col("reference").isNotNull(), F.array("reference")).otherwise(F.expr("cast(array() as array<struct<kind:string,id:string>>)"))
    return joined.select("id1", "id2", F.when(F.coalesce(supported, F.lit(False)), "SUPPORTED").otherwise("UNRESOLVED").alias("disposition"), F.array_sort(F.array_distinct(F.concat(refs, own))).alias("evidence"))


def cluster_id(ids: str) -> Column:
    """The id of a cluster: a hash of its sorted members."""
    return F.concat(F.lit("scene:"), F.sha2(F.array_join(ids, "\n"), 256))


def scene_labels(observations: DataFrame, relations: DataFrame) -> DataFrame:
    """observation_id, root: the least member of each observation's component of SUPPORTED relations, as a written table.

    observations has observation_id; relations id1 < id2, disposition and
    evidence. A pair must occur once and join known observations, and no
    CONTRADICTED pair may end up in one component, else InvalidInput is raised.
    A component of any size is rows here, never one value.
    """
    relations = scratch(relations.select("id1", "id2", "disposition"), "scene-relations")
    assert_empty(relations.where("id1 >= id2"), "a pair is not in order")
    assert_unique(relations, ["id1", "id2"], "a pair occurs twice")
    ends = relations.select(F.col("id1").alias("observation_id")).union(relations.select("id2"))
    assert_empty(ends.join(observations.hint("merge"), "observation_id", "left_anti"), "a relation has an unknown observation")
    roots = scratch(components(relations.where("disposition = 'SUPPORTED'"), "id1", "id2", few=FEW_EDGES, meet=met), "scene-roots")
    labels = observations.select("observation_id").join(met(roots), F.col("observation_id") == F.col("node"), "left").select("observation_id", F.coalesce("root", "observation_id").alias("root"))
    labels = scratch(labels, "scene-labels")
    ends_of = met(labels)
    one, two = ends_of.select(F.col("observation_id").alias("id1"), F.col("root").alias("root")), ends_of.select(F.col("observation_id").alias("id2"), F.col("root").alias("root2"))
    conflicts = relations.where("disposition = 'CONTRADICTED'").join(one, "id1").join(two, "id2").where("root = root2")
    assert_empty(conflicts.select("id1", "id2"), "a contradicted pair is in one cluster")
    return labels


def scene_clusters(observations: DataFrame, relations: DataFrame) -> DataFrame:
    """cluster_id, members, evidence: the components of scene_labels as records.

    A cluster's id is a hash over all its members in order, so a record holds
    them as one array; where clusters may outgrow a row, use scene_labels.
    Observations without relations are clusters of one with no evidence.
    """
    return clusters_of(scene_labels(observations, relations), relations)


def clusters_of(labels: DataFrame, relations: DataFrame) -> DataFrame:
    """scene_clusters where the labels are known."""
    supported = relations.where("disposition = 'SUPPORTED'").join(labels.select(F.col("observation_id").alias("id1"), "root").hint("merge"), "id1")
    refs = supported.select("root", F.explode("evidence").alias("e"))
    evidence = refs.groupBy("root").agg(F.array_sort(F.collect_set("e")).alias("evidence"))
    members = labels.groupBy("root").agg(F.array_sort(F.collect_list("observation_id")).alias("members"))
    none = F.expr("cast(array() as array<struct<kind:string,id:string>>)")
    return members.join(evidence.hint("merge"), "root", "left").select(cluster_id("members").alias("cluster_id"), "members", F.coalesce("evidence", none).alias("evidence"))


def is_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether all nodes (column observation_id) are in one component of the edges (id1, id2)."""
    roots = components(edges, "id1", "id2", few=FEW_EDGES, meet=met)
    labelled = nodes.select("observation_id").distinct().join(roots.hint("merge"), F.col("observation_id") == F.col("node"), "left").select(F.coalesce("root", "observation_id").alias("root"))
    return labelled.distinct().count() <= 1


def model_outcomes(runs: DataFrame, models: DataFrame) -> DataFrame:
    """run_id, model_count, state of each run by how many models it made."""
    counts = runs.select("run_id").join(models.groupBy("run_id").agg(F.count("*").alias("n")), "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("model_count"))
    state = F.when(F.col("model_count") == 0, "NO_MODEL").when(F.col("model_count") == 1, "SINGLE_MODEL").otherwise("DISCONNECTED_MODELS")
    return counts.withColumn("state", state)
