"""What results of outside solvers and models must satisfy before they count as evidence."""

from __future__ import annotations

from collections.abc import Mapping

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import InvalidInput, assert_empty, assert_unique
from .identity import check_ancestry, check_new_identity, same_rows


def check_environment(expected: Mapping[str, str], found: Mapping[str, str], required: tuple[str, ...] = ()) -> None:
    """Versions must be exactly the reviewed ones, and what is required must be there."""
    other = {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v}
    missing = [k for k in required if k not in found]
    if other or missing:
        raise InvalidInput(f"another environment: {other or missing}")


def check_membership(expected: DataFrame, found: DataFrame, columns: list[str]) -> None:
    """found must hold exactly the keys of expected, each once."""
    assert_unique(found, columns, "a row comes twice")
    assert_empty(found.join(expected, columns, "left_anti").select(*columns), "a row that was not asked for")
    assert_empty(expected.join(found, columns, "left_anti").select(*columns), "a row is missing")


def canonical_matches(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """id1, id2, raw_matches, swapped, and the columns by: pairs in order of their ids; a pair given twice is an error.

    by names the run that a pair is of, where matches holds several: each of them may give it.
    """
    rows = matches.select(*by, F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "raw_matches", (F.col("a") > F.col("b")).alias("swapped"))
    assert_empty(rows.where("id1 = id2"), "an image is matched with itself")
    assert_unique(rows, [*by, "id1", "id2"], "a pair comes twice")
    return rows


def verified_geometry(matches: DataFrame, geometry: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """matches with configuration and inliers; each raw pair (of a run, see canonical_matches) has one geometry and no more inliers than matches."""
    key = [*by, "id1", "id2"]
    check_membership(matches.select(*key), geometry.select(*key), key)
    joined = matches.join(geometry.select(*key, "configuration", "inliers"), key)
    assert_empty(joined.where("inliers < 0 or inliers > raw_matches"), "inlier counts disagree")
    return joined


def feature_audit(images: DataFrame, keypoints: DataFrame, descriptors: DataFrame) -> DataFrame:
    """name, keypoint_count, descriptor_count of each image; the counts must agree."""
    joined = images.join(keypoints, "image_id").join(descriptors, "image_id").select("name", "keypoint_count", "descriptor_count")
    assert_empty(joined.where("keypoint_count <> descriptor_count"), "counts of features disagree")
    return joined.orderBy("name")


def plan_key(stage: str, configuration_sha256: Column, parents: Column) -> Column:
    """The key of a stage's evidence, from its configuration and the keys of what it builds on."""
    return F.concat(F.lit(f"evidence:{stage}:"), F.sha2(F.concat_ws("\n", F.lit(stage), configuration_sha256, F.array_join(F.array_sort(parents), "\n")), 256))


def check_publication(published: DataFrame, plans: DataFrame) -> None:
    """What is published must have a plan of the same key, configuration and parent."""
    joined = published.alias("p").join(plans.alias("q"), F.col("p.key") == F.col("q.key"), "left")
    bad = F.col("q.key").isNull() | ~F.col("p.configuration").eqNullSafe(F.col("q.configuration")) | ~F.col("p.parent").eqNullSafe(F.col("q.parent"))
    assert_empty(joined.where(bad).select("p.key"), "a result does not match its plan")


def check_refinement(result_ids: DataFrame, input_ids: DataFrame, scale_status: str) -> None:
    """A refined solution is a new one, and claims no scale."""
    check_new_identity(result_ids, input_ids)
    if scale_status != "UNRESOLVED":
        raise InvalidInput("a refinement must not claim a scale")


def check_derived(result: DataFrame, sources: DataFrame, result_ids: DataFrame, input_ids: DataFrame, attributes: tuple[DataFrame, DataFrame] | None = None) -> None:
    """A derived artifact has a new id, exactly the ancestry of its sources and, where given, the same frame, scale and uses."""
    check_new_identity(result_ids, input_ids)
    check_ancestry(result, sources)
    if attributes is not None and not same_rows(*attributes):
        raise InvalidInput("a derived artifact changes what it must keep")


def canonical_model(cameras: DataFrame, names: DataFrame) -> DataFrame:
    """Cameras under the observations' ids, by the images' names; each name stands for one observation."""
    check_membership(names.select("name"), cameras.select("name"), ["name"])
    return cameras.join(names, "name").drop("name").withColumn("scale_status", F.lit("UNRESOLVED"))


def geometry_semantics(pixels: DataFrame) -> DataFrame:
    """camera, valid_count, all_valid_positive of depth fields."""
    return pixels.groupBy("camera").agg(F.count_if("valid").alias("valid_count"), F.coalesce(F.bool_and(F.when(F.col("valid"), F.col("depth") > 0)), F.lit(True)).alias("all_valid_positive"))
