"""What derived artifacts must keep of what they were made from: rules of surfaces, appearances and depth priors.

Every rule that a result breaks is a row (request_id, problem), so any number of results are judged at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import _union, order_problems


def _each(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """request_id, problem of every rule that is broken."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items())))
    return rows.select("request_id", F.explode(named).alias("problem"))


def _changed(column: str) -> Column:
    return ~F.col(column).eqNullSafe(F.col(f"asked_{column}"))


def _joined(requests: DataFrame, results: DataFrame) -> DataFrame:
    asked = requests.select("request_id", *(F.col(c).alias(f"asked_{c}") for c in requests.columns if c != "request_id"))
    return asked.join(results, "request_id")


def _named(rows: DataFrame, problem: str) -> DataFrame:
    return rows.select("request_id").distinct().withColumn("problem", F.lit(problem))


def ancestry_problems(requests: DataFrame, results: DataFrame, sources: DataFrame, supporting: DataFrame, ancestry: DataFrame) -> DataFrame:
    """The rules on ancestors: request_id, problem.

    requests has request_id; results request_id, artifact_id, artifact_kind;
    sources (request_id, kind, id) what the source itself was made from;
    supporting and ancestry request_id, position, kind, id. Supporting artifacts are unique and in
    order of (id, kind). A result's ancestry is exactly the union of sources and supporting
    artifacts, each once, in that order, and the result is none of them. A
    request has one result.
    """
    key = ["request_id", "kind", "id"]
    needed = sources.select(*key).unionByName(supporting.select(*key)).distinct()
    own = results.select("request_id", F.col("artifact_kind").alias("kind"), F.col("artifact_id").alias("id"))
    return _union([
        _named(requests.join(results, "request_id", "left_anti"), "no_result"),
        _named(results.join(requests, "request_id", "left_anti"), "no_request"),
        _named(results.groupBy("request_id").count().where("count > 1"), "two_results"),
        order_problems(supporting, "request_id", ["id", "kind"], "supporting"),
        order_problems(ancestry, "request_id", ["id", "kind"], "ancestor"),
        _named(needed.join(ancestry, key, "left_anti"), "ancestor_missing"),
        _named(ancestry.join(needed, key, "left_anti"), "ancestor_unknown"),
        _named(own.join(needed, key, "left_semi"), "input_reused"),
    ])


def list_problems(asked: DataFrame, found: DataFrame, column: str, noun: str) -> DataFrame:
    """A list of the result must be the request's, in its order: other_<noun> where they differ. Both have request_id, position and column."""
    rank = lambda rows: rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", column))), lambda x: x[column]).alias("l"))
    both = rank(asked).join(rank(found).withColumnRenamed("l", "l2"), "request_id", "full")
    return _named(both.where("not l <=> l2"), f"other_{noun}")


def hybrid_surface_problems(requests: DataFrame, results: DataFrame, sources: DataFrame, supporting: DataFrame, ancestry: DataFrame, uses: DataFrame, result_uses: DataFrame) -> DataFrame:
    """request_id, problem of derived surfaces.

    requests has request_id, geometry_id, frame, scale, representation; results
    the same of the candidate, its artifact_id and artifact_kind, and
    materialized_id and materialized_kind, the artifact that its files name. A
    candidate keeps geometry, frame, scale (null is unresolved) and representation; its intended uses (uses
    and result_uses: request_id, position, use) are the request's, of which
    there is at least one, unique and in order; its files name the candidate.
    """
    both = _joined(requests, results)
    rules = {"other_geometry": _changed("geometry_id"), "other_frame": _changed("frame"), "other_scale": _changed("scale"), "other_representation": _changed("representation"), "other_materialization": ~(F.col("materialized_id").eqNullSafe(F.col("artifact_id")) & F.col("materialized_kind").eqNullSafe(F.col("artifact_kind")))}
    return _union([
        ancestry_problems(requests, results, sources, supporting, ancestry),
        _each(both, rules),
        _named(requests.join(uses, "request_id", "left_anti"), "no_use"),
        order_problems(uses, "request_id", ["use"], "use"),
        list_problems(uses, result_uses, "use", "uses"),
    ])


def appearance_problems(requests: DataFrame, results: DataFrame, sources: DataFrame, supporting: DataFrame, ancestry: DataFrame, observations: DataFrame, result_observations: DataFrame) -> DataFrame:
    """request_id, problem of appearance candidates.

    As hybrid_surface_problems, with surface_id (null without a source surface)
    kept as it is, and with the observations that were trained on (request_id,
    position, observation_id), unique and in order, in place of uses.
    """
    both = _joined(requests, results)
    rules = {"other_geometry": _changed("geometry_id"), "other_surface": _changed("surface_id"), "other_frame": _changed("frame"), "other_scale": _changed("scale"), "other_representation": _changed("representation"), "other_materialization": ~(F.col("materialized_id").eqNullSafe(F.col("artifact_id")) & F.col("materialized_kind").eqNullSafe(F.col("artifact_kind")))}
    return _union([
        ancestry_problems(requests, results, sources, supporting, ancestry),
        _each(both, rules),
        _named(requests.join(observations, "request_id", "left_anti"), "no_observation"),
        order_problems(observations, "request_id", ["observation_id"], "observation"),
        list_problems(observations, result_observations, "observation_id", "observations"),
    ])


def depth_prior_problems(requests: DataFrame, results: DataFrame, sources: DataFrame, supporting: DataFrame, ancestry: DataFrame, fields: DataFrame) -> DataFrame:
    """request_id, problem of learned depth priors.

    requests has request_id, geometry_id, convention; results request_id,
    artifact_id, artifact_kind, geometry_id; fields (request_id, field_id,
    convention) the depth fields, which keep the convention asked for. The geometry is
    the request's, and an output may be no input.
    """
    others = fields.join(requests.select("request_id", F.col("convention").alias("asked")), "request_id").where("not convention <=> asked")
    return _union([
        ancestry_problems(requests, results, sources, supporting, ancestry),
        _each(_joined(requests.drop("convention"), results), {"other_geometry": _changed("geometry_id")}),
        _named(others, "other_convention"),
        _named(results.join(fields, "request_id", "left_anti"), "no_field"),
    ])


def trainer_problems(producers: DataFrame, profiles: DataFrame, trainer: dict[str, str], staged: DataFrame, audits: DataFrame) -> DataFrame:
    """request_id, problem of trained appearances before they are assembled.

    producers has request_id, implementation, version, revision,
    configuration_sha256, checkpoint_id; profiles request_id, profile_sha256.
    The producer is exactly the trainer (implementation, version, revision),
    its configuration is the training profile, and there is no checkpoint.
    staged and audits are what the gates on staged files and on their payloads
    found when run again (request_id, problem): their problems stay problems here.
    """
    both = producers.join(profiles, "request_id", "left")
    other = ~(F.col("implementation").eqNullSafe(F.lit(trainer["implementation"])) & F.col("version").eqNullSafe(F.lit(trainer["version"])) & F.col("revision").eqNullSafe(F.lit(trainer.get("revision"))))
    rules = {"other_trainer": other, "other_profile": F.col("configuration_sha256") != F.col("profile_sha256"), "checkpoint": F.col("checkpoint_id").isNotNull()}
    return _union([_each(both, rules), staged.select("request_id", "problem"), audits.select("request_id", "problem")])
