"""Decisions by rules: quality policies, fallbacks, fixtures, and metric reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import assert_empty, assert_unique

#: Decisions by rising precedence.
PRECEDENCE = ("pass", "warn", "retry", "escalate", "unresolved")


def precedence(decision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECEDENCE)), decision) - 1


def policy_reasons(metrics: DataFrame, failures: DataFrame, metric_rules: DataFrame, failure_rules: DataFrame) -> DataFrame:
    """subject, kind, metric, failure, decision: each reason why a subject does not simply pass.

    metrics has subject, metric, direction, value; metric_rules metric, required,
    direction, threshold, decision; failures subject, failure; failure_rules
    failure, decision. A missing required metric, a metric without a rule and one of
    another direction are unresolved; a value strictly beyond its threshold has its rule's decision, a
    failure that of its rule, or unresolved without one. Rules are joined as any table: the engine broadcasts them if their size allows.
    """
    assert_unique(metrics, ["subject", "metric"], "a metric occurs twice")
    assert_unique(metric_rules, ["metric"], "a metric has two rules")
    assert_empty(metric_rules.where("threshold is not null and (direction = 'informational' or decision is null)"), "a threshold needs a direction and a decision")
    none = F.lit(None).cast("string")
    subjects = metrics.select("subject").union(failures.select("subject")).distinct()
    rules = metric_rules.select("metric", "required", F.col("direction").alias("expected"), "threshold", F.col("decision").alias("violation"))
    required = [F.lit(r.metric) for r in rules.where("required").collect()]  # rules are few
    needed = subjects.withColumn("metric", F.explode(F.array(*required).cast("array<string>")))
    missing = needed.join(metrics.select("subject", "metric"), ["subject", "metric"], "left_anti").select("subject", F.lit("missing_required_metric").alias("kind"), "metric", none.alias("failure"), F.lit("unresolved").alias("decision"))
    joined = metrics.join(rules.withColumn("ruled", F.lit(True)), "metric", "left")
    beyond = F.when(F.col("direction") == "higher_is_better", F.col("value") < F.col("threshold")).when(F.col("direction") == "lower_is_better", F.col("value") > F.col("threshold")).otherwise(False)
    kind = F.when(F.col("ruled").isNull(), "unknown_metric").when(F.col("direction") != F.col("expected"), "metric_direction_mismatch").when(F.coalesce(beyond, F.lit(False)), "metric_threshold_violation")
    judged = joined.withColumn("kind", kind).where("kind is not null")
    judged = judged.select("subject", "kind", "metric", none.alias("failure"), F.when(F.col("kind") == "metric_threshold_violation", F.col("violation")).otherwise("unresolved").alias("decision"))
    failed = failures.join(failure_rules.select("failure", F.col("decision").alias("mapped")), "failure", "left")
    failed = failed.select("subject", F.when(F.col("mapped").isNull(), "unmapped_failure").otherwise("mapped_failure").alias("kind"), none.alias("metric"), "failure", F.coalesce("mapped", F.lit("unresolved")).alias("decision"))
    return missing.unionByName(judged).unionByName(failed)


def evaluate_policy(metrics: DataFrame, failures: DataFrame, metric_rules: DataFrame, failure_rules: DataFrame) -> DataFrame:
    """subject, decision, reasons: the decision of highest precedence, and the reasons by falling precedence, kind, metric and failure."""
    reasons = policy_reasons(metrics, failures, metric_rules, failure_rules)
    key = F.struct((-precedence(F.col("decision"))).alias("p"), F.col("kind"), F.coalesce("metric", F.lit("")).alias("metric"), F.coalesce("failure", F.lit("")).alias("failure"), F.col("decision"))
    grouped = reasons.groupBy("subject").agg(F.array_sort(F.collect_list(key)).alias("r"))
    subjects = metrics.select("subject").union(failures.select("subject")).distinct()
    out = subjects.join(grouped, "subject", "left")
    texts = F.transform("r", lambda x: F.concat_ws(":", x["kind"], x["metric"], x["failure"], x["decision"]))
    return out.select("subject", F.coalesce(F.expr("r[0].decision"), F.lit("pass")).alias("decision"), F.coalesce(F.array_join(texts, "|"), F.lit("")).alias("reasons"))


def resolve_fallback(states: DataFrame, rules: DataFrame, nodes: DataFrame, max_transitions: int) -> DataFrame:
    """states with action and target: the rule of exactly this node and trigger while the budget lasts, else UNRESOLVED."""
    assert_empty(states.join(nodes.select("node"), "node", "left_anti"), "an unknown node")
    assert_unique(rules, ["node", "trigger"], "two rules for a node and trigger")
    joined = states.join(rules.select("node", "trigger", "action", "target"), ["node", "trigger"], "left")
    spent = F.col("transitions_used") >= max_transitions
    return joined.withColumn("target", F.when(~spent, F.col("target"))).withColumn("action", F.when(spent | F.col("action").isNull(), "UNRESOLVED").otherwise(F.col("action")))


def evaluate_fixture(expectations: DataFrame, observed: DataFrame) -> DataFrame:
    """fixture_id, metric, comparator, target, observed, passed: eq, lte or gte within a tolerance. A missing metric is an error."""
    joined = expectations.join(observed.select("fixture_id", "metric", F.col("value").alias("observed")), ["fixture_id", "metric"], "left")
    assert_empty(joined.where("observed is null"), "an expected metric was not observed")
    gap = F.col("observed") - F.col("target")
    passed = F.when(F.col("comparator") == "eq", F.abs(gap) <= F.col("abs_tolerance")).when(F.col("comparator") == "lte", gap <= F.col("abs_tolerance")).when(F.col("comparator") == "gte", -gap <= F.col("abs_tolerance"))
    return joined.select("fixture_id", "metric", "comparator", "target", "observed", F.coalesce(passed, F.lit(False)).alias("passed"))


def fixture_results(checks: DataFrame) -> DataFrame:
    """fixture_id, status: passed if all checks passed."""
    return checks.groupBy("fixture_id").agg(F.when(F.bool_and("passed"), "passed").otherwise("failed").alias("status"), F.count("*").alias("checks"))


def profile_summary(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """group_id, metric, value in long form; a metric without evidence has no row.

    observations has group_id, source_id; frames group_id, frame_time_us,
    sharpness. Counts of sources and observations always, the mean sharpness and
    the duration only where there are frames.
    """
    counts = observations.groupBy("group_id").agg(F.count("*").cast("double").alias("observation_count"), F.count_distinct("source_id").cast("double").alias("source_count"))
    means = frames.groupBy("group_id").agg(F.avg("sharpness").alias("mean_sharpness"), ((F.max("frame_time_us") - F.min("frame_time_us")) / 1e6).alias("duration_seconds"))
    wide = counts.join(means, "group_id", "left")
    names = ["observation_count", "source_count", "mean_sharpness", "duration_seconds"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return wide.select("group_id", F.expr(f"stack({len(names)}, {pairs}) as (metric, value)")).where("value is not null")


def surface_metrics(inspections: DataFrame) -> DataFrame:
    """surface_id, metric, value from the counts of a mesh; ratios of edges are left out where there are none."""
    assert_empty(inspections.where("triangle_count <= 0 or vertex_count <= 0 or finite_vertex_count > vertex_count or degenerate_triangle_count > triangle_count or largest_component_triangle_count > triangle_count"), "mesh counts disagree")
    edges = F.nullif(F.col("unique_edge_count"), F.lit(0))
    wide = inspections.select(
        "surface_id",
        F.col("connected_component_count").cast("double").alias("connected_component_count"),
        (F.col("degenerate_triangle_count") / F.col("triangle_count")).alias("degenerate_triangle_ratio"),
        (F.col("finite_vertex_count") / F.col("vertex_count")).alias("finite_vertex_ratio"),
        (F.col("largest_component_triangle_count") / F.col("triangle_count")).alias("largest_component_triangle_ratio"),
        (F.col("boundary_edge_count") / edges).alias("boundary_edge_ratio"),
        (F.col("non_manifold_edge_count") / edges).alias("non_manifold_edge_ratio"),
    )
    names = wide.columns[1:]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return wide.select("surface_id", F.expr(f"stack({len(names)}, {pairs}) as (metric, value)")).where("value is not null")


def surface_support(surfaces: DataFrame, regions: DataFrame) -> DataFrame:
    """surface_id, support: UNKNOWN without a map, UNSUPPORTED if any region is, else SUPPORTED."""
    by_surface = regions.groupBy("surface_id").agg(F.bool_and(F.col("status") == "SUPPORTED").alias("all"))
    return surfaces.select("surface_id").join(by_surface, "surface_id", "left").select("surface_id", F.when(F.col("all").isNull(), "UNKNOWN").when(F.col("all"), "SUPPORTED").otherwise("UNSUPPORTED").alias("support"))


def capture_settings_agree(observations: DataFrame, settings: list[str]) -> DataFrame:
    """group_id, agrees: all settings known on at least two observations, and one and the same."""
    known = F.lit(True)
    for s in settings:
        known = known & F.col(s).isNotNull()
    grouped = observations.groupBy("group_id").agg(F.count("*").alias("n"), F.count(F.when(known, 1)).alias("known"), F.min(F.struct(*settings)).alias("low"), F.max(F.struct(*settings)).alias("high"))
    return grouped.select("group_id", ((F.col("n") >= 2) & (F.col("known") == F.col("n")) & F.col("low").eqNullSafe(F.col("high"))).alias("agrees"))


def execution_profile(samples: DataFrame) -> DataFrame:
    """stage, metric, value: the cold time, the steady median, and the largest memory if every sample has it."""
    grouped = samples.groupBy("stage").agg(F.max(F.when(F.col("cold"), F.col("seconds"))).alias("cold_seconds"), F.median(F.when(~F.col("cold"), F.col("seconds"))).alias("steady_median_seconds"), F.when(F.count("rss_bytes") == F.count("*"), F.max("rss_bytes")).cast("double").alias("peak_rss_bytes"))
    return grouped.select("stage", F.expr("stack(3, 'cold_seconds', cold_seconds, 'steady_median_seconds', steady_median_seconds, 'peak_rss_bytes', peak_rss_bytes) as (metric, value)")).where("value is not null")


def check_route_reasons(reasons: DataFrame, existing: DataFrame) -> None:
    """Every reference of a reason must be an existing artifact; codes are unique."""
    assert_empty(reasons.groupBy("code").agg(F.count_distinct("reason_id").alias("reasons")).where("reasons > 1"), "a code occurs twice")
    assert_empty(reasons.join(existing, ["artifact_id", "kind"], "left_anti"), "a reason refers to an unknown artifact")


def check_router_input(artifacts: DataFrame) -> None:
    """An artifact id has one kind."""
    assert_empty(artifacts.groupBy("artifact_id").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1"), "an artifact id has two kinds")
