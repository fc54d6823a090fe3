"""Queries of the lineage rules: every customer is a request with its orders as supporting artifacts, and faults are planted by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lineage

def _k() -> Column:
    return F.col("request_id")


def _id(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), 9, "0"))


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Requests, sources, supporting artifacts and claimed ancestry."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("nation"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("request_id"), _id("o", F.col("o_orderkey")).alias("id")).distinct()
    sources = customers.select("request_id", F.lit("geometry").alias("kind"), F.explode(F.array(_id("n", F.col("nation")), _id("c", _k()))).alias("id"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("id"))
    supporting = orders.select("request_id", F.when(_k() % 43 == 0, -place).otherwise(place).alias("position"), F.lit("depth").alias("kind"), "id")
    every = sources.select("request_id", "kind", "id").unionByName(supporting.select("request_id", "kind", "id"))
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("id", "kind"))
    claimed = every.withColumn("position", n).where(~((_k() % 11 == 0) & (F.col("position") == 1)))
    claimed = claimed.withColumn("position", F.when(_k() % 17 == 0, -F.col("position")).otherwise(F.col("position")))
    claimed = claimed.unionByName(customers.where("request_id % 13 = 0").select("request_id", F.lit("geometry").alias("kind"), F.lit("z").alias("id"), F.when(_k() % 17 == 0, -1_000_000).otherwise(1_000_000).alias("position")))
    return customers.select("request_id"), sources, supporting, claimed


def _results(requests: DataFrame) -> DataFrame:
    own = F.when(_k() % 19 == 0, _id("c", _k())).otherwise(_id("r", _k()))
    kind = F.when(_k() % 19 == 0, "geometry").otherwise("surface")
    return requests.where("request_id % 101 <> 0").select("request_id", own.alias("artifact_id"), kind.alias("artifact_kind"), F.when(_k() % 47 == 0, -_k()).otherwise(_k()).alias("geometry_id"), F.when(_k() % 23 == 0, "g").otherwise("f").alias("frame"), F.when(_k() % 29 == 0, "metric").alias("scale"), F.when(_k() % 31 == 0, "mesh").otherwise("splats").alias("representation"),
        F.when(_k() % 37 == 0, "other").otherwise(own).alias("materialized_id"), kind.alias("materialized_kind"), F.when(_k() % 53 == 0, _id("s", _k())).alias("surface_id"))


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", _k().alias("geometry_id"), F.lit("f").alias("frame"), F.lit(None).cast("string").alias("scale"), F.lit("splats").alias("representation"), F.lit(None).cast("string").alias("surface_id"))


def _uses(requests: DataFrame, column: str, asked: bool) -> DataFrame:
    """Two entries each: none for some, in falling order for some; the result of some lacks the second."""
    first, second = F.when(_k() % 59 == 0, "b").otherwise("a"), F.when(_k() % 59 == 0, "a").otherwise("b")
    rows = requests.where("request_id % 61 <> 0").select("request_id", F.posexplode(F.array(first, second)).alias("position", column))
    return rows if asked else rows.where("not (request_id % 41 = 0 and position = 1)")


def x21_hybrid_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    requests, sources, supporting, claimed = _lists(spark, sf)
    return lineage.hybrid_surface_problems(_asked(requests).drop("surface_id"), _results(requests).drop("surface_id"), sources, supporting, claimed, _uses(requests, "use", True), _uses(requests, "use", False))


def x22_appearances(spark: SparkSession, sf: str) -> DataFrame:
    requests, sources, supporting, claimed = _lists(spark, sf)
    return lineage.appearance_problems(_asked(requests), _results(requests), sources, supporting, claimed, _uses(requests, "observation_id", True), _uses(requests, "observation_id", False))


def x20_depth_priors(spark: SparkSession, sf: str) -> DataFrame:
    requests, sources, supporting, claimed = _lists(spark, sf)
    asked = requests.select("request_id", _k().alias("geometry_id"), F.lit("z_depth").alias("convention"))
    fields = requests.where("request_id % 67 <> 0").select("request_id", F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("field_id")).withColumn("convention", F.when((_k() % 71 == 0) & (F.col("field_id") == "d2"), "ray_length").otherwise("z_depth"))
    return lineage.depth_prior_problems(asked, _results(requests).select("request_id", "artifact_id", "artifact_kind", "geometry_id"), sources, supporting, claimed, fields)


def x29_trained_appearances(spark: SparkSession, sf: str) -> DataFrame:
    requests, sources, supporting, claimed = _lists(spark, sf)
    assembled = lineage.appearance_problems(_asked(requests), _results(requests), sources, supporting, claimed, _uses(requests, "observation_id", True), _uses(requests, "observation_id", False))
    profile = F.sha2(_k().cast("string"), 256)
    producers = requests.select("request_id", F.when(_k() % 73 == 0, "other").otherwise("trainer").alias("implementation"), F.lit("1.0").alias("version"), F.when(_k() % 79 != 0, "abc").alias("revision"), F.when(_k() % 83 == 0, F.sha2(F.lit("x"), 256)).otherwise(profile).alias("configuration_sha256"), F.when(_k() % 89 == 0, "weights").alias("checkpoint_id"))
    found = lambda every, problem: requests.where(_k() % every == 0).withColumn("problem", F.lit(problem))
    trained = lineage.trainer_problems(producers, requests.withColumn("profile_sha256", profile), {"implementation": "trainer", "version": "1.0", "revision": "abc"}, found(97, "staged_missing"), found(103, "payload_malformed"))
    return assembled.unionByName(trained)


QUERIES = {"x21_hybrid_surfaces": x21_hybrid_surfaces, "x22_appearances": x22_appearances, "x20_depth_priors": x20_depth_priors, "x29_trained_appearances": x29_trained_appearances}

LISTS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
s AS (SELECT k, 'geometry' AS kind, 'n' || lpad(n::VARCHAR, 9, '0') AS id FROM c UNION ALL SELECT k, 'geometry', 'c' || lpad(k::VARCHAR, 9, '0') FROM c),
o AS (SELECT DISTINCT o_custkey AS k, 'depth' AS kind, 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS id FROM orders),
n AS (SELECT k, count(*) AS n FROM o GROUP BY 1),
result AS (SELECT k FROM c WHERE k % 101 <> 0),
ancestry AS (
  SELECT k AS request_id, 'no_result' AS problem FROM c WHERE k % 101 = 0 UNION ALL SELECT k, 'supporting_order' FROM n WHERE k % 43 = 0 AND n > 1
  UNION ALL SELECT k, 'ancestor_order' FROM c WHERE k % 17 = 0 AND 2 + coalesce((SELECT n FROM n WHERE n.k = c.k), 0) - (k % 11 = 0)::INT + (k % 13 = 0)::INT > 1
  UNION ALL SELECT k, 'ancestor_missing' FROM c WHERE k % 11 = 0 UNION ALL SELECT k, 'ancestor_unknown' FROM c WHERE k % 13 = 0 UNION ALL SELECT k, 'input_reused' FROM result WHERE k % 19 = 0),
kept AS (
  SELECT k AS request_id, 'other_geometry' AS problem FROM result WHERE k % 47 = 0 AND k <> 0 UNION ALL SELECT k, 'other_frame' FROM result WHERE k % 23 = 0 UNION ALL SELECT k, 'other_scale' FROM result WHERE k % 29 = 0
  UNION ALL SELECT k, 'other_representation' FROM result WHERE k % 31 = 0 UNION ALL SELECT k, 'other_materialization' FROM result WHERE k % 37 = 0)"""


def _list_sql(noun: str, many: str) -> str:
    return f"SELECT k AS request_id, 'no_{noun}' AS problem FROM c WHERE k % 61 = 0 UNION ALL SELECT k, '{noun}_order' FROM c WHERE k % 59 = 0 AND k % 61 <> 0 UNION ALL SELECT k, 'other_{many}' FROM c WHERE k % 41 = 0 AND k % 61 <> 0"


APPEARANCE = f"SELECT * FROM ancestry UNION ALL SELECT * FROM kept UNION ALL SELECT k, 'other_surface' FROM result WHERE k % 53 = 0 UNION ALL {_list_sql('observation', 'observations')}"

ORACLES = {
    "x21_hybrid_surfaces": f"{LISTS} SELECT * FROM ancestry UNION ALL SELECT * FROM kept UNION ALL {_list_sql('use', 'uses')}",
    "x22_appearances": f"{LISTS} {APPEARANCE}",
    "x20_depth_priors": f"{LISTS} SELECT * FROM ancestry UNION ALL SELECT * FROM kept WHERE problem = 'other_geometry' UNION ALL SELECT k, 'other_convention' FROM c WHERE k % 71 = 0 AND k % 67 <> 0 UNION ALL SELECT k, 'no_field' FROM result WHERE k % 67 = 0",
    "x29_trained_appearances": f"""{LISTS} {APPEARANCE} UNION ALL SELECT k, 'other_trainer' FROM c WHERE k % 73 = 0 OR k % 79 = 0 UNION ALL SELECT k, 'other_profile' FROM c WHERE k % 83 = 0 UNION ALL SELECT k, 'checkpoint' FROM c WHERE k % 89 = 0
UNION ALL SELECT k, 'staged_missing' FROM c WHERE k % 97 = 0 UNION ALL SELECT k, 'payload_malformed' FROM c WHERE k % 103 = 0""",
}
