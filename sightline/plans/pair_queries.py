"""Queries over pairs, clusters and frames, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clusters, frames, graph, pairs
from ..scratch import scratch
from .bindings import bound, duck

DAY_US = 86_400_000_000


def refs_text(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat_ws("=", e["kind"], e["id"])), ",")


def _cosine(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Written, as those who use it read it more than once: all pairs are compared once."""
    return scratch(pairs.cosine_pairs(bound(spark, sf, "descriptors"), k), "cosine-pairs")


def _by_order(spark: SparkSession, sf: str, overlap: int) -> DataFrame:
    d = bound(spark, sf, "descriptors").select(F.lit("all").alias("sequence_id"), "observation_id", F.substring("observation_id", 2, 9).cast("bigint").alias("position"))
    return pairs.sequential_pairs(d, overlap).select("id1", "id2")


def flagship_retrieval_recall(spark: SparkSession, sf: str) -> DataFrame:
    learned = pairs.as_candidates(_cosine(spark, sf, 2), "learned", "retrieval", "learned-1")
    ordered = pairs.as_candidates(_by_order(spark, sf, 2), "sequential", "pairing", "sequential-1")
    found = pairs.recall_by_label(bound(spark, sf, "descriptors"), learned.unionByName(ordered), baseline="learned")
    return found.select("source_id", "metric", F.round("value", 9).alias("value"))


COSINE = """
v AS (SELECT observation_id, label, list_transform(descriptor, lambda x: x::DOUBLE) AS v FROM descriptors),
u AS (SELECT observation_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v),
sim AS (SELECT a.observation_id AS a, b.observation_id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM u a JOIN u b ON a.observation_id <> b.observation_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM sim)"""


def top(name: str, k: int) -> str:
    return f"{name} AS (SELECT least(a, b) AS id1, greatest(a, b) AS id2, max(s) AS similarity FROM ranked WHERE k <= {k} GROUP BY 1, 2)"


def offsets(name: str, k: int) -> str:
    return f"{name} AS (SELECT a.observation_id AS id1, b.observation_id AS id2 FROM descriptors a JOIN descriptors b ON substr(b.observation_id, 2)::BIGINT - substr(a.observation_id, 2)::BIGINT BETWEEN 1 AND {k})"


def j1(quadratic: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return pairs.sequential_pairs(bound(spark, sf, "sequence"), 3, quadratic=quadratic)

    return query


def j1_sql(steps: str) -> str:
    return f"""{duck('sequence')}
SELECT a.sequence_id, least(a.observation_id, b.observation_id) AS id1, greatest(a.observation_id, b.observation_id) AS id2,
       CASE WHEN a.observation_id < b.observation_id THEN a.position ELSE b.position END AS index1, CASE WHEN a.observation_id < b.observation_id THEN b.position ELSE a.position END AS index2,
       b.position - a.position AS distance
FROM sequence a JOIN sequence b ON a.sequence_id = b.sequence_id AND b.position - a.position IN {steps}"""


def d3_gps_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return bound(spark, sf, "points").select("observation_id", pairs.gps_eligibility(F.col("status"), F.col("map_datum")).alias("eligibility"))


ELIGIBLE = """CASE WHEN status = 'absent' THEN 'gps_absent' WHEN status = 'incomplete' THEN 'gps_incomplete' WHEN status = 'invalid' THEN 'gps_invalid' WHEN map_datum IS NULL THEN 'datum_missing'
     WHEN regexp_replace(upper(map_datum), '[^A-Z0-9]', '', 'g') <> 'WGS84' THEN 'datum_unsupported' ELSE 'eligible' END"""


def j2_nearby_pairs(spark: SparkSession, sf: str) -> DataFrame:
    points = bound(spark, sf, "points").where(pairs.gps_eligibility(F.col("status"), F.col("map_datum")) == "eligible")
    return pairs.nearby_pairs(points, 3, 250_000.0).select("id1", "id2", F.round("distance_m", 2).alias("distance_m"))


def j3_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _cosine(spark, sf, 5).select("id1", "id2", F.round("similarity", 6).alias("similarity"))


def s1_merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ranked = pairs.cosine_neighbours(bound(spark, sf, "descriptors"), 2)  # the nearest one is among the nearest two
    learned = pairs.as_candidates(pairs.neighbour_pairs(ranked), "learned", "retrieval", "learned-1")
    again = pairs.as_candidates(pairs.neighbour_pairs(ranked.where("k = 1")), "learned", "retrieval", "learned-0")
    ordered = pairs.as_candidates(_by_order(spark, sf, 2), "sequential", "pairing", "sequential-1")
    merged = pairs.merge_candidates(learned, again, ordered)
    text = F.array_join(F.transform("sources", lambda s: F.concat(s["source_id"], F.lit("["), refs_text(s["evidence"]), F.lit("]"))), ";")
    return merged.select("id1", "id2", text.alias("sources"))


def s9_canonical_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.canonical_tracks(bound(spark, sf, "track_elements"))


def j10_shared_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.shared_tracks(bound(spark, sf, "track_elements"))


def j13_exhaustive_count(spark: SparkSession, sf: str) -> DataFrame:
    return bound(spark, sf, "descriptors").groupBy("label").agg(pairs.exhaustive_pair_count(F.count("*")).alias("attempted"))


def j9_candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.unordered_pairs(bound(spark, sf, "poses"), "solution")


def a6_benchmark_record(spark: SparkSession, sf: str) -> DataFrame:
    record = pairs.benchmark_record(flagship_retrieval_recall(spark, sf), "record-1")
    return record.select("record_id", "source_id", F.array_join(F.transform("metrics", lambda m: F.concat_ws("=", m["metric"], F.round(m["value"] * 1e6).cast("bigint"))), ";").alias("metrics"))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    d = bound(spark, sf, "descriptors").select("observation_id", "label")
    found = pairs.merge_candidates(pairs.as_candidates(_cosine(spark, sf, 2), "learned", "retrieval", "learned-1"))
    labelled = found.join(d.select(F.col("observation_id").alias("id1"), F.col("label").alias("l1")), "id1").join(d.select(F.col("observation_id").alias("id2"), F.col("label").alias("l2")), "id2")
    n = F.substring("id1", 2, 9).cast("bigint") + F.substring("id2", 2, 9).cast("bigint")
    configuration = F.when(F.col("l1") != F.col("l2"), "DEGENERATE").when(n % 3 == 0, "PLANAR").otherwise("CALIBRATED")
    ref = F.struct(F.lit("geometry").alias("kind"), F.concat_ws("-", "id1", "id2").alias("id"))
    geometry = labelled.where(n % 7 != 0).select("id1", "id2", configuration.alias("configuration"), (n % 5).alias("inliers"), ref.alias("reference"))
    return scratch(clusters.scene_relations(found, geometry), "relations")


RELATIONS = f"""{COSINE}, {top('pairs2', 2)},
numbered AS (SELECT id1, id2, substr(id1, 2)::BIGINT + substr(id2, 2)::BIGINT AS n FROM pairs2),
relations AS (
  SELECT p.id1, p.id2, CASE WHEN n % 7 <> 0 AND n % 5 > 0 AND x.label = y.label THEN 'SUPPORTED' ELSE 'UNRESOLVED' END AS disposition,
         CASE WHEN n % 7 <> 0 THEN 'geometry=' || p.id1 || '-' || p.id2 || ',' ELSE '' END || 'retrieval=learned-1' AS evidence
  FROM numbered p JOIN descriptors x ON x.observation_id = p.id1 JOIN descriptors y ON y.observation_id = p.id2)"""


def d11_scene_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf).select("id1", "id2", "disposition", refs_text(F.col("evidence")).alias("evidence"))


def g1_scene_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.scene_clusters(bound(spark, sf, "descriptors").select("observation_id"), _relations(spark, sf))
    return found.select("cluster_id", F.array_join("members", ",").alias("members"), refs_text(F.col("evidence")).alias("evidence"))


REACH = """
edges AS (SELECT id1 AS a, id2 AS b FROM relations WHERE disposition = 'SUPPORTED' UNION SELECT id2, id1 FROM relations WHERE disposition = 'SUPPORTED'),
reach AS (SELECT observation_id AS a, observation_id AS b FROM descriptors UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
roots AS (SELECT a AS observation_id, min(b) AS root FROM reach GROUP BY a)"""


def g6_components(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.components(_relations(spark, sf).where("disposition = 'SUPPORTED'"), "id1", "id2")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    return sizes


def d12_model_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("run_id"))
    models = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("run_id"))
    return clusters.model_outcomes(runs, models)


def w1_interval_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.select_interval(bound(spark, sf, "frames"), 2 * DAY_US)


def kept_sql(interval: int) -> str:
    return f"""
nxt AS (SELECT a.video_id, a.frame_index, min(b.frame_index) AS next_index FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_index > a.frame_index AND b.frame_time_us >= a.frame_time_us + {interval} GROUP BY 1, 2),
kept AS (SELECT video_id, frame_index FROM frames WHERE frame_index = 0 UNION ALL SELECT n.video_id, n.next_index FROM kept k JOIN nxt n ON n.video_id = k.video_id AND n.frame_index = k.frame_index),
chosen AS (SELECT f.video_id, f.frame_index, f.frame_time_us FROM kept k JOIN frames f ON f.video_id = k.video_id AND f.frame_index = k.frame_index)"""


def w4_density_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return frames.bound_density(bound(spark, sf, "frames"), DAY_US // 4, 4)


def w3_quality_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = bound(spark, sf, "frames")
    before = F.lag("sharpness").over(Window.partitionBy("video_id").orderBy("frame_index"))
    return frames.select_quality(rows.withColumn("difference", F.abs(F.col("sharpness") - before)), 20.0, 0.7, 15.0).select("video_id", "frame_index", "frame_time_us")


def io8_probe_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = bound(spark, sf, "frames")
    n = F.count("*").over(Window.partitionBy("video_id"))
    shifted = F.col("frame_time_us") * 10 + 5 - F.when((F.col("frame_index") == 0) & (n > 1), 30_000_000).otherwise(0)
    seconds = (shifted.cast("decimal(20,0)") / F.lit(10_000_000).cast("decimal(8,0)")).cast("decimal(24,7)").cast("string")
    timed = rows.select("video_id", F.struct("frame_index", F.struct(seconds.alias("best_effort_timestamp_time")).alias("f")).alias("f"))
    grouped = timed.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["f"]).alias("frames"))
    return frames.parse_probe(grouped.select("video_id", F.to_json(F.struct("frames")).alias("payload")))


def sc14_frame_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = bound(spark, sf, "frames")
    made = frames.frame_observation_id(F.col("video_id"), F.sha2("video_id", 256), F.col("frame_index"), F.col("frame_time_us"))
    return rows.select("video_id", "frame_index", made.alias("observation_id"))


QUERIES = {
    "flagship_retrieval_recall": flagship_retrieval_recall,
    "j1_sequential_linear": j1(False),
    "j1_sequential_quadratic": j1(True),
    "j2_nearby_pairs": j2_nearby_pairs,
    "j3_cosine_pairs": j3_cosine_pairs,
    "j9_candidate_pairs": j9_candidate_pairs,
    "j10_shared_tracks": j10_shared_tracks,
    "j13_exhaustive_count": j13_exhaustive_count,
    "d3_gps_eligibility": d3_gps_eligibility,
    "s1_merged_candidates": s1_merged_candidates,
    "s9_canonical_tracks": s9_canonical_tracks,
    "a6_benchmark_record": a6_benchmark_record,
    "d11_scene_relations": d11_scene_relations,
    "d12_model_outcomes": d12_model_outcomes,
    "g1_scene_clusters": g1_scene_clusters,
    "g6_components": g6_components,
    "w1_interval_frames": w1_interval_frames,
    "w3_quality_frames": w3_quality_frames,
    "w4_density_bounds": w4_density_bounds,
    "io8_probe_frames": io8_probe_frames,
    "sc14_frame_ids": sc14_frame_ids,
}

RECALL = f"""{duck('descriptors')}, {COSINE}, {top('learned', 2)}, {offsets('ordered', 2)},
relevant AS (SELECT a.observation_id AS id1, b.observation_id AS id2 FROM descriptors a JOIN descriptors b ON a.label = b.label AND a.observation_id < b.observation_id),
cand AS (SELECT 'learned' AS source_id, id1, id2 FROM learned UNION ALL SELECT 'sequential', id1, id2 FROM ordered UNION ALL (SELECT 'union', id1, id2 FROM learned UNION SELECT 'union', id1, id2 FROM ordered)),
counts AS (SELECT source_id, count(*)::DOUBLE AS c, count(r.id1)::DOUBLE AS h, (SELECT count(*) FROM relevant)::DOUBLE AS r FROM cand LEFT JOIN relevant r USING (id1, id2) GROUP BY source_id),
metrics AS (
  SELECT source_id, 'candidate_count' AS metric, c AS value FROM counts UNION ALL SELECT source_id, 'hit_count', h FROM counts UNION ALL SELECT source_id, 'relevant_count', r FROM counts
  UNION ALL SELECT source_id, 'recall', round(h / r, 9) FROM counts UNION ALL SELECT 'union', 'source_count', 2.0
  UNION ALL SELECT 'union', 'incremental_recall', round(max(h / r) FILTER (source_id = 'union') - max(h / r) FILTER (source_id = 'learned'), 9) FROM counts)"""

ORACLES = {
    "flagship_retrieval_recall": f"{RECALL} SELECT source_id, metric, value::DOUBLE AS value FROM metrics",
    "a6_benchmark_record": f"{RECALL} SELECT 'record-1' AS record_id, 'union' AS source_id, string_agg(metric || '=' || round(value * 1e6)::BIGINT, ';' ORDER BY metric) AS metrics FROM metrics WHERE source_id = 'union'",
    "j1_sequential_linear": j1_sql("(1, 2, 3)"),
    "j1_sequential_quadratic": j1_sql("(1, 2, 4)"),
    "j2_nearby_pairs": f"""{duck('points')},
ok AS (SELECT observation_id, radians(latitude_deg) AS lat, radians(longitude_deg) AS lon FROM points WHERE {ELIGIBLE} = 'eligible'),
e AS (SELECT *, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM ok),
n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(lat) * sin(lat)) AS n FROM e),
xyz AS (SELECT observation_id, n * cos(lat) * cos(lon) AS x, n * cos(lat) * sin(lon) AS y, n * (1 - e2) * sin(lat) AS z FROM n),
d AS (SELECT a.observation_id AS a, b.observation_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM xyz a JOIN xyz b ON a.observation_id <> b.observation_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d WHERE d <= 250000)
SELECT least(a, b) AS id1, greatest(a, b) AS id2, round(min(d), 2) AS distance_m FROM k WHERE k <= 3 GROUP BY 1, 2""",
    "j3_cosine_pairs": f"{duck('descriptors')}, {COSINE}, {top('p', 5)} SELECT id1, id2, round(similarity, 6) AS similarity FROM p",
    "j9_candidate_pairs": f"{duck('poses')}, s AS (SELECT DISTINCT solution FROM poses) SELECT a.solution AS id1, b.solution AS id2 FROM s a JOIN s b ON a.solution < b.solution",
    "j10_shared_tracks": f"""{duck('track_elements')}, t AS (SELECT DISTINCT point_id, observation_id FROM track_elements)
SELECT a.observation_id AS id1, b.observation_id AS id2, count(*) AS shared_points FROM t a JOIN t b ON a.point_id = b.point_id AND a.observation_id < b.observation_id GROUP BY 1, 2""",
    "j13_exhaustive_count": f"{duck('descriptors')} SELECT label, (count(*) * (count(*) - 1) // 2)::BIGINT AS attempted FROM descriptors GROUP BY label",
    "d3_gps_eligibility": f"{duck('points')} SELECT observation_id, {ELIGIBLE} AS eligibility FROM points",
    "s1_merged_candidates": f"""{duck('descriptors')}, {COSINE}, {top('two', 2)}, {top('one', 1)}, {offsets('ordered', 2)},
refs AS (SELECT id1, id2, 'learned' AS s, 'retrieval=learned-1' AS e FROM two UNION SELECT id1, id2, 'learned', 'retrieval=learned-0' FROM one UNION SELECT id1, id2, 'sequential', 'pairing=sequential-1' FROM ordered),
g AS (SELECT id1, id2, s, string_agg(e, ',' ORDER BY e) AS e FROM refs GROUP BY 1, 2, 3)
SELECT id1, id2, string_agg(s || '[' || e || ']', ';' ORDER BY s) AS sources FROM g GROUP BY 1, 2""",
    "s9_canonical_tracks": f"{duck('track_elements')} SELECT point_id, observation_id, min(feature_index) AS feature_index FROM track_elements GROUP BY 1, 2",
    "d11_scene_relations": f"{duck('descriptors')}, {RELATIONS} SELECT id1, id2, disposition, evidence FROM relations",
    "d12_model_outcomes": """WITH m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS run_id, coalesce(n, 0)::BIGINT AS model_count, CASE coalesce(n, 0) WHEN 0 THEN 'NO_MODEL' WHEN 1 THEN 'SINGLE_MODEL' ELSE 'DISCONNECTED_MODELS' END AS state FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
    "g1_scene_clusters": f"""{duck('descriptors')}, {RELATIONS}, {REACH},
refs AS (SELECT DISTINCT root, unnest(string_split(evidence, ',')) AS e FROM relations JOIN roots ON observation_id = id1 WHERE disposition = 'SUPPORTED'),
ev AS (SELECT root, string_agg(e, ',' ORDER BY e) AS evidence FROM refs GROUP BY root)
SELECT 'scene:' || sha256(string_agg(observation_id, chr(10) ORDER BY observation_id)) AS cluster_id, string_agg(observation_id, ',' ORDER BY observation_id) AS members, coalesce(max(evidence), '') AS evidence
FROM roots LEFT JOIN ev USING (root) GROUP BY root""",
    "g6_components": f"{duck('descriptors')}, {RELATIONS}, {REACH} SELECT root, count(*) AS size FROM roots GROUP BY root HAVING count(*) > 1",
    "w1_interval_frames": f"{duck('frames')}, {kept_sql(2 * DAY_US)} SELECT * FROM chosen",
    "w3_quality_frames": f"""{duck('frames')}, d AS (SELECT *, abs(sharpness - lag(sharpness) OVER (PARTITION BY video_id ORDER BY frame_index)) AS difference FROM frames),
g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS n FROM d WHERE sharpness >= 20 AND clipped <= 0.7)
SELECT video_id, frame_index, frame_time_us FROM g WHERE n = 1 OR difference >= 15""",
    "w4_density_bounds": f"""{duck('frames')}, {kept_sql(DAY_US // 4)},
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM chosen)
SELECT video_id, frame_index, frame_time_us FROM r WHERE n <= 4 OR r IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""",
    "io8_probe_frames": f"""{duck('frames')},
v AS (SELECT video_id, frame_index, frame_time_us * 10 + 5 - CASE WHEN frame_index = 0 AND count(*) OVER (PARTITION BY video_id) > 1 THEN 30000000 ELSE 0 END AS v FROM frames)
SELECT video_id, frame_index, (v // 10 + CASE WHEN (v // 10) % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS frame_time_us FROM v WHERE v >= 0""",
    "sc14_frame_ids": f"{duck('frames')} SELECT video_id, frame_index, 'vf:' || sha256(video_id || chr(0) || sha256(video_id) || chr(0) || frame_index || chr(0) || frame_time_us) AS observation_id FROM frames",
}

